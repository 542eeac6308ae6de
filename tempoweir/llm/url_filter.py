"""URL filter: a blocked Bloom filter in front of an exact hash join.

Rules (a host with its subdomains, and a path prefix) are a short list held in the
plan; the longest one that fits decides.  Listed canonical URLs are a table of any
size.  A page without a rule has its canonical URL looked up in the Bloom filter,
which passes possible hits; an exact join on the URL removes false positives.  A
listed page is blocked, another allowed.

Null, empty and scheme-less urls have empty host and path, fit no rule and are
allowed.  Repeated rows each get their own verdict; null and repeated listed URLs do
not count.  Without rules and listed URLs everything is allowed; an empty page table
gives no rows.  Other page columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweir.llm.common import cut, table

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: The registered query lists every canonical URL of ``pages`` whose MD5 begins so: a 256th of them.
LISTED_PREFIX = "00"

BITS_PER_KEY = 16
BROADCAST_BLOCKS = 1 << 20  # 40 bytes a block: 40 MB at most
BROADCAST_KEYS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without ``www.`` plus path without ``.html`` and trailing slashes."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def listed_urls(pages: DataFrame, prefix: str = LISTED_PREFIX, url: str = "url") -> DataFrame:
    """(key): distinct canonical URLs of ``pages`` whose MD5 begins with ``prefix``."""
    host, path = url_parts(F.col(url))
    key = canonical_url(host, path)
    return pages.where(host != "").select(key.alias("key")).where(F.md5(F.col("key").cast("binary")).startswith(prefix)).distinct()


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the four words of a block."""
    h = F.xxhash64(key, F.lit(7))

    def bit(at: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63).cast("long")).cast("int"))

    return [bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i in range(4)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter as rows (block, w0..w3); built by partial aggregation."""
    masks = _masks(F.col("key"))
    return (
        entries.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(masks)])
        .groupBy("block")
        .agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)])
    )


def _by_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(size, rule, verdict) of the longest rule that fits, null if none does."""
    if not rules:
        return F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    fits = []
    for verdict, rule in rules:
        of, under = rule.split("/", 1)
        fit = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{under}")
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Rows of ``pages`` with host, path, the longest fitting rule and a verdict; ``listed`` has a column key of canonical URLs.

    Only rows that pass the Bloom filter and that no rule fits reach the exact join: others
    are neither shuffled nor joined, unless the filter itself is too large to broadcast.
    """
    listed = listed.select("key").where("key is not null").distinct()
    n = listed.count()
    blocks = max(1, -(-n * BITS_PER_KEY // 256))
    bloom, exact = bloom_filter(listed, blocks), listed.withColumn("listed", F.lit(True))
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    if n <= BROADCAST_KEYS:
        exact = F.broadcast(exact)

    host, path = url_parts(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", _by_rules(F.col("host"), F.col("path"), rules)).withColumn("key", canonical_url(F.col("host"), F.col("path")))
    rows = rows.withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block", "left")
    passed = F.col("w0").isNotNull() & F.col("hit").isNull() & (F.col("host") != "")
    for i, mask in enumerate(_masks(F.col("key"))):
        passed &= F.col(f"w{i}").bitwiseAND(mask) == mask
    rows = rows.withColumn("passed", F.coalesce(passed, F.lit(False))).select(*keep, "host", "path", "hit", "key", "passed")
    sure = rows.where("not passed").withColumn("listed", F.lit(None).cast("boolean"))
    maybe = rows.where("passed").join(exact, "key", "left").select(*sure.columns)
    verdict = F.coalesce("hit.verdict", F.when(F.col("listed"), "block"), F.lit("allow"))
    return sure.unionByName(maybe).select(*keep, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, cut(listed_urls(pages)))


def _oracle() -> str:
    rules = ", ".join(f"('{verdict}', '{rule.split('/', 1)[0]}', '/{rule.split('/', 1)[1]}', '{rule}')" for verdict, rule in RULES)
    return rf"""
WITH rules(verdict, rhost, rpath, rule) AS (VALUES {rules}),
rest AS (
  SELECT page_id, row_number() OVER () AS rid,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, rid,
         translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
fit AS (
  SELECT rid, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY rid)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN p.host <> '' AND starts_with(md5(regexp_replace(p.host, '^www\.', '') || regexp_replace(p.path, '(\.html)?/*$', '')), '{LISTED_PREFIX}')
                                THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fit f ON f.rid = p.rid
"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE = {"op1_url_filter": _oracle()}
