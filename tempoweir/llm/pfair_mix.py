"""Mixing sources to target weights: Pfair scheduling by earliest deadline first.

Sources with a weight of their own and one stream for all others share a period
of W slots, W being the sum of the integer weights.  Block j of a stream of
weight w has the release floor(j W / w) and the deadline ceil((j + 1) W / w); in
each slot the released block of the earliest deadline runs.  One period is laid
out and repeats: after every slot each stream with blocks left is less than one
block off its weight times the slots so far.  A stream that has run out leaves
its slots empty and the others close up, so no document is lost or repeated.

Everything is DataFrame and SQL functions.  A document's rank in its stream is
that of the MD5 of its id; ranks come from counts by MD5 prefix and from a window
inside one prefix, so that no stream is sorted by one task.  Counts of prefixes are summed in
two levels, prefixes of one head and then heads, so that no task sees all prefixes of a stream.
Positions follow in closed form from the table of streams.

Null sources belong to the stream of others, null ids rank last.  Repeated rows
are documents of their own.  Sources without rows take no slots.  An empty table
gives no rows; other columns stay, named as they were, and a new column whose name
is taken gets an underscore more.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempoweir.llm.common import fresh, table

#: Target weights of the registered query and the pipeline; sources not named share OTHERS.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 3, "src3": 2, "src4": 2, "src5": 1, "src6": 1}
OTHERS = 14
BLOCK = 8  # documents
PREFIX_ROWS = 512
MOST_PERIOD = 2_000


def period(spark: SparkSession, weights: list[int]) -> DataFrame:
    """(stream, j, slot): the slots of one period, by earliest deadline first."""
    total = sum(weights)
    if total > MOST_PERIOD or min(weights) < 1:
        raise ValueError("weights must be positive integers of a bounded sum")
    ws = ", ".join(map(str, weights))
    return spark.sql(f"""
      SELECT e.stream, e.j, e.slot FROM (
        SELECT explode(aggregate(
          sequence(0, {total - 1}),
          named_struct('done', array_repeat(0, {len(weights)}), 'out', cast(array() AS array<struct<stream: int, j: int, slot: int>>), 'w', array({ws})),
          (acc, t) -> named_struct(
            'done', transform(acc.done, (n, i) -> n + if(i = array_min(filter(transform(acc.done, (m, s) ->
                if(m < acc.w[s] AND floor(m * {total} / acc.w[s]) <= t, named_struct('d', ceil((m + 1) * {total} / acc.w[s]), 's', s), null)), x -> x IS NOT NULL)).s, 1, 0)),
            'out', concat(acc.out, transform(array(array_min(filter(transform(acc.done, (m, s) ->
                if(m < acc.w[s] AND floor(m * {total} / acc.w[s]) <= t, named_struct('d', ceil((m + 1) * {total} / acc.w[s]), 's', s), null)), x -> x IS NOT NULL)).s),
                s -> named_struct('stream', s, 'j', acc.done[s], 'slot', t))),
            'w', acc.w),
          acc -> acc.out)) AS e)
    """)


def mix(docs: DataFrame, weights: dict[str, int], others: int, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", into: tuple[str, str, str, str] = ("stream_", "rank_", "slot_", "position_")) -> DataFrame:
    """The rows of ``docs`` with the columns ``into``: stream, rank in it, slot and position (from 0) of the interleaved order."""
    spark = docs.sparkSession
    names = list(weights)
    into = fresh(docs, *into)
    s, rank, slot, position = into
    md5, head, prefix, here, before, earlier_heads, turn, plan, cycle, inner = fresh(docs, *into, "md5_", "head_", "prefix_", "here_", "before_", "heads_", "turn_", "plan_", "cycle_", "in_")[4:]
    stream = F.lit(len(names))
    for i, name in enumerate(names):
        stream = F.when(F.col(source_col) == name, i).otherwise(stream)
    keyed = docs.withColumn(s, stream.cast("int")).withColumn(md5, F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("g")))
    counts = {r[s]: r["n"] for r in keyed.groupBy(s).agg(F.count("*").alias("n")).collect()}  # a row for each named stream at most
    w = [*weights.values(), others]
    common = reduce(gcd, w)
    w = [x // common for x in w]
    total, held = sum(w), [counts.get(i, 0) for i in range(len(w))]
    digits = 1
    while max(held, default=0) / 16**digits > PREFIX_ROWS:
        digits += 1
    # rank in the stream: rows of smaller heads, of smaller prefixes of the same head, then the place in the own prefix
    keyed = keyed.withColumn(prefix, F.substring(md5, 1, digits))
    up_to = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(s, prefix).agg(F.count("*").alias(here)).withColumn(head, F.substring(prefix, 1, (digits + 1) // 2))
    heads = sums.groupBy(s, head).agg(F.sum(here).alias(earlier_heads))
    heads = heads.withColumn(earlier_heads, F.coalesce(F.sum(earlier_heads).over(up_to(s, head)), F.lit(0)))
    sums = sums.withColumn(before, F.coalesce(F.sum(here).over(up_to(s, head, prefix)), F.lit(0))).join(heads, [s, head])
    sums = sums.select(s, prefix, (F.col(before) + F.col(earlier_heads)).alias(before))
    inside = Window.partitionBy(s, prefix).orderBy(md5, F.col(id_col))
    ranked = keyed.withColumn(turn, F.row_number().over(inside)).join(sums, [s, prefix])
    ranked = ranked.withColumn(rank, F.col(before) + F.col(turn) - 1)

    slots = period(spark, w)
    places: list[list[int]] = [[] for _ in w]
    for row in slots.orderBy("stream", "j").collect():  # MOST_PERIOD rows at most
        places[row["stream"]].append(row["slot"])
    out = ranked.withColumn(plan, F.array(*[F.array(*[F.lit(x) for x in p]) for p in places]))
    k = F.floor(F.col(rank) / block)
    own = F.element_at(F.array(*[F.lit(x) for x in w]), F.col(s) + 1)
    out = out.withColumn(cycle, F.floor(k / own)).withColumn(inner, F.element_at(F.element_at(plan, F.col(s) + 1), (k - F.col(cycle) * own + 1).cast("int")))
    # documents of each stream in slots before this one
    ahead = F.col(rank) % block
    for i, (weight, n) in enumerate(zip(w, held, strict=True)):
        earlier = F.size(F.filter(F.element_at(plan, i + 1), lambda x: x < F.col(inner)))
        ahead = ahead + F.least(F.lit(n), (F.col(cycle) * weight + earlier) * block)
    out = out.withColumn(position, ahead.cast("long")).withColumn(slot, (F.col(cycle) * total + F.col(inner)).cast("long"))
    return out.select(*docs.columns, *into)


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS, OTHERS)
    return out.select("doc_id", "source", F.col("slot_").alias("slot"), F.col("position_").alias("position"))


def interleave(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with their slot and position in the mix."""
    into = "slot", "position"
    stream, rank, *_ = fresh(docs, "stream_", "rank_")
    out = mix(docs, WEIGHTS, OTHERS, into=(stream, rank, *into))
    return out.drop(stream, rank)


def _oracle() -> str:
    w = [*WEIGHTS.values(), OTHERS]
    total = sum(w)
    case = " ".join(f"WHEN source = '{name}' THEN {i}" for i, name in enumerate(WEIGHTS))
    values = ", ".join(f"({i}, {x})" for i, x in enumerate(w))
    zeros = ", ".join("0" for _ in w)
    return f"""
WITH RECURSIVE streams(s, w) AS (VALUES {values}),
edf(t, done, pick) AS (
  SELECT -1, [{zeros}], -1
  UNION ALL
  SELECT n.t, list_transform(n.done, lambda x, i: x + CASE WHEN i = n.pick + 1 THEN 1 ELSE 0 END), n.pick
  FROM (SELECT e.t + 1 AS t, e.done,
          (SELECT st.s FROM streams st
           WHERE e.done[st.s + 1] < st.w AND (e.done[st.s + 1] * {total}) // st.w <= e.t + 1
           ORDER BY -((-(e.done[st.s + 1] + 1) * {total}) // st.w) , st.s LIMIT 1) AS pick
        FROM edf e WHERE e.t < {total - 1}) n),
slots AS (SELECT pick AS s, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM edf WHERE t >= 0),
ranked AS (
  SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY coalesce(md5(doc_id::varchar), 'g'), doc_id) - 1 AS rank
  FROM (SELECT doc_id, source, CASE {case} ELSE {len(WEIGHTS)} END AS s FROM documents)),
placed AS (
  SELECT r.doc_id, r.source, r.rank, ((r.rank // {BLOCK}) // st.w) * {total} + sl.slot AS slot
  FROM ranked r JOIN streams st ON st.s = r.s JOIN slots sl ON sl.s = r.s AND sl.j = (r.rank // {BLOCK}) % st.w)
SELECT doc_id, source, cast(slot AS bigint) AS slot, cast(row_number() OVER (ORDER BY slot, rank) - 1 AS bigint) AS position FROM placed
"""


QUERIES = {"op8_pfair_mix": op8_pfair_mix}
ORACLE = {"op8_pfair_mix": _oracle()}
