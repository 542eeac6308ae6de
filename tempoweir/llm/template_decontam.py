"""Benchmark decontamination by templates and slot consistency.

Texts become template words: runs of numbers, capitalised names inside a
sentence (not words all in capitals) and units after a number turn into typed placeholders, other words are
lower-cased.  Each text also has a second form, in which capitalised words other than
COMMON ones are placeholders wherever they stand, so that it does not matter what a
sentence opens with; forms are matched with their like.  Hashes of windows of template words of the benchmark are hash-joined
with those of the corpus.  Matches of one document and one item on one diagonal
(place in the text minus place in the item) stand for one passage: it counts when
it matches MIN_WINDOWS windows, or all of a shorter item, and when its slots are
consistent, so that a question with new numbers and names is caught and an accidental
alignment is not.  Slots at the passage's first and last word do not count, as their
runs may take in a neighbour.  Where at least half of the passage's words are matched
as wording, new values are free, two of the item's may become one and one may become
two; only a value of the item that stands for itself must not stand for another too.
Elsewhere each value of the item stands for one value of the text and the other way
round.  Rows are told apart by their text, so equal ids do not mix, and rows without
an id are judged like all others.

Texts of fewer template words than a window are held as one window of their own
length; items of fewer than MIN_WORDS are too short to be told apart and match
nothing.  Null and empty texts match nothing.  Repeated rows and repeated ids
give their hits once.  Empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweir.llm import tokens
from tempoweir.llm.common import cut, table

WINDOW = 8
MIN_WINDOWS = 6
MIN_WORDS = 4
PREFILTER_WINDOWS = 1_000_000  # 8 MB of hashes sent to the executors at most
BROADCAST_HITS = 200_000
BROADCAST_ITEM_ROWS = 100_000

# Unit words that a number may carry.
UNITS = (
    "mm cm m km in ft yd mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur gbp mph kmh kph degrees celsius fahrenheit watt watts kw kwh volt volts"
)
_UNIT_HASHES = np.sort(np.concatenate([w.hashes for w in tokens.words(pa.array([UNITS]), tokens.ALNUM, tokens.lower_latin)]))
# Words that open sentences and are no names.
COMMON = (
    "a an the this that these those there here it its he she they we you i his her their our my your one each every all both some many most no not "
    "what which who whom whose when where why how is are was were am be been do does did has have had can could will would shall should may might must "
    "and or but so if then else than as at by for from in into of off on onto out over to under up with without after before during while until since because although though "
    "find calculate compute determine evaluate solve simplify give name list write explain describe choose select consider suppose assume let show prove state use given "
    "also again once only just now next first second third last another other more less total yes see question answer"
)
_COMMON_HASHES = np.sort(np.concatenate([w.hashes for w in tokens.words(pa.array([COMMON]), tokens.ALNUM, tokens.lower_latin)]))
FORMS = (False, True)
_NUMBER, _NAME, _UNIT = 1, 2, 3
_PLACEHOLDER = tokens.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_ENDER = np.zeros(256, bool)
_ENDER[list(b".!?\n:;|\"")] = True


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def template(w: tokens.Words, anywhere: bool = False):
    """(hash, kind, slot, text) of template words; runs of one placeholder are one word.

    ``anywhere``: capitalised words are names at the start of a sentence too, COMMON ones nowhere.
    """
    n = len(w.starts)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[w.data])])
    enders = np.concatenate([[0], np.cumsum(_ENDER[w.data])])
    number = digits[w.ends] > digits[w.starts]
    head = w.data[w.starts] if n else w.data[:0]
    capital = (head >= 0x41) & (head <= 0x5A) & (w.ends - w.starts > 1)
    if n:  # not words in capitals throughout
        second = w.data[np.minimum(w.starts + 1, len(w.data) - 1)]
        capital &= ~((second >= 0x41) & (second <= 0x5A))
    opens = np.ones(n, bool)
    opens[1:] = (enders[w.starts[1:]] > enders[w.ends[:-1]]) | (w.doc[1:] != w.doc[:-1])
    kind = np.zeros(n, np.int8)
    kind[capital & (~_among(w.hashes, _COMMON_HASHES) if anywhere else ~opens)] = _NAME
    kind[number] = _NUMBER
    if n:
        unit = _among(w.hashes, _UNIT_HASHES)
        after = np.zeros(n, bool)
        after[1:] = number[:-1] & (w.doc[1:] == w.doc[:-1])
        kind[unit & after & ~number] = _UNIT
    new = np.ones(n, bool)
    new[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(new)
    with np.errstate(over="ignore"):
        value = np.add.reduceat(w.hashes * (np.arange(n, dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, n))).astype(np.uint64) + np.uint64(1)), first) if n else w.hashes
    held = kind[first]
    return np.where(held > 0, _PLACEHOLDER[held], w.hashes[first]), held, value.view(np.int64), w.doc[first]


def _window_rows(lengths, known, whole: bool):
    """Windows of each text; whole: a short text is one window, else every length is tried everywhere."""

    def rows(batches):
        for batch in batches:
            ids, rows_of = batch.column("id"), batch.column("row")
            out: list[list] = [[], [], [], [], [], [], [], []]
            formed = ((w, form) for w in tokens.words(batch.column("text"), tokens.ALNUM, tokens.lower_latin) for form in FORMS)
            for w, form in formed:
                h, kind, value, doc = template(w, form)
                counts = np.bincount(doc, minlength=w.hi - w.lo)
                starts = np.concatenate([[0], np.cumsum(counts)])
                for k in lengths:
                    rolled = tokens.rolling(h, k)
                    if not len(rolled):
                        continue
                    with np.errstate(over="ignore"):
                        rolled = tokens.mix(rolled + np.uint64(k))
                    ok = doc[: len(rolled)] == doc[k - 1 : k - 1 + len(rolled)]
                    if whole:
                        ok &= (counts[doc[: len(rolled)]] == k) | (k == WINDOW)
                    if known is not None:
                        ok &= _among(rolled, known)
                    for i in np.flatnonzero(ok):
                        d = int(doc[i])
                        slots = np.flatnonzero(kind[i : i + k]) + i
                        out[0].append(w.lo + d)
                        out[1].append(int(i - starts[d]))
                        out[2].append(int(rolled[i].view(np.int64)))
                        out[3].append(value[slots].tolist())
                        out[4].append(int(counts[d]))
                        out[5].append(k)
                        out[6].append(form)
                        out[7].append((slots - starts[d]).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(out[0], pa.int64())),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.list_(pa.int64())),
                    pa.array(out[4], pa.int64()),
                    pa.array(out[5], pa.int32()),
                    pa.array(out[6], pa.bool_()),
                    pa.array(out[7], pa.list_(pa.int64())),
                    rows_of.take(pa.array(out[0], pa.int64())),
                ],
                ["id", "at", "hash", "slots", "words", "k", "form", "places", "row"],
            )

    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, n_slots): passages of the benchmark in the documents."""
    return passages(docs, benchmark, **columns).groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("n_item_windows").alias("n_item_windows"), F.max("n_slots").alias("n_slots")
    )


def passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, row, item_id, n_windows, n_item_windows, n_slots) of each passage; ``row`` is the hash of the document's text."""
    shape = "id {}, at bigint, hash bigint, slots array<bigint>, words bigint, k int, form boolean, places array<bigint>, row bigint"
    lengths = list(range(MIN_WORDS, WINDOW + 1))
    items = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"), F.xxhash64(item_text).alias("row"))
    items = cut(items.mapInArrow(_window_rows(lengths, None, True), shape.format(dict(items.dtypes)["id"])).distinct())
    items = items.withColumn("n_item_windows", F.col("words") - F.col("k") + 1).where(F.col("words") >= MIN_WORDS)
    seen = items.agg(F.count("*").alias("rows"), F.countDistinct("hash").alias("n"), F.collect_set("k").alias("ks")).first()
    used = sorted(seen["ks"])
    known = None
    if seen["n"] <= PREFILTER_WINDOWS:
        # searched as unsigned values, in their order
        known = np.sort(items.select("hash").distinct().toArrow()["hash"].to_numpy().view(np.uint64)) if seen["n"] else np.zeros(1, np.uint64)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    found = texts.mapInArrow(_window_rows(used, known, False), shape.format(dict(texts.dtypes)["id"]))
    sides = items.select(
        "hash", "form", F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "places", "k", "n_item_windows"
    )
    met = found.select("hash", "form", F.col("id").alias("doc_id"), "row", "at", "slots").join(F.broadcast(sides) if seen["rows"] <= BROADCAST_ITEM_ROWS else sides, ["hash", "form"])
    passage = met.groupBy("doc_id", "row", "item_id", "item_row", "form", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(
        F.collect_set("item_at").alias("windows"),
        F.max("k").alias("k"),
        F.max("n_item_windows").alias("n_item_windows"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots", "places")))).alias("placed"),
    )
    passage = passage.withColumn("n_windows", F.size("windows").cast("long")).where(F.col("n_windows") >= F.least(F.lit(MIN_WINDOWS), F.col("n_item_windows")))
    pairs_of = lambda placed: F.array_distinct(F.transform(placed, lambda p: F.struct(p["item_slots"].alias("item"), p["slots"].alias("text"))))
    first, last = F.array_min("windows"), F.array_max("windows") + F.col("k") - 1
    words = F.size(F.array_distinct(F.flatten(F.transform("windows", lambda a: F.sequence(a, a + F.col("k") - 1)))))
    passage = passage.select(
        "doc_id", "row", "item_id", "n_windows", "n_item_windows",
        (F.size("placed") * 2 <= words).alias("worded"),
        F.size(pairs_of(F.col("placed"))).cast("long").alias("n_slots"),
        pairs_of(F.filter("placed", lambda p: (p["places"] > first) & (p["places"] < last))).alias("pairs"),
    )
    sided = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    kept = F.transform(F.filter("pairs", lambda p: p["item"] == p["text"]), lambda p: p["item"])
    blurred = F.exists("pairs", lambda p: (p["item"] != p["text"]) & F.array_contains(kept, p["text"]))
    strict = (F.size("pairs") == sided("item")) & (F.size("pairs") == sided("text"))
    return passage.where(strict | (F.col("worded") & ~blurred)).select("doc_id", "row", "item_id", "n_windows", "n_item_windows", "n_slots")


def op4_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a passage of the benchmark, told by the hash of their text."""
    hits = cut(passages(docs, table(spark, sf_dir, "benchmark")).select("row").distinct())
    if hits.count() <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    return docs.join(hits, F.xxhash64(docs["text"]) == hits["row"], "left_anti").select(*docs.columns)


QUERIES = {"op4_template_decontam": op4_template_decontam}
#: Placeholders and diagonals over whole texts are too slow in SQL; tests hold the query against brute force.
ORACLE: dict[str, str] = {}
