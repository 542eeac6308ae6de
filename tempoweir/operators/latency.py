"""Latency records: stamps of stages, hops between them and their reports.

Quantiles come from a histogram whose buckets are exact below 64 ns and a 32nd of their
value wide above, so that a report needs partial sums only; a quantile is the upper
end of its bucket, at most 3.125 % above the exact value and never above the largest.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Exact below 2^(BITS + 1); a bucket is a 2^BITS-th of its value wide above.
BITS = 5


def stamp(df: DataFrame, stage: str, now: Column) -> DataFrame:
    """Set a stage's time in ns; the first stamp stays."""
    held = F.when(F.col(stage) > 0, F.col(stage)) if stage in df.columns else F.lit(None)
    return df.withColumn(stage, F.coalesce(held, now))


def stamp_all(df: DataFrame, stages: list[str], now: Column) -> DataFrame:
    for stage in stages:
        df = stamp(df, stage, now)
    return df


def stamp_precise(df: DataFrame, stage: str, clock=time.time_ns) -> DataFrame:
    """As ``stamp`` with a fresh reading of the executor's clock for every record."""
    if stage not in df.columns:
        df = df.withColumn(stage, F.lit(None).cast("long"))

    def walk(batches):
        for batch in batches:
            at = batch.schema.get_field_index(stage)
            held = batch.column(at).to_pylist()
            yield batch.set_column(at, batch.schema.field(at), pa.array([x if x is not None and x > 0 else clock() for x in held], pa.int64()))

    return df.mapInArrow(walk, df.schema)


def stamp_each(df: DataFrame, burst: str, stage: str, now: Column | Callable[[Column], Column]) -> DataFrame:
    """``stamp`` over every record (a struct with a field ``stage``) of a burst; null bursts stay null.

    ``now`` may be a function of the record.
    """
    at = (lambda r: now) if isinstance(now, Column) else now
    return df.withColumn(burst, F.transform(burst, lambda r: r.withField(stage, F.coalesce(F.when(r[stage] > 0, r[stage]), at(r)))))


def stamp_precise_each(df: DataFrame, burst: str, stage: str, clock=time.time_ns) -> DataFrame:
    """``stamp_precise`` over every record of a burst."""

    def walk(batches):
        for batch in batches:
            at = batch.schema.get_field_index(burst)
            made = batch.column(at).to_pylist()
            for records in made:
                for r in records or ():
                    if not r[stage] or r[stage] < 0:
                        r[stage] = clock()
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, batch.schema.field(at).type))

    return df.mapInArrow(walk, df.schema)


def hops(df: DataFrame, stages: list[str], keys: list[str]) -> DataFrame:
    """(keys, hop, class, ns): each pair of neighbouring stages of each record.

    unstamped: either time is missing or 0; else measured, same_instant or backwards.
    """
    pairs = [F.struct(F.lit(f"{a}->{b}").alias("hop"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in zip(stages, stages[1:], strict=False)]
    rows = df.select(*keys, F.explode(F.array(*pairs)).alias("h")).select(*keys, "h.*")
    missing = F.coalesce(F.col("a"), F.lit(0)).eqNullSafe(0) | F.coalesce(F.col("b"), F.lit(0)).eqNullSafe(0)
    kind = F.when(missing, "unstamped").when(F.col("b") == F.col("a"), "same_instant").when(F.col("b") < F.col("a"), "backwards").otherwise("measured")
    return rows.select(*keys, "hop", kind.alias("class"), F.when(~missing & (F.col("b") >= F.col("a")), F.col("b") - F.col("a")).alias("ns"))


def bucket_top(ns: Column) -> Column:
    """Largest value of the histogram bucket that ``ns`` falls into."""
    shift = F.greatest(F.lit(0), F.length(F.bin(ns)) - 1 - BITS)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return ns - ns % width + width - 1


def latency_report(df: DataFrame, stages: list[str], keys: list[str] | None = None) -> DataFrame:
    """Count, extremes, mean and quantiles of measured hops, and tallies of the others."""
    keys = keys or []
    group = [*keys, "hop"]
    measured = hops(df, stages, keys).withColumn("top", bucket_top(F.col("ns")))
    tally = lambda kind: F.count_if(F.col("class") == kind)
    cells = measured.groupBy(*group, "top").agg(
        F.count("ns").alias("c"), F.min("ns").alias("lo"), F.max("ns").alias("hi"), F.sum("ns").alias("s"), *[tally(k).alias(k) for k in ("same_instant", "backwards", "unstamped")]
    )
    # one row for each bucket of a hop: two thousand at most
    rising = Window.partitionBy(*group).orderBy(F.col("top").asc_nulls_first())
    cells = cells.withColumns({"up_to": F.sum("c").over(rising.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("c").over(Window.partitionBy(*group))})
    quantile = lambda q: F.least(F.min(F.when(F.col("top").isNotNull() & (F.col("up_to") >= F.ceil(F.col("all") * F.lit(q))), F.col("top"))), F.max("hi"))
    total = lambda c: F.sum(c).alias(c)
    return cells.groupBy(*group).agg(
        F.sum("c").alias("n"), F.min("lo").alias("min_ns"), (F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("mean_ns"),
        quantile(0.5).alias("p50_ns"), quantile(0.99).alias("p99_ns"), quantile(0.999).alias("p999_ns"), F.max("hi").alias("max_ns"),
        total("same_instant"), total("backwards"), total("unstamped"),
    )


def latency_windows(df: DataFrame, stages: list[str], interval: int, keys: list[str] | None = None) -> DataFrame:
    """A report for each tumbling window, ``until`` being its end; a record belongs to the window of its first stage."""
    first = F.col(stages[0])
    return latency_report(df.withColumn("until", F.floor(first / interval) * interval + interval), stages, [*(keys or []), "until"])


def latency_report_if(df: DataFrame, condition: Column, stages: list[str], keys: list[str] | None = None) -> DataFrame:
    """A report of the records for which ``condition`` holds."""
    return latency_report(df.where(condition), stages, keys)


def latency_report_bursts(df: DataFrame, burst: str, stages: list[str], keys: list[str] | None = None) -> DataFrame:
    """A report of all records of all bursts (arrays of structs with the stages as fields)."""
    return latency_report(df.select(*(keys or []), F.explode(burst).alias("_r")).select(*(keys or []), "_r.*"), stages, keys)
