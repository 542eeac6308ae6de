"""Operators over several streams: latest-value joins, merges, delays.

Inputs are united once and hash-partitioned by key; held values come from a
window over the merged order, so n streams cost one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def united(frames: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Rows (keys, t, seq, src, v0..vn) of all inputs, values wrapped so that a null value is held too."""
    parts = []
    for i, df in enumerate(frames):
        own = F.struct(F.col("v").alias("v"))
        parts.append(df.select(*keys, "t", "seq", F.lit(i).alias("src"), own.alias(f"v{i}")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def latest(frames: Sequence[DataFrame], keys: list[str], active: Sequence[bool] | None = None) -> DataFrame:
    """One row for each (key, t) at which an active input ticks, with held values v0..vn.

    Values are structs (null before the first tick) that hold same-instant ticks too;
    tick0..tickn say which inputs tick at t.  Of several ticks of one input at one
    instant the last by seq is held, and the instant still gives one row.
    """
    active = [True] * len(frames) if active is None else active
    order = W.partitionBy(*keys).orderBy("t", "seq", "src")
    held = order.rowsBetween(W.unboundedPreceding, 0)
    instant = W.partitionBy(*keys, "t")
    rows = united(frames, keys)
    n = len(frames)
    rows = rows.select(
        *keys, "t", "seq", "src",
        *[F.last(f"v{i}", ignorenulls=True).over(held).alias(f"v{i}") for i in range(n)],
        *[F.max(F.col("src") == i).over(instant).alias(f"tick{i}") for i in range(n)],
        F.lead("t").over(order).alias("_next"),
    )
    ticks = reduce(lambda a, b: a | b, [F.col(f"tick{i}") for i in range(n) if active[i]])
    return rows.where((F.col("_next").isNull() | (F.col("_next") > F.col("t"))) & ticks).drop("_next", "src")


def merged(frames: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """n-ary merge: of the inputs that tick at an instant the earliest supplied wins."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(*keys, "t", "seq", "v", F.lit(i).alias("src")) for i, df in enumerate(frames)])
    first = W.partitionBy(*keys, "t").orderBy("src", "seq")
    return rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "src")


def told_apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``seq`` unique in its instant: a repeated one takes the next free number, by value; null counts as 0."""
    order = W.partitionBy(*keys, "t").orderBy("seq", "v")
    rows = df.withColumn("seq", F.coalesce("seq", F.lit(0).cast("long"))).withColumn("_n", F.row_number().over(order).cast("long"))
    most = F.max(F.col("seq") - F.col("_n")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("seq", most + F.col("_n")).drop("_n")


def fanned(source: DataFrame, frames: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """Merge of branches of one stream, tick by tick: each tick (keys, t, seq) of ``source`` goes to the earliest branch that answers it.

    What a branch emits elsewhere, delayed say, competes with all rows of its instant as in ``merged``.
    """
    ticks = source.select(*keys, "t", "seq", F.lit(None).alias("v"), F.lit(-1).alias("src"))
    rows = reduce(lambda a, b: a.unionByName(b), [*[df.select(*keys, "t", "seq", "v", F.lit(i).alias("src")) for i, df in enumerate(frames)], ticks])
    instant, tick = W.partitionBy(*keys, "t"), W.partitionBy(*keys, "t", "seq")
    src = F.when(F.col("src") >= 0, F.col("src"))
    rows = rows.repartition(*keys, "t").withColumns({"_own": F.min("src").over(tick) < 0, "_tick": F.min(src).over(tick)})
    rows = rows.withColumns({"_first": F.min(src).over(instant), "_else": F.min(F.when(~F.col("_own"), src)).over(instant)})
    wins = F.when(F.col("_own"), (src == F.col("_tick")) & (src <= F.coalesce("_else", src))).otherwise(src == F.col("_first"))
    return rows.where(wins).select(*keys, "t", "seq", "v")


def combined(frames: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """All values of an instant in argument order, as an array."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(*keys, "t", "seq", "v", F.lit(i).alias("src")) for i, df in enumerate(frames)])
    packed = F.transform(F.sort_array(F.collect_list(F.struct("src", "seq", "v"))), lambda x: x["v"])
    return rows.groupBy(*keys, "t").agg(F.min("seq").alias("seq"), packed.alias("v"))


def delayed_with_reset(source: DataFrame, trigger: DataFrame, keys: list[str], d: int, seed) -> DataFrame:
    """Values ``d`` later, except that a trigger emits the held value and clears what waits.

    A value is cleared if a trigger falls into [t, t + d].
    """
    rows = united([source, trigger.withColumn("v", F.col("t"))], keys)
    order = W.partitionBy(*keys).orderBy("t")
    rows = rows.select(
        *keys, "t", "seq", "src", "v0",
        F.first("v1.v", ignorenulls=True).over(order.rangeBetween(0, W.unboundedFollowing)).alias("_next"),
        F.last("v0", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, 0)).alias("_held"),
    )
    waits = (F.col("src") == 0) & (F.col("_next").isNull() | (F.col("_next") > F.col("t") + d))
    return rows.where(waits | (F.col("src") == 1)).select(
        *keys,
        F.when(F.col("src") == 0, F.col("t") + d).otherwise(F.col("t")).alias("t"),
        "seq",
        F.when(F.col("src") == 0, F.col("v0.v")).otherwise(F.coalesce("_held.v", F.lit(seed))).alias("v"),
    )


def outer_on_time(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """A row for each (key, t) of any input and a column for each, null where it is silent."""
    rows = united(list(frames.values()), keys)
    return rows.groupBy(*keys, "t").agg(*[F.first(f"v{i}.v", ignorenulls=True).alias(name) for i, name in enumerate(frames)])
