"""Sources of ticks: generators, values and tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweir.stream import Stream


def ticker(spark: SparkSession, period: int, n: int, start: int = 0) -> Stream:
    """n ticks, ``period`` ns apart, anchored to the start."""
    return Stream(spark.range(n).select((F.col("id") * period + start).alias("t"), F.lit(0).cast("long").alias("seq"), F.lit(True).alias("v")))


def counter(spark: SparkSession, period: int, n: int, start: int = 0, kind: str = "long") -> Stream:
    return Stream(spark.range(n).select((F.col("id") * period + start).alias("t"), F.lit(0).cast("long").alias("seq"), (F.col("id") + 1).cast(kind).alias("v")), (), 0)


def constant(spark: SparkSession, value: Any, t: int = 0) -> Stream:
    return Stream(spark.range(1).select(F.lit(t).cast("long").alias("t"), F.lit(0).cast("long").alias("seq"), F.lit(value).alias("v")), (), None)


def never(spark: SparkSession, kind: str = "double") -> Stream:
    return Stream(spark.createDataFrame([], f"t bigint, seq bigint, v {kind}"))


def values(spark: SparkSession, rows: Sequence[tuple[int, Any]], kind: str = "double", seed: Any = None) -> Stream:
    """Replay of (time, value) rows; equal times keep their order."""
    return Stream(spark.createDataFrame([(t, i, v) for i, (t, v) in enumerate(rows)], f"t bigint, seq bigint, v {kind}"), (), seed)


def nanos(ts: Column) -> Column:
    """ns since the epoch of a timestamp column, exactly."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def from_table(df: DataFrame, time: str | Column, value: str | Column, keys: Sequence[str] = (), seq: str | Column | None = None, seed: Any = None) -> Stream:
    """A stream of a table; ``seq`` orders rows of one instant."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    order = F.lit(0).cast("long") if seq is None else col(seq).cast("long")
    return Stream(df.select(*keys, col(time).alias("t"), order.alias("seq"), col(value).alias("v")), tuple(keys), seed)
