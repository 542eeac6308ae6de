"""Structured Streaming twins: row-local plans as they are, keyed state for ordered operators.

Row-local operators of ``Stream`` work on streaming DataFrames unchanged.  Tumbling
windows use event-time windows behind a watermark.  Path-dependent kernels and
count windows keep their state by key; rows of a micro-batch are put in order, and
a row older than the last one of its key fails the query, as an unordered source
would abort a replay.
"""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stateful(df: DataFrame, key: str, make, kind: str = "double") -> DataFrame:
    """A kernel of ``operators.kernels`` over a streaming DataFrame (key, t, seq, v); its state is kept pickled."""
    types = dict(df.dtypes)
    out = f"`{key}` {types[key]}, t bigint, seq bigint, v {kind}"

    def step(k, frames, state):
        kernel, last = cloudpickle.loads(state.get[0]) if state.exists else (make(), -1)
        rows = pd.concat(list(frames)).sort_values(["t", "seq"], kind="stable")
        times = rows["t"].tolist()
        if times and times[0] < last:
            raise ValueError(f"time {times[0]} after {last} for key {k[0]}")
        at, values = kernel.run(times, [None if pd.isna(x) else x for x in rows["v"]])
        state.update((cloudpickle.dumps((kernel, times[-1] if times else last)),))
        found = rows[[key, "t", "seq"]] if at is None else rows[[key, "t", "seq"]].iloc[at]
        yield found.assign(v=values)

    def run(k, frames, state):
        yield from step(k, frames, state)

    return df.groupBy(key).applyInPandasWithState(run, out, "cells binary", "append", "NoTimeout")


def tumbling(df: DataFrame, key: str, interval_ns: int, delay: str = "0 seconds") -> DataFrame:
    """Event-time windows of a streaming DataFrame (key, t, seq, v): count, sum, min, max when the watermark passes."""
    stamped = df.withColumn("_ts", F.timestamp_micros(F.floor(F.col("t") / 1000).cast("long"))).withWatermark("_ts", delay)
    grouped = stamped.groupBy(key, F.window("_ts", f"{interval_ns // 1000} microseconds"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max")).select(
        key, (F.unix_micros("window.end") * 1000).alias("t"), "n", "sum", "min", "max"
    )


def run_available(df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Drain what a streaming source holds now into a memory table."""
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return df.sparkSession.table(name)
