"""Keyed and dynamic groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempoweir.operators import kernels
from tempoweir.operators.scan import column_scan, ordered_scan


def demux_map(df: DataFrame, capacity: int) -> DataFrame:
    """(t, seq, item, slot) of rows (t, seq, item, close): the pool of slots is one, so rows are one sequence."""
    kinds = dict(df.dtypes)
    return ordered_scan(df, [], kernels.demux_map(capacity), f"t bigint, seq bigint, item {kinds['item']}, slot int")


def demux_items(df: DataFrame, capacity: int) -> DataFrame:
    """As demux_map for packed bursts ``v`` of (item, close, value): each child gets its items of an instant as a burst."""
    items = df.select("t", F.posexplode("v").alias("seq", "x")).select("t", F.col("seq").cast("long").alias("seq"), "x.item", "x.close", "x.value")
    slots = demux_map(items.select("t", "seq", "item", "close"), capacity)
    packed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
    return items.join(slots.drop("item"), ["t", "seq"]).groupBy("t", "slot").agg(packed.alias("v"))


def dynamic_group(df: DataFrame, lifetimes: DataFrame, key: str) -> DataFrame:
    """Rows of a key while it is in the group: [added, removed) of ``lifetimes`` (key, added, removed)."""
    return df.join(lifetimes, key).where((F.col("t") >= F.col("added")) & (F.col("removed").isNull() | (F.col("t") < F.col("removed")))).drop("added", "removed")


def dynamic_group_fold(df: DataFrame, lifetimes: DataFrame, key: str, init, on_tick, on_remove, kind: str) -> DataFrame:
    """(t, seq, v): the group's value after each instant with a tick of a member or a removal.

    ``on_remove(acc, key)`` comes before ``on_tick(acc, key, value)`` and keys come in order.  The group is
    one sequence, so its rows go through one task; they are members' ticks only.
    """
    ticks = dynamic_group(df, lifetimes, key).select("t", "seq", F.col(key).alias("key"), F.lit(False).alias("gone"), "v")
    nothing = F.lit(None).cast(dict(df.dtypes)["v"])
    gone = lifetimes.where("removed is not null").select(F.col("removed").alias("t"), F.lit(0).cast("long").alias("seq"), F.col(key).alias("key"), F.lit(True).alias("gone"), nothing.alias("v"))
    rows = ticks.unionByName(gone)
    turn = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("gone"), "key", "seq"))
    rows = rows.select("t", turn.cast("long").alias("seq"), F.struct("key", "gone", "v").alias("v"))

    def step(acc, x):
        return on_remove(acc, x["key"]) if x["gone"] else on_tick(acc, x["key"], x["v"])

    every = column_scan(rows, [], kernels.fold(init, step), kind)
    return every.groupBy("t").agg(F.max("seq").alias("seq"), F.max_by("v", "seq").alias("v"))
