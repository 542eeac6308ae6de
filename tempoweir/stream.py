"""Streams of ticks and their operators.

A stream is a DataFrame of rows (keys..., t in ns, seq, v).  Row-local operators
are projections, fixed frames are windows over (keys, t, seq), joins hold latest
values, and path-dependent operators are ordered scans.  Streams of several keys
are independent sequences; a stream without keys is one sequence.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweir.operators import kernels, multi, stats
from tempoweir.operators.scan import column_scan, ordered_scan
from tempoweir.operators.stats import Span

Fn = Callable[[Column], Column]


@dataclass(frozen=True)
class Decay:
    """How an exponential average forgets: by a share with each tick, or by half in a time."""

    alpha: float | None = None
    half: int | None = None

    @staticmethod
    def per_tick(alpha: float) -> Decay:
        return Decay(alpha=alpha)

    @staticmethod
    def half_life(ns: int) -> Decay:
        return Decay(half=ns)


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    keys: tuple[str, ...] = ()
    seed: Any = None  # held value before the first tick

    # -- helpers
    @property
    def _k(self) -> list[str]:
        return list(self.keys)

    @property
    def _order(self):
        return W.partitionBy(*self.keys).orderBy("t", "seq")

    def _with(self, df: DataFrame, seed: Any = None) -> Stream:
        return replace(self, df=df.select(*self.keys, "t", "seq", "v"), seed=seed)

    def _v(self, v: Column, seed: Any = None) -> Stream:
        return self._with(self.df.withColumn("v", v), seed)

    def _scan(self, kernel, kind: str | None = None) -> Stream:
        types = dict(self.df.dtypes)
        out = ", ".join(f"`{c}` {types[c]}" for c in (*self.keys, "t", "seq")) + f", v {kind or types['v']}"
        return self._with(ordered_scan(self.df, self._k, kernel, out), self.seed)

    def _run(self, kernel, kind: str | None = None) -> Stream:
        return self._with(column_scan(self.df, self._k, kernel, kind or dict(self.df.dtypes)["v"]), self.seed)

    def _joined(self, others: Sequence[Stream], active: Sequence[bool]) -> tuple[DataFrame, list[Column]]:
        inputs = [self, *others]
        rows = multi.latest([s.df for s in inputs], self._k, active)
        held = [F.when(F.col(f"v{i}").isNull(), F.lit(s.seed)).otherwise(F.col(f"v{i}.v")) for i, s in enumerate(inputs)]
        return rows, held

    # -- row-local
    def map(self, f: Fn, seed: Any = None) -> Stream:
        return self._v(f(F.col("v")), seed)

    #: Other threads are other partitions.
    spawn_map = map

    def try_map(self, f: Fn, failed: Fn, message: str = "try_map failed") -> Stream:
        """As map; the run aborts where ``failed`` holds."""
        v = F.col("v")
        return self._v(F.when(failed(v), F.raise_error(F.lit(message))).otherwise(f(v)))

    def map_filter(self, f: Callable[[Column], tuple[Column, Column]]) -> Stream:
        value, emit = f(F.col("v"))
        return self._with(self.df.withColumns({"v": value, "_e": emit}).where("_e"))

    def try_map_filter(self, f: Callable[[Column], tuple[Column, Column]], failed: Fn, message: str = "try_map_filter failed") -> Stream:
        value, emit = f(F.col("v"))
        checked = F.when(failed(F.col("v")), F.raise_error(F.lit(message)).cast("boolean")).otherwise(emit)
        return self._with(self.df.withColumns({"v": value, "_e": checked}).where("_e"))

    def map_n(self, n: int, f: Fn) -> Stream:
        out = self
        for _ in range(n):
            out = out.map(f)
        return out

    def filter_value(self, pred: Fn) -> Stream:
        return self._with(self.df.where(pred(F.col("v"))), self.seed)

    def filter_none(self) -> Stream:
        return self._with(self.df.where("v IS NOT NULL"), self.seed)

    def not_(self) -> Stream:
        return self._v(~F.col("v") if dict(self.df.dtypes)["v"] == "boolean" else F.bitwise_not("v"))

    def collapse(self) -> Stream:
        """Last item of an array; quiet where it is empty."""
        return self._with(self.df.where(F.size("v") > 0).withColumn("v", F.element_at("v", -1)))

    def with_time(self) -> Stream:
        return self._v(F.struct(F.col("t").alias("time"), F.col("v").alias("value")))

    def ticked_at(self) -> Stream:
        return self._v(F.col("t"), 0)

    def ticked_at_elapsed(self, start: int) -> Stream:
        return self._v(F.col("t") - F.lit(start), 0)

    def split(self, a: str, b: str) -> tuple[Stream, Stream]:
        return self._v(F.col(f"v.{a}")), self._v(F.col(f"v.{b}"))

    def fan(self, n: int, branch: Callable[[Stream, int], Stream]) -> Stream:
        """Merged branches of this stream: the earliest branch that answers a tick wins it, also where ticks share an instant."""
        source = replace(self, df=multi.told_apart(self.df, self._k))
        made = [branch(source, i) for i in range(n)]
        if any(s.keys != self.keys for s in made):
            return Stream.merge_all(made)
        return made[0]._with(multi.fanned(source.df, [s.df for s in made], self._k), made[0].seed)

    # -- fixed frames
    def distinct(self) -> Stream:
        """Drop consecutive duplicates; NaN differs from itself."""
        before, v = F.lag("v").over(self._order), F.col("v")
        rows = self.df.withColumns({"_p": before, "_n": F.row_number().over(self._order)})
        same = v.eqNullSafe(F.col("_p"))
        if dict(self.df.dtypes)["v"] in ("double", "float"):
            same &= ~F.coalesce(F.isnan(v), F.lit(False))
        return self._with(rows.where((F.col("_n") == 1) | ~same), self.seed)

    def difference(self) -> Stream:
        rows = self.df.withColumns({"_p": F.lag("v").over(self._order), "_n": F.row_number().over(self._order)})
        return self._with(rows.where("_n > 1").withColumn("v", F.col("v") - F.col("_p")))

    def pairwise(self) -> Stream:
        rows = self.df.withColumns({"_p": F.lag("v").over(self._order), "_n": F.row_number().over(self._order)})
        return self._with(rows.where("_n > 1").withColumn("v", F.struct(F.col("_p").alias("prev"), F.col("v").alias("cur"))))

    def take_while(self, pred: Fn) -> Stream:
        ok = F.min(F.coalesce(pred(F.col("v")), F.lit(False))).over(self._order.rowsBetween(W.unboundedPreceding, 0))
        return self._with(self.df.withColumn("_ok", ok).where("_ok"), self.seed)

    def limit(self, n: int) -> Stream:
        return self._with(self.df.withColumn("_n", F.row_number().over(self._order)).where(F.col("_n") <= n), self.seed)

    def skip(self, n: int) -> Stream:
        return self._with(self.df.withColumn("_n", F.row_number().over(self._order)).where(F.col("_n") > n), self.seed)

    def count(self) -> Stream:
        return self._v(F.row_number().over(self._order).cast("long"), 0)

    def accumulate(self) -> Stream:
        every = F.collect_list(F.struct("t", "seq", "v")).over(self._order.rowsBetween(W.unboundedPreceding, 0))
        return self._v(F.transform(every, lambda x: x["v"]))

    def window(self, interval: int, flush: bool = False) -> Stream:
        """Tumbling windows at multiples of ``interval`` from 0, emitted at the first later tick.

        ``flush``: a bounded run emits the open window at its last tick, unless that tick closed one.
        """
        interval = max(1, interval)
        packed = F.transform(F.sort_array(F.collect_list(F.struct("t", "seq", "v"))), lambda x: x["v"])
        groups = self.df.groupBy(*self.keys, F.floor(F.col("t") / interval).alias("_w")).agg(
            packed.alias("v"), F.min(F.struct("t", "seq")).alias("_a"), F.max(F.struct("t", "seq")).alias("_z")
        )
        after = F.lead("_a").over(W.partitionBy(*self.keys).orderBy("_w"))
        groups = groups.withColumn("_e", after)
        if flush:
            groups = groups.withColumn("_e", F.coalesce("_e", F.when(F.size("v") > 1, F.col("_z"))))
        return self._with(groups.where("_e IS NOT NULL").withColumns({"t": F.col("_e.t"), "seq": F.col("_e.seq")}))

    def buffer(self, capacity: int, flush: bool = False) -> Stream:
        n = F.row_number().over(self._order) - 1
        rows = self.df.withColumn("_g", F.floor(n / capacity))
        packed = F.transform(F.sort_array(F.collect_list(F.struct("t", "seq", "v"))), lambda x: x["v"])
        groups = rows.groupBy(*self.keys, "_g").agg(packed.alias("v"), F.max(F.struct("t", "seq")).alias("_z"))
        if not flush:
            groups = groups.where(F.size("v") == capacity)
        return self._with(groups.withColumns({"t": F.col("_z.t"), "seq": F.col("_z.seq")}))

    def collapse_accumulate(self) -> Stream:
        every = F.collect_list("v").over(self._order.rowsBetween(W.unboundedPreceding, 0))
        return self._v(F.flatten(every))

    # -- statistics
    def stat(self, name: str, span: Span = Span(), time_weighting: bool = False) -> Stream:
        """sum, mean, min, max, var, std or median over a span, weighted by count or by time."""
        if name == "median":
            kernel = kernels.weighted_median(span.rows, span.ns) if time_weighting else kernels.running_median() if span == Span() else kernels.window_median(span.rows, span.ns)
            return self._run(kernel, "double")
        if name in ("var", "std") and span.ns is not None and not time_weighting:
            return self._with(stats.span_variance(self.df, self._k, name, span.ns))
        of = stats.time_weighted if time_weighting else stats.statistics
        rows = of(self.df, self._k, [name], span)
        return self._with(rows.withColumn("v", F.col(name)))

    def sum(self, span: Span = Span()) -> Stream:
        return self.stat("sum", span)

    def mean(self, span: Span = Span(), time_weighting: bool = False) -> Stream:
        return self.stat("mean", span, time_weighting)

    average = mean

    def min(self, span: Span = Span()) -> Stream:
        return self.stat("min", span)

    def max(self, span: Span = Span()) -> Stream:
        return self.stat("max", span)

    def variance(self, span: Span = Span(), time_weighting: bool = False) -> Stream:
        return self.stat("var", span, time_weighting)

    def std(self, span: Span = Span(), time_weighting: bool = False) -> Stream:
        return self.stat("std", span, time_weighting)

    def median(self, span: Span = Span(), time_weighting: bool = False) -> Stream:
        return self.stat("median", span, time_weighting)

    # -- path-dependent
    def ewma(self, decay: Decay) -> Stream:
        return self._run(kernels.ewma(decay.alpha, decay.half), "double")

    def ewma_per_tick(self, alpha: float) -> Stream:
        return self._run(kernels.ewma(alpha=alpha), "double")

    def ewma_half_life(self, half_life: int) -> Stream:
        return self._run(kernels.ewma(half_life=half_life), "double")

    def throttle(self, interval: int) -> Stream:
        return self._run(kernels.throttle(interval))

    def drop_small_change(self, is_small: Callable) -> Stream:
        return self._run(kernels.drop_small_change(is_small))

    def fold(self, init, f: Callable, kind: str) -> Stream:
        return replace(self._run(kernels.fold(init, f), kind), seed=init)

    scan = fold

    def reduce(self, f: Callable, kind: str | None = None) -> Stream:
        return self._run(kernels.reduce(f), kind)

    def feedback(self, seed, f: Callable, count: int) -> Stream:
        return self._scan(kernels.feedback(seed, f, count))

    def custom(self, kernel, kind: str) -> Stream:
        """A custom operator: ``kernel()`` makes the state of one key, called with rows it yields rows."""
        return self._scan(kernel, kind)

    # -- several streams
    def bimap(self, other: Stream, f: Callable, active: Sequence[bool] = (True, True)) -> Stream:
        rows, held = self._joined([other], active)
        return self._with(rows.withColumn("v", f(*held)))

    def join(self, other: Stream, f: Callable) -> Stream:
        return self.bimap(other, f)

    def join_passive(self, other: Stream, f: Callable) -> Stream:
        return self.bimap(other, f, (True, False))

    def try_join(self, other: Stream, f: Callable, failed: Callable, message: str = "try_join failed", active: Sequence[bool] = (True, True)) -> Stream:
        return self.bimap(other, lambda a, b: F.when(failed(a, b), F.raise_error(F.lit(message))).otherwise(f(a, b)), active)

    try_bimap = try_join

    def try_join_passive(self, other: Stream, f: Callable, failed: Callable, message: str = "try_join_passive failed") -> Stream:
        return self.try_join(other, f, failed, message, (True, False))

    def trimap(self, b: Stream, c: Stream, f: Callable, active: Sequence[bool] = (True, True, True)) -> Stream:
        rows, held = self._joined([b, c], active)
        return self._with(rows.withColumn("v", f(*held)))

    join3 = trimap

    def try_trimap(self, b: Stream, c: Stream, f: Callable, failed: Callable, message: str = "try_trimap failed", active: Sequence[bool] = (True, True, True)) -> Stream:
        return self.trimap(b, c, lambda x, y, z: F.when(failed(x, y, z), F.raise_error(F.lit(message))).otherwise(f(x, y, z)), active)

    try_join3 = try_trimap

    def custom_node(self, others: Sequence[Stream], active: Sequence[bool], kernel, kind: str) -> Stream:
        """A custom operator over several inputs, run when an active one ticks.

        ``kernel()`` makes a key's state; ``run(times, values)`` gets a dict a tick, of held values v0..vn
        and flags tick0..tickn, and gives (places of the ticks that emit, or None for all; their values).
        """
        rows, held = self._joined(others, active)
        packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(held)], *[F.col(f"tick{i}") for i in range(len(held))])
        return self._with(rows.withColumn("v", packed))._run(kernel, kind)

    def filter(self, condition: Stream) -> Stream:
        """Held value whenever value or condition ticks while the condition holds; quiet before the first value."""
        rows, held = self._joined([condition], (True, True))
        return self._with(rows.where(F.col("v0").isNotNull() & held[1]).withColumn("v", F.col("v0.v")), self.seed)

    def sample(self, trigger: Stream) -> Stream:
        rows, held = self._joined([trigger], (False, True))
        return self._with(rows.withColumn("v", held[0]), self.seed)

    def merge(self, other: Stream) -> Stream:
        return Stream.merge_all([self, other])

    @staticmethod
    def merge_all(streams: Sequence[Stream]) -> Stream:
        first = streams[0]
        return first._with(multi.merged([s.df for s in streams], first._k), first.seed)

    @staticmethod
    def combine(streams: Sequence[Stream]) -> Stream:
        first = streams[0]
        return first._with(multi.combined([s.df for s in streams], first._k))

    @staticmethod
    def build_dataframe(streams: dict[str, Stream]) -> DataFrame:
        first = next(iter(streams.values()))
        return multi.outer_on_time({n: s.df for n, s in streams.items()}, first._k)

    def delay(self, d: int) -> Stream:
        return self._with(self.df.withColumn("t", F.col("t") + F.lit(d)), self.seed)

    def delay_with_reset(self, d: int, trigger: Stream) -> Stream:
        return self._with(multi.delayed_with_reset(self.df, trigger.df, self._k, d, self.seed), self.seed)

    # -- keyed
    def key_by(self, *columns: str) -> Stream:
        return replace(self, keys=columns)

    def demux(self, size: int, route: Fn) -> Stream:
        """Child of each value, ``size`` being the overflow; children are keys of the result."""
        to = route(F.col("v"))
        child = F.when((to >= 0) & (to < size), to).otherwise(size).cast("int")
        return Stream(self.df.withColumn("child", child), (*self.keys, "child"), self.seed)

    def in_order(self) -> Stream:
        """Pass-through that aborts the run where a row is older than the one before it in its split of the source."""

        def walk(batches):
            last = None
            for batch in batches:
                for t in batch.column("t").to_pylist():
                    if last is not None and t < last:
                        raise ValueError(f"time {t} after {last}")
                    last = t
                yield batch

        return replace(self, df=self.df.mapInArrow(walk, self.df.schema))

    # -- taps and sinks
    def inspect(self, f: Callable[[DataFrame], Any] | None = None) -> Stream:
        if f:
            f(self.df)
        return self

    def print(self, rows: int = 20) -> Stream:
        return self.inspect(lambda df: df.orderBy(*self.keys, "t", "seq").show(rows, truncate=False))

    def timed(self, name: str) -> tuple[Stream, Any]:
        """Pass-through with an observation of the ticks and the span of time.

        A sort of all rows after it samples them first, and then counts them twice.
        """
        from pyspark.sql import Observation

        seen = Observation(name)
        return replace(self, df=self.df.observe(seen, F.count(F.lit(1)).alias("ticks"), F.min("t").alias("first"), F.max("t").alias("last"))), seen

    def logged(self, label: str, level: int = logging.INFO) -> Stream:
        """Pass-through; each tick is logged by the executor that walks it, under the logger ``tempoweir``."""
        keys = self._k

        def walk(batches):
            log = logging.getLogger("tempoweir")
            for batch in batches:
                if log.isEnabledFor(level):
                    for row in batch.to_pylist():
                        log.log(level, "%s %s", label, " ".join(str(row[c]) for c in (*keys, "t", "v")))
                yield batch

        return replace(self, df=self.df.mapInArrow(walk, self.df.schema))

    def for_each(self, f: Callable) -> None:
        """Call ``f`` with each row on the executors; an error aborts the run."""
        self.df.foreach(f)

    def finally_(self, f: Callable[[Any], Any]) -> Any:
        """Call ``f`` with the last row when the run ends, also after an error."""
        last = None
        try:
            last = self.value()
        finally:
            f(last)
        return last

    def value(self) -> Any:
        """The last value."""
        row = self.df.orderBy(F.desc("t"), F.desc("seq")).select("v").first()
        return self.seed if row is None else row["v"]

    def collect(self) -> list[tuple]:
        """(time, value) of every tick, in order; for results that fit the driver."""
        return [(r["t"], r["v"]) for r in self.df.orderBy(*self.keys, "t", "seq").collect()]


def bounded(streams: Sequence[Stream], start: int = 0, cycles: int | None = None, duration: int | None = None) -> list[Stream]:
    """Streams cut at the bound of a run: the first ``cycles`` instants of all together, or ``duration``.

    A duration keeps instants up to the second one at or after its end, as the last
    cycle is the one that sees the end passed.
    """
    if cycles is None and duration is None:
        return [replace(s, df=s.df.where(F.col("t") >= start)) for s in streams]
    every = None
    for s in streams:
        own = s.df.where(F.col("t") >= start).select("t")
        every = own if every is None else every.unionByName(own)
    every = every.groupBy("t").agg(F.lit(1).alias("one"))
    if cycles is None:
        every, cycles = every.where(F.col("t") >= start + duration), 2
    if cycles <= 1_000:
        last = every.orderBy("t").limit(cycles).agg(F.max("t").alias("t"), F.count("*").alias("n")).first()
        until = last["t"] if last["n"] == cycles else None
    else:
        # instants are counted in ranges first; only the range with the last one is sorted
        span = every.agg(F.min("t").alias("a"), F.max("t").alias("z")).first()
        until = _nth(every, cycles, span["a"], span["z"])
    cut = (lambda t: (t >= start) & (t <= until)) if until is not None else (lambda t: t >= start)
    return [replace(s, df=s.df.where(cut(F.col("t")))) for s in streams]


def _nth(instants: DataFrame, n: int, low: int | None, high: int | None) -> int | None:
    """The n-th smallest t of distinct instants in [low, high], null if there are fewer; 1 024 counts a round reach the driver."""
    while low is not None:
        width = (high - low) // 1_024 + 1
        counts = instants.where(F.col("t").between(low, high)).groupBy(F.floor((F.col("t") - low) / width).alias("r")).count().orderBy("r").collect()
        for row in counts:
            if n <= row["count"]:
                break
            n -= row["count"]
        else:
            return None
        if width == 1:
            return low + row["r"]
        low, high = low + row["r"] * width, min(high, low + (row["r"] + 1) * width - 1)
    return None
