"""Statistics over cumulative, count and time windows, weighted by count or by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempoweir.operators import kernels
from tempoweir.operators.scan import column_scan

#: Rows of one key that a cumulative prefix takes in one task.
CHUNK_NS = 3_600 * 10**9


@dataclass(frozen=True)
class Span:
    """Which samples a statistic takes: all so far, the last ``rows``, or those of age up to ``ns``.

    A time span holds all ticks of the instant, those that come later in it too; a count
    span ends with the tick itself.
    """

    rows: int | None = None
    ns: int | None = None

    @staticmethod
    def count(n: int) -> Span:
        return Span(rows=max(1, n))

    @staticmethod
    def seconds(s: float) -> Span:
        return Span(ns=round(s * 10**9))

    @staticmethod
    def nanos(n: int) -> Span:
        return Span(ns=n)

    @staticmethod
    def unbounded() -> Span:
        return Span()

    def frame(self, keys: list[str], current: bool = True):
        """Window over the samples; without the current one for weights that only successors give."""
        end = 0 if current else -1
        if self.ns is not None:
            return W.partitionBy(*keys).orderBy("t").rangeBetween(-self.ns, end)
        base = W.partitionBy(*keys).orderBy("t", "seq")
        return base.rowsBetween(W.unboundedPreceding if self.rows is None else -(self.rows - 1), end)


NAMES = ("sum", "mean", "min", "max", "var", "std", "median")


def counted(name: str, v: Column, over) -> Column:
    """Count-weighted statistic; sample variance, 0 for a single sample."""
    made = {
        "sum": lambda: F.sum(v), "mean": lambda: F.avg(v), "min": lambda: F.min(v), "max": lambda: F.max(v),
        "var": lambda: F.var_samp(v), "std": lambda: F.stddev_samp(v), "median": lambda: F.percentile(v, F.lit(0.5)),
    }[name]().over(over)
    return F.coalesce(made, F.lit(0.0)) if name in ("var", "std") else made


def statistics(df: DataFrame, keys: list[str], names: list[str], span: Span = Span(), value: str = "v") -> DataFrame:
    """Columns ``names`` over one shared window: one shuffle, one sort."""
    over = span.frame(keys)
    return df.select("*", *[counted(n, F.col(value), over).alias(n) for n in names])


def span_variance(df: DataFrame, keys: list[str], name: str, ns: int) -> DataFrame:
    """``var`` or ``std`` of (keys, t, seq, v) over the ticks of age up to ``ns``, by a kernel: a frame would go through the whole span for each tick.

    Ticks without a time are samples of each other.
    """
    timed = column_scan(df.where("t IS NOT NULL"), keys, kernels.span_variance(ns, name == "std"), "double")
    rest = df.where("t IS NULL").select(*keys, "t", "seq", counted(name, F.col("v"), W.partitionBy(*keys)).alias("v"))
    return timed.unionByName(rest)


def time_weighted(df: DataFrame, keys: list[str], names: list[str], span: Span = Span(), value: str = "v") -> DataFrame:
    """Weight of a sample is the time to its successor, so the newest has none.

    ``mean`` and ``median`` of no weight are the current sample, ``var`` (population
    form) and ``std`` are 0.  Values are centred on the key's first value before they are squared.
    """
    if "median" in names:
        medians = column_scan(df.select(*keys, "t", "seq", F.col(value).alias("v")), keys, kernels.weighted_median(span.rows, span.ns), "double")
        rest = [n for n in names if n != "median"]
        if not rest:
            return medians.withColumnRenamed("v", "median")
        return time_weighted(df, keys, rest, span, value).join(medians.withColumnRenamed("v", "median"), [*keys, "t", "seq"])
    order = W.partitionBy(*keys).orderBy("t", "seq")
    dt = F.coalesce(F.lead("t").over(order) - F.col("t"), F.lit(0)).cast("double")
    base = df.withColumn("_dt", dt).withColumn("_x", F.col(value) - F.first(value).over(order.rowsBetween(W.unboundedPreceding, 0)))
    if span.rows == 1:
        total = mean = square = F.lit(None).cast("double")
    else:
        over = span.frame(keys, current=False)
        total = F.sum("_dt").over(over)
        mean = F.sum(F.col("_x") * F.col("_dt")).over(over) / F.nullif(total, F.lit(0.0))
        square = F.sum(F.col("_x") * F.col("_x") * F.col("_dt")).over(over) / F.nullif(total, F.lit(0.0))
    base = base.withColumns({"_m": mean, "_q": square, "_f": F.col(value) - F.col("_x")})
    var = F.coalesce(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)), F.lit(0.0))
    made = {"mean": F.coalesce(F.col("_m") + F.col("_f"), F.col(value)), "var": var, "std": F.sqrt(var)}
    return base.select(*df.columns, *[made[n].alias(n) for n in names])


def prefix_statistics(df: DataFrame, keys: list[str], names: list[str], value: str = "v", chunk_ns: int = CHUNK_NS) -> DataFrame:
    """Cumulative count, sum, mean, min and max that spread one hot key over many tasks.

    Rows meet by (key, time chunk); chunk totals, a row each, give what came before.
    """
    chunk = F.floor(F.col("t") / chunk_ns)
    cut = df.withColumn("_c", chunk)
    v = F.col(value)
    totals = cut.groupBy(*keys, "_c").agg(F.count("*").alias("_n"), F.sum(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    before = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_c", F.sum("_n").over(before).alias("_n"), F.sum("_s").over(before).alias("_s"), F.min("_lo").over(before).alias("_lo"), F.max("_hi").over(before).alias("_hi"))
    inside = W.partitionBy(*keys, "_c").orderBy("t", "seq").rowsBetween(W.unboundedPreceding, 0)
    run = cut.withColumns({"_n1": F.count(F.lit(1)).over(inside), "_s1": F.sum(v).over(inside), "_lo1": F.min(v).over(inside), "_hi1": F.max(v).over(inside)}).join(totals, [*keys, "_c"])
    n, s = F.coalesce("_n", F.lit(0)) + F.col("_n1"), F.coalesce("_s", F.lit(0.0)) + F.col("_s1")
    made = {"count": n, "sum": s, "mean": s / n, "min": F.least("_lo", "_lo1"), "max": F.greatest("_hi", "_hi1")}
    return run.select(*df.columns, *[made[x].alias(x) for x in names])
