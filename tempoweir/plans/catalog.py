"""Registry of the engine's queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweir.functions import helpers
from tempoweir.operators import analysis, keyed, latency, market, stats
from tempoweir.operators.stats import Span
from tempoweir.session import shared_dir
from tempoweir.sources import files, live, ticks
from tempoweir.sources.ticks import from_table, nanos
from tempoweir.stream import Decay, Stream, bounded

HOUR, DAY = 3_600 * 10**9, 86_400 * 10**9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Events as a stream keyed by type (k) or by user; values have two decimals.
E = "e AS (SELECT event_type AS k, epoch_us(ts) * 1000 AS t, event_id AS seq, value AS v FROM events)"
U = "e AS (SELECT user_id AS k, epoch_us(ts) * 1000 AS t, event_id AS seq, value AS v FROM events)"
EN = E + ", n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, seq) AS rn FROM e)"
UN = U + ", n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, seq) AS rn FROM e)"


def events(spark: SparkSession, sf: str, key: str | None = "event_type") -> Stream:
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("t", nanos(F.col("ts")))
    if key:
        df = df.withColumn("k", F.col(key))
    return from_table(df, "t", "value", ["k"] if key else [], "event_id", 0.0)


def daily(spark: SparkSession, sf: str, table: str, time: str, value: str, key: str) -> Stream:
    """A stream of one value for each key and day: the sum over the day's rows."""
    df = spark.read.parquet(f"{sf}/{table}.parquet").withColumn("t", nanos(F.col(time))).withColumn("k", F.col(key))
    return from_table(df.groupBy("k", "t").agg(F.sum(F.col(value).cast("decimal(20,2)")).cast("double").alias("v")), "t", "v", ["k"], None, 0.0)


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            # ties of binary fractions round up on both sides
            ORACLE[name] = sql.replace(", 6)", " + 1e-9, 6)").replace(", 4)", " + 1e-7, 4)")
        return f

    return put


def rounded(c, digits: int = 6):
    """Rounded half up, with a nudge that outweighs the order of summation."""
    return F.round((F.col(c) if isinstance(c, str) else c) + (1e-9 if digits == 6 else 1e-7), digits)


def out(s: Stream | DataFrame, v=None) -> DataFrame:
    df = s.df if isinstance(s, Stream) else s
    keys = [c for c in ("k", "child") if c in df.columns]
    value = F.col("v") if v is None else v
    if v is None and dict(df.dtypes)["v"] == "double":
        value = rounded("v")
    return df.select(*keys, "t", value.alias("v"))


# ---- row-local
add("map", f"WITH {E} SELECT k, t, round(v * 2 + 1, 6) AS v FROM e")(lambda s, d: out(events(s, d).map(lambda v: v * 2 + 1)))
add("map_n", f"WITH {E} SELECT k, t, round(v + 5, 6) AS v FROM e")(lambda s, d: out(events(s, d).map_n(5, lambda v: v + 1)))
add("try_map", f"WITH {E} SELECT k, t, round(sqrt(v), 6) AS v FROM e")(lambda s, d: out(events(s, d).try_map(F.sqrt, lambda v: v < 0, "negative value")))
add("map_filter", f"WITH {E} SELECT k, t, round(v / 10, 6) AS v FROM e WHERE v > 20")(lambda s, d: out(events(s, d).map_filter(lambda v: (v / 10, v > 20))))
add("try_map_filter", f"WITH {E} SELECT k, t, round(v / 10, 6) AS v FROM e WHERE v > 40")(lambda s, d: out(events(s, d).try_map_filter(lambda v: (v / 10, v > 40), lambda v: v < 0)))
add("filter_value", f"WITH {E} SELECT k, t, v FROM e WHERE v >= 50")(lambda s, d: out(events(s, d).filter_value(lambda v: v >= 50)))
add("filter_none", f"WITH {E} SELECT k, t, CASE WHEN v > 10 THEN v END AS v FROM e WHERE v > 10")(lambda s, d: out(events(s, d).map(lambda v: F.when(v > 10, v)).filter_none()))
add("not", f"WITH {E} SELECT k, t, NOT (v > 30) AS v FROM e")(lambda s, d: out(events(s, d).map(lambda v: v > 30).not_()))
add("with_time", f"WITH {E} SELECT k, t, t AS time, v FROM e")(lambda s, d: events(s, d).with_time().df.select("k", "t", F.col("v.time").alias("time"), F.col("v.value").alias("v")))
add("split", f"WITH {E} SELECT k, t, round(v + 1, 6) AS v FROM e")(lambda s, d: out(events(s, d).map(lambda v: F.struct(v.alias("a"), (v + 1).alias("b"))).split("a", "b")[1]))
add("ticked_at", f"WITH {E} SELECT k, t, t AS v FROM e")(lambda s, d: out(events(s, d).ticked_at()))
add("ticked_at_elapsed", f"WITH {E} SELECT k, t, t - 1704067200000000000 AS v FROM e")(lambda s, d: out(events(s, d).ticked_at_elapsed(1704067200000000000)))
add("collapse", f"WITH {E} SELECT k, t, v + 2 AS v FROM e WHERE v > 25")(lambda s, d: out(events(s, d).map(lambda v: F.when(v > 25, F.array(v, v + 1, v + 2)).otherwise(F.slice(F.array(v), 1, 0))).collapse()))
add("fan", f"WITH {E} SELECT k, t, CASE WHEN v > 60 THEN v ELSE v * 2 END AS v FROM e")(
    lambda s, d: out(events(s, d).fan(2, lambda x, i: x.filter_value(lambda v: v > 60) if i == 0 else x.map(lambda v: v * 2)))
)

# ---- fixed frames
O = "OVER (PARTITION BY k ORDER BY t, seq)"  # noqa: E741
add("distinct", f"WITH {E}, b AS (SELECT k, t, seq, cast(floor(v / 40) AS bigint) AS v FROM e), l AS (SELECT *, lag(v) {O} AS p, row_number() {O} AS n FROM b) SELECT k, t, v FROM l WHERE n = 1 OR v IS DISTINCT FROM p")(
    lambda s, d: out(events(s, d).map(lambda v: F.floor(v / 40)).distinct())
)
add("difference", f"WITH {E}, l AS (SELECT *, lag(v) {O} AS p FROM e) SELECT k, t, round(v - p, 6) AS v FROM l WHERE p IS NOT NULL")(lambda s, d: out(events(s, d).difference()))
add("pairwise", f"WITH {E}, l AS (SELECT *, lag(v) {O} AS p FROM e) SELECT k, t, p AS prev, v FROM l WHERE p IS NOT NULL")(
    lambda s, d: events(s, d).pairwise().df.select("k", "t", F.col("v.prev").alias("prev"), F.col("v.cur").alias("v"))
)
add("take_while", f"WITH {U}, l AS (SELECT *, min(cast(v < 100 AS int)) OVER (PARTITION BY k ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS ok FROM e) SELECT k, t, v FROM l WHERE ok = 1")(
    lambda s, d: out(events(s, d, "user_id").take_while(lambda v: v < 100))
)
add("limit", f"WITH {UN} SELECT k, t, v FROM n WHERE rn <= 5")(lambda s, d: out(events(s, d, "user_id").limit(5)))
add("skip", f"WITH {UN} SELECT k, t, v FROM n WHERE rn > 5")(lambda s, d: out(events(s, d, "user_id").skip(5)))
add("count", f"WITH {E} SELECT k, t, row_number() {O} AS v FROM e")(lambda s, d: out(events(s, d).count()))
add("accumulate", f"WITH {UN} SELECT k, t, rn AS n, round(sum(v) OVER (PARTITION BY k ORDER BY rn), 6) AS v FROM n")(
    lambda s, d: events(s, d, "user_id").accumulate().df.select("k", "t", F.size("v").cast("long").alias("n"), rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("v"))
)
add("collapse_accumulate", f"WITH {UN} SELECT k, t, 2 * rn AS n, round(sum(2 * v + 1) OVER (PARTITION BY k ORDER BY rn), 6) AS v FROM n")(
    lambda s, d: events(s, d, "user_id").map(lambda v: F.array(v, v + 1)).collapse_accumulate().df.select("k", "t", F.size("v").cast("long").alias("n"), rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("v"))
)
add("window", f"""WITH {E}, g AS (SELECT k, t // {DAY} AS w, list(v ORDER BY t, seq) AS l, min(t) AS a FROM e GROUP BY 1, 2),
x AS (SELECT *, lead(a) OVER (PARTITION BY k ORDER BY w) AS t FROM g) SELECT k, t, len(l) AS n, round(list_sum(l), 6) AS v, l[1] AS first FROM x WHERE t IS NOT NULL""")(
    lambda s, d: events(s, d).window(DAY).df.select("k", "t", F.size("v").cast("long").alias("n"), rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("v"), F.get("v", F.lit(0)).alias("first"))
)
add("buffer", f"WITH {UN} SELECT k, max(t) AS t, round(sum(v), 6) AS v, max_by(v, rn) AS last FROM n GROUP BY k, (rn - 1) // 10 HAVING count(*) = 10")(
    lambda s, d: events(s, d, "user_id").buffer(10).df.select("k", "t", rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("v"), F.element_at("v", -1).alias("last"))
)

# ---- statistics: three spans, weighted by count or time
SPANS = {
    "rolling": (Span.count(10), "ORDER BY t, seq ROWS BETWEEN 9 PRECEDING AND {end}"),
    "cumulative": (Span.unbounded(), "ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND {end}"),
    "time_windowed": (Span.nanos(6 * HOUR), f"ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND {{end}}"),
}
AGGREGATE = {"sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "var": "var_samp(v)", "std": "stddev_samp(v)", "median": "quantile_cont(v, 0.5)"}


def _register_statistics() -> None:
    for span_name, (span, frame) in SPANS.items():
        for stat, agg in AGGREGATE.items():
            over = f"{agg} OVER (PARTITION BY k {frame.format(end='CURRENT ROW')})"
            over = f"coalesce({over}, 0)" if stat in ("var", "std") else over
            add(f"{span_name}_{stat}", f"WITH {E} SELECT k, t, round({over}, 6) AS v FROM e")(lambda s, d, n=stat, w=span: out(events(s, d).stat(n, w)))
        end = "1 PRECEDING"
        frame = frame.format(end=end)
        base = f"WITH {E}, d AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY k ORDER BY t, seq) - t, 0)::double AS dt, v - first_value(v) OVER (PARTITION BY k ORDER BY t, seq) AS x FROM e), m AS (SELECT *, nullif(sum(dt) OVER f, 0) AS w, sum(x * dt) OVER f AS xw, sum(x * x * dt) OVER f AS xxw FROM d WINDOW f AS (PARTITION BY k {frame}))"
        var = "greatest(coalesce(xxw / w - (xw / w) * (xw / w), 0), 0)"
        for stat, sql in {"mean": "coalesce(xw / w + v - x, v)", "var": var, "std": f"sqrt({var})"}.items():
            digits = 4 if stat != "mean" else 6
            add(f"{span_name}_{stat}_time_weighted", f"{base} SELECT k, t, round({sql}, {digits}) AS v FROM m")(
                lambda s, d, n=stat, w=span, r=digits: out(events(s, d).stat(n, w, True), rounded("v", r))
            )
        keep = {"rolling": "b.rn > a.rn - 10", "cumulative": "true", "time_windowed": f"a.t - b.t <= {6 * HOUR}"}[span_name]
        median = f"""WITH {EN}, d AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY k ORDER BY rn) - t, 0) AS dt FROM n),
p AS (SELECT a.k, a.t, a.rn, a.v AS cur, b.v, b.dt, sum(b.dt) OVER (PARTITION BY a.k, a.rn ORDER BY b.v, b.rn) AS c, sum(b.dt) OVER (PARTITION BY a.k, a.rn) AS w
      FROM d a LEFT JOIN d b ON a.k = b.k AND b.rn < a.rn AND {keep} AND b.dt > 0),
q AS (SELECT *, lead(v) OVER (PARTITION BY k, rn ORDER BY c) AS nx FROM p)
SELECT k, t, round(coalesce(arg_min(CASE WHEN 2 * c = w THEN (v + nx) / 2 ELSE v END, c) FILTER (WHERE 2 * c >= w), any_value(cur)), 6) AS v FROM q GROUP BY k, t, rn"""
        add(f"{span_name}_median_time_weighted", median)(lambda s, d, w=span: out(events(s, d).median(w, True)))


_register_statistics()
add("prefix_statistics", f"WITH {E} SELECT k, t, count(*) OVER f AS count, round(sum(v) OVER f, 6) AS sum, round(avg(v) OVER f, 6) AS mean, min(v) OVER f AS min, max(v) OVER f AS max FROM e WINDOW f AS (PARTITION BY k ORDER BY t, seq ROWS UNBOUNDED PRECEDING)")(
    lambda s, d: stats.prefix_statistics(events(s, d).df, ["k"], ["count", "sum", "mean", "min", "max"], chunk_ns=DAY).select("k", "t", "count", rounded("sum").alias("sum"), rounded("mean").alias("mean"), "min", "max")
)

# ---- path-dependent, against recursive SQL


def _recursive(start: str, step: str, emit: str = "true", cols: str = "v", of: str = UN) -> str:
    """Fold over each key's rows; ``acc`` is the state after row rn."""
    return f"WITH RECURSIVE {of}, r AS (SELECT k, rn, t, v, {start} FROM n WHERE rn = 1 UNION ALL SELECT n.k, n.rn, n.t, n.v, {step} FROM r JOIN n ON n.k = r.k AND n.rn = r.rn + 1) SELECT k, t, {cols} FROM r WHERE {emit}"


add("ewma_per_tick", _recursive("v AS acc", "r.acc + 0.2 * (n.v - r.acc)", cols="round(acc, 6) AS v", of=EN))(lambda s, d: out(events(s, d).ewma_per_tick(0.2)))
add("ewma_half_life", _recursive("v AS acc", f"r.acc + (1 - pow(2.0, -(n.t - r.t)::double / {6 * HOUR})) * (n.v - r.acc)", cols="round(acc, 6) AS v", of=EN))(lambda s, d: out(events(s, d).ewma_half_life(6 * HOUR)))
add("ewma", _recursive("v AS acc", f"r.acc + (1 - pow(2.0, -(n.t - r.t)::double / {DAY})) * (n.v - r.acc)", cols="round(acc, 6) AS v"))(lambda s, d: out(events(s, d, "user_id").ewma(Decay.half_life(DAY))))
add("throttle", _recursive("t AS last, true AS e", f"CASE WHEN n.t - r.last >= {DAY} THEN n.t ELSE r.last END, n.t - r.last >= {DAY}", "e"))(lambda s, d: out(events(s, d, "user_id").throttle(DAY)))
add("drop_small_change", _recursive("v AS last, true AS e", "CASE WHEN abs(n.v - r.last) < 15 THEN r.last ELSE n.v END, NOT abs(n.v - r.last) < 15", "e"))(
    lambda s, d: out(events(s, d, "user_id").drop_small_change(lambda a, b: abs(a - b) < 15))
)
add("fold", _recursive("greatest(v, 0) AS acc", "greatest(n.v, r.acc * 0.5)", cols="round(acc, 6) AS v"))(lambda s, d: out(events(s, d, "user_id").fold(0.0, lambda a, v: max(v, a * 0.5), "double")))
add("scan", _recursive("v AS acc", "r.acc * 0.9 + n.v", cols="round(acc, 6) AS v"))(lambda s, d: out(events(s, d, "user_id").scan(0.0, lambda a, v: a * 0.9 + v, "double")))
add("reduce", _recursive("v AS acc", "least(r.acc + 1, n.v)", cols="round(acc, 6) AS v"))(lambda s, d: out(events(s, d, "user_id").reduce(lambda a, v: min(a + 1, v))))
add("feedback", f"WITH {E}, b AS (SELECT * FROM e WHERE v > 95) SELECT k, t + i AS t, round(v * pow(2, i), 6) AS v FROM b, range(4) r(i)")(
    lambda s, d: out(events(s, d).filter_value(lambda v: v > 95).feedback(1.0, lambda x: x * 2, 4))
)

# ---- several streams: purchases (a) beside clicks (b) and views (c) of all users by hour of value
A = "a AS (SELECT l_returnflag AS k, epoch_us(l_shipdate) * 1000 AS t, sum(l_quantity::decimal(20,2))::double AS v FROM lineitem GROUP BY 1, 2)"
B = "b AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS k, epoch_us(o_orderdate) * 1000 AS t, sum(o_totalprice::decimal(20,2))::double AS v FROM orders GROUP BY 1, 2)"
C = f"c AS (SELECT k, t, v FROM a WHERE (t // {DAY}) % 3 = 0)"
HELD = f"""WITH {A}, {B}, {C},
ts AS (SELECT k, t FROM a UNION SELECT k, t FROM b),
h AS (SELECT ts.k, ts.t, a.v AS av, a.t AS a_t, b.v AS bv, b.t AS b_t, c.v AS cv FROM ts
      ASOF LEFT JOIN a ON ts.k = a.k AND ts.t >= a.t ASOF LEFT JOIN b ON ts.k = b.k AND ts.t >= b.t ASOF LEFT JOIN c ON ts.k = c.k AND ts.t >= c.t)"""


def two(spark: SparkSession, sf: str) -> tuple[Stream, Stream]:
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("t", nanos(F.col("o_orderdate")))
    orders = orders.withColumn("k", F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R"))
    b = from_table(orders.groupBy("k", "t").agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("v")), "t", "v", ["k"], None, 0.0)
    return daily(spark, sf, "lineitem", "l_shipdate", "l_quantity", "l_returnflag"), b


def third(a: Stream) -> Stream:
    """Every third day of ``a``."""
    return Stream(a.df.where(F.floor(F.col("t") / DAY) % 3 == 0), a.keys, 0.0)


def _two(f):
    return lambda s, d: out(f(*two(s, d)))


add("join", f"{HELD} SELECT k, t, round(coalesce(av, 0) + coalesce(bv, 0), 6) AS v FROM h")(_two(lambda a, b: a.join(b, lambda x, y: x + y)))
add("try_join", f"{HELD} SELECT k, t, round(coalesce(av, 0) - coalesce(bv, 0), 6) AS v FROM h")(_two(lambda a, b: a.try_join(b, lambda x, y: x - y, lambda x, y: x < 0)))
add("join_passive", f"{HELD} SELECT k, t, round(coalesce(av, 0) + coalesce(bv, 0), 6) AS v FROM h WHERE a_t = t")(_two(lambda a, b: a.join_passive(b, lambda x, y: x + y)))
add("bimap", f"{HELD} SELECT k, t, round(coalesce(av, 0) * 2 + coalesce(bv, 0), 6) AS v FROM h WHERE b_t = t")(_two(lambda a, b: a.bimap(b, lambda x, y: x * 2 + y, (False, True))))
add("join3", f"{HELD} SELECT k, t, round(coalesce(av, 0) + coalesce(bv, 0) + coalesce(cv, 0), 6) AS v FROM h")(_two(lambda a, b: a.join3(b, third(a), lambda x, y, z: x + y + z)))
add("trimap", f"{HELD} SELECT k, t, round(coalesce(av, 0) + coalesce(bv, 0) + coalesce(cv, 0), 6) AS v FROM h WHERE b_t = t")(_two(lambda a, b: a.trimap(b, third(a), lambda x, y, z: x + y + z, (False, True, False))))
add("try_bimap", f"{HELD} SELECT k, t, round(coalesce(av, 0) - 2 * coalesce(bv, 0), 6) AS v FROM h WHERE b_t = t")(_two(lambda a, b: a.try_bimap(b, lambda x, y: x - 2 * y, lambda x, y: y < 0, active=(False, True))))
add("try_join_passive", f"{HELD} SELECT k, t, round(coalesce(av, 0) + 3 * coalesce(bv, 0), 6) AS v FROM h WHERE a_t = t")(_two(lambda a, b: a.try_join_passive(b, lambda x, y: x + 3 * y, lambda x, y: x < 0)))
add("try_join3", f"{HELD} SELECT k, t, round(coalesce(av, 0) + coalesce(bv, 0) - coalesce(cv, 0), 6) AS v FROM h")(_two(lambda a, b: a.try_join3(b, third(a), lambda x, y, z: x + y - z, lambda x, y, z: z < 0)))
add("try_trimap", f"{HELD} SELECT k, t, round(coalesce(av, 0) - coalesce(bv, 0) + coalesce(cv, 0), 6) AS v FROM h WHERE a_t = t")(
    _two(lambda a, b: a.try_trimap(b, third(a), lambda x, y, z: x - y + z, lambda x, y, z: z < 0, active=(True, False, False)))
)


class _Widest:
    """Largest difference of two held values so far."""

    most = None

    def run(self, times, values):
        made = []
        for x in values:
            d = x["v0"] - x["v1"]
            self.most = d if self.most is None else max(self.most, d)
            made.append(self.most)
        return None, made


add("custom_node", f"{HELD} SELECT k, t, round(max(coalesce(av, 0) - coalesce(bv, 0)) OVER (PARTITION BY k ORDER BY t), 6) AS v FROM h WHERE a_t = t")(_two(lambda a, b: a.custom_node([b], (True, False), _Widest, "double")))
add("filter", f"{HELD} SELECT k, t, av AS v FROM h WHERE av IS NOT NULL AND coalesce(bv, 0) > 100000")(_two(lambda a, b: a.filter(b.map(lambda v: v > 100000, False))))
add("sample", f"{HELD} SELECT k, t, coalesce(av, 0) AS v FROM h WHERE b_t = t")(_two(lambda a, b: a.sample(b)))
add("merge", f"WITH {A}, {B} SELECT k, t, v FROM a UNION ALL SELECT k, t, v FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND a.t = b.t)")(_two(lambda a, b: a.merge(b)))
add("merge_n", f"WITH {A}, {B}, {C}, u AS (SELECT k, t, v, 0 AS s FROM c UNION ALL SELECT k, t, v, 1 FROM b UNION ALL SELECT k, t, v, 2 FROM a) SELECT k, t, arg_min(v, s) AS v FROM u GROUP BY k, t")(
    _two(lambda a, b: Stream.merge_all([third(a), b, a]))
)
add("combine", f"WITH {A}, {B}, u AS (SELECT k, t, v, 0 AS s FROM a UNION ALL SELECT k, t, v, 1 FROM b) SELECT k, t, count(*) AS n, arg_min(v, s) AS first, arg_max(v, s) AS last FROM u GROUP BY k, t")(
    lambda s, d: Stream.combine(list(two(s, d))).df.select("k", "t", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).alias("first"), F.element_at("v", -1).alias("last"))
)
add("build_dataframe", f"WITH {A}, {B} SELECT coalesce(a.k, b.k) AS k, coalesce(a.t, b.t) AS t, a.v AS quantity, b.v AS price FROM a FULL JOIN b ON a.k = b.k AND a.t = b.t")(
    lambda s, d: Stream.build_dataframe(dict(zip(("quantity", "price"), two(s, d), strict=True)))
)
add("delay", f"WITH {E} SELECT k, t + {HOUR} AS t, v FROM e")(lambda s, d: out(events(s, d).delay(HOUR)))
add("delay_with_reset", f"""WITH {A}, {B},
w AS (SELECT k, t + {2 * DAY} AS t, v FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.t BETWEEN a.t AND a.t + {2 * DAY}))
SELECT k, t, v FROM w UNION ALL SELECT b.k, b.t, coalesce(a.v, 0) FROM b ASOF LEFT JOIN a ON a.k = b.k AND b.t >= a.t""")(_two(lambda a, b: a.delay_with_reset(2 * DAY, b)))

# ---- bounds of a run, keys, latency
add("run_cycles", f"WITH {E}, c AS (SELECT max(t) AS t FROM (SELECT DISTINCT t FROM e ORDER BY t LIMIT 500)) SELECT e.k, e.t, e.v FROM e, c WHERE e.t <= c.t")(lambda s, d: out(bounded([events(s, d)], cycles=500)[0]))
add("run_duration", f"WITH {E}, c AS (SELECT max(t) AS t FROM (SELECT DISTINCT t FROM e WHERE t >= 1704067200000000000 + {DAY} ORDER BY t LIMIT 2)) SELECT e.k, e.t, e.v FROM e, c WHERE e.t <= c.t")(
    lambda s, d: out(bounded([events(s, d)], start=1704067200000000000, duration=DAY)[0])
)
add("demux", f"WITH {E} SELECT k, CASE WHEN v < 60 THEN cast(floor(v / 20) AS int) ELSE 3 END AS child, t, v FROM e")(lambda s, d: out(events(s, d).demux(3, lambda v: F.floor(v / 20))))
add("dynamic_group", f"WITH {U}, l AS (SELECT k, min(t) + {DAY} AS a, min(t) + {5 * DAY} AS z FROM e GROUP BY k) SELECT e.k, e.t, e.v FROM e JOIN l ON l.k = e.k WHERE e.t >= l.a AND e.t < l.z")(
    lambda s, d: out(
        keyed.dynamic_group(events(s, d, "user_id").df, _lifetimes(s, d), "k")
    )
)


_FREE = ", ".join("-1" for _ in range(16))
_ITEMS = "SELECT epoch_us(ts) * 1000 AS t, event_id AS seq, user_id::bigint AS item, value > 60 AS close, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events"
_SLOTS = f"""WITH RECURSIVE e AS ({_ITEMS}), n AS MATERIALIZED (SELECT list({{'item': item, 'close': close}} ORDER BY rn) AS l FROM e),
r AS (
  SELECT 0::bigint AS rn, [{_FREE}]::bigint[] AS held, []::bigint[] AS over, NULL::int AS slot
  UNION ALL
  SELECT rn, CASE WHEN slot = 16 THEN held ELSE list_transform(held, lambda y, i: CASE WHEN i = slot + 1 THEN CASE WHEN x.close THEN -1 ELSE x.item END ELSE y END) END,
         CASE WHEN slot < 16 THEN over WHEN x.close THEN list_filter(over, lambda y: y <> x.item) WHEN list_contains(over, x.item) THEN over ELSE list_append(over, x.item) END, slot
  FROM (SELECT rn, x, held, over, CASE WHEN list_contains(held, x.item) THEN list_position(held, x.item) - 1 WHEN list_contains(over, x.item) THEN 16
                    WHEN list_contains(held, -1) THEN list_position(held, -1) - 1 ELSE 16 END::int AS slot
        FROM (SELECT r.rn + 1 AS rn, r.held, r.over, n.l[r.rn + 1] AS x FROM r, n WHERE r.rn < len(n.l))))
SELECT e.t, e.seq, e.item, r.slot FROM r JOIN e ON e.rn = r.rn"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf, "user_id").df
    return rows.select("t", "seq", F.col("k").cast("long").alias("item"), (F.col("v") > 60).alias("close"), F.col("v").alias("value"))


@add("demux_map", _SLOTS)
def demux_map(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.demux_map(_items(spark, sf).drop("value"), 16)


@add("demux_it", f"""WITH s AS ({_SLOTS}) SELECT s.t, s.slot, count(*) AS n, round(sum(e.value), 6) AS v FROM s JOIN events e ON e.event_id = s.seq GROUP BY s.t, s.slot""")
def demux_it(spark: SparkSession, sf: str) -> DataFrame:
    bursts = _items(spark, sf).groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "item", "close", "value"))), lambda x: F.struct(x["item"].alias("item"), x["close"].alias("close"), x["value"].alias("value"))).alias("v"))
    made = keyed.demux_items(bursts, 16)
    return made.select("t", "slot", F.size("v").cast("long").alias("n"), rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("v"))


def _lifetimes(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf, "user_id").df.groupBy("k").agg((F.min("t") + DAY).alias("added"), (F.min("t") + 5 * DAY).alias("removed"))


@add("dynamic_group_fold", f"""WITH {U}, l AS (SELECT k, min(t) + {DAY} AS a, min(t) + {5 * DAY} AS z FROM e GROUP BY k),
x AS (SELECT e.t, e.v::decimal(18, 2) AS d FROM e JOIN l ON l.k = e.k WHERE e.t >= l.a AND e.t < l.z UNION ALL SELECT z, -100 FROM l)
SELECT t, round((sum(sum(d)) OVER (ORDER BY t))::double, 6) AS v FROM x GROUP BY t""")
def dynamic_group_fold(spark: SparkSession, sf: str) -> DataFrame:
    rows = keyed.dynamic_group_fold(events(spark, sf, "user_id").df, _lifetimes(spark, sf), "k", 0.0, lambda acc, key, v: acc + v, lambda acc, key: acc - 100.0, "double")
    return rows.select("t", rounded("v").alias("v"))


def _stamps(spark: SparkSession, sf: str) -> DataFrame:
    base = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("k"), nanos(F.col("ts")).alias("produce"), F.col("event_id").alias("i"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return base.withColumns({"publish": F.col("produce") + F.col("c"), "receive": F.col("produce") + F.when(F.col("i") % 7 == 0, F.col("c")).otherwise(F.col("c") * 2 - 500), "ack": F.when(F.col("i") % 11 == 0, 0).otherwise(F.col("produce") + F.col("c") * 3)})


_STAMPS = """s AS (SELECT event_type AS k, epoch_us(ts) * 1000 AS produce, event_id AS i, cast(round(value * 100) AS bigint) AS c FROM events),
x AS (SELECT k, i, produce, produce + c AS publish, produce + CASE WHEN i % 7 = 0 THEN c ELSE c * 2 - 500 END AS receive, CASE WHEN i % 11 = 0 THEN 0 ELSE produce + c * 3 END AS ack FROM s)"""


def _report(keys: str, source: str = "x") -> str:
    """The report of the stamps in SQL; a quantile is the end of the bucket of the value at its rank."""
    value = lambda q: f"l[greatest(1, ceil(n * {q}::double))::bigint]"
    width = lambda q: f"(1::bigint << greatest(0, length(bin({value(q)})) - 6)::int)"
    top = lambda q: f"least({value(q)} - {value(q)} % {width(q)} + {width(q)} - 1, max_ns)"
    return f"""WITH {_STAMPS},
h AS (SELECT *, 'produce->publish' AS hop, produce AS a, publish AS b FROM {source} UNION ALL SELECT *, 'publish->receive', publish, receive FROM {source} UNION ALL SELECT *, 'receive->ack', receive, ack FROM {source}),
m AS (SELECT *, CASE WHEN a <> 0 AND b <> 0 AND b >= a THEN b - a END AS ns FROM h),
g AS (SELECT {keys}, hop, list_sort(list(ns) FILTER (WHERE ns IS NOT NULL)) AS l, count(ns) AS n, min(ns) AS min_ns, avg(ns) AS mean_ns, max(ns) AS max_ns, count(*) FILTER (WHERE a <> 0 AND a = b) AS same_instant,
 count(*) FILTER (WHERE a <> 0 AND b <> 0 AND b < a) AS backwards, count(*) FILTER (WHERE a = 0 OR b = 0) AS unstamped FROM m GROUP BY ALL)
SELECT {keys}, hop, n, min_ns, round(mean_ns, 6) AS mean_ns, {top(0.5)} AS p50_ns, {top(0.99)} AS p99_ns, {top(0.999)} AS p999_ns, max_ns, same_instant, backwards, unstamped FROM g"""


STAGES = ["produce", "publish", "receive", "ack"]


def _latency(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mean_ns", rounded("mean_ns"))


add("latency_report", _report("k"))(lambda s, d: _latency(latency.latency_report(_stamps(s, d), STAGES, ["k"])))
add("latency_report_if", _report("k", "(SELECT * FROM x WHERE i % 3 = 0)"))(lambda s, d: _latency(latency.latency_report_if(_stamps(s, d), F.col("i") % 3 == 0, STAGES, ["k"])))
add("latency_windows", _report("until", f"(SELECT *, produce // {DAY} * {DAY} + {DAY} AS until FROM x)"))(lambda s, d: _latency(latency.latency_windows(_stamps(s, d), STAGES, DAY)))


def _burst_stamps(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.floor(F.col("produce") / HOUR) * HOUR
    return _stamps(spark, sf).groupBy("k", hour.alias("t")).agg(F.collect_list(F.struct(*STAGES)).alias("v"))


add("latency_report_bursts", _report("k"))(lambda s, d: _latency(latency.latency_report_bursts(_burst_stamps(s, d), "v", STAGES, ["k"])))
add("stamp", f"WITH {_STAMPS} SELECT i, CASE WHEN ack > 0 THEN ack ELSE produce + 7 END AS ack, produce + 9 AS done FROM x")(
    lambda s, d: latency.stamp(latency.stamp(_stamps(s, d), "ack", F.col("produce") + 7), "done", F.col("produce") + 9).select("i", "ack", "done")
)
add("stamp_precise", f"WITH {_STAMPS} SELECT i, CASE WHEN ack > 0 THEN ack END AS ack, true AS stamped FROM x")(
    lambda s, d: latency.stamp_precise(_stamps(s, d).withColumn("was", F.col("ack")), "ack").select("i", F.when(F.col("was") > 0, F.col("ack")).alias("ack"), (F.col("ack") > 0).alias("stamped"))
)
add("stamp_each", f"WITH {_STAMPS} SELECT k, produce // {HOUR} * {HOUR} AS t, count(*) AS n, sum(CASE WHEN ack > 0 THEN ack - produce ELSE 5 END)::bigint AS v FROM x GROUP BY ALL")(
    # times stay absolute, as a stage reached within the produce instant is stamped; a record without produce counts from 0
    lambda s, d: latency.stamp_each(_burst_stamps(s, d), "v", "ack", lambda r: F.coalesce(r["produce"], F.lit(0)) + 5).select(
        "k", "t", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda a, r: a + r["ack"] - F.coalesce(r["produce"], F.lit(0))).alias("v")
    )
)
add("stamp_precise_each", f"WITH {_STAMPS} SELECT k, produce // {HOUR} * {HOUR} AS t, count(*) AS n, 0::bigint AS missing FROM x GROUP BY ALL")(
    lambda s, d: latency.stamp_precise_each(_burst_stamps(s, d), "v", "ack").select("k", "t", F.size("v").cast("long").alias("n"), F.size(F.filter("v", lambda r: r["ack"] == 0)).cast("long").alias("missing"))
)

# ---- market data


def book_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Updates made of lineitem: parts are instruments, a row a level change, every 64th a snapshot, before every 50th one is missing."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    from pyspark.sql import Window as W

    price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("decimal(28,0)") / 100).cast("decimal(38,9)")
    rows = items.select(
        F.col("l_returnflag").alias("venue"), F.concat(F.lit("S"), F.col("l_partkey") % 20).alias("symbol"), nanos(F.col("l_shipdate")).alias("t"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") % 2 == 0, "bid").otherwise("ask").alias("side"), price.alias("price"),
        F.when(F.col("l_linenumber") == 5, 0).otherwise(F.col("l_quantity")).cast("decimal(38,9)").alias("qty"),
    )
    n = F.row_number().over(W.partitionBy("venue", "symbol").orderBy("t", "seq", "price"))
    rows = rows.withColumn("n", n.cast("long")).withColumn("kind", F.when(F.col("n") % 64 == 1, "snapshot").otherwise("delta"))
    level = F.array(F.struct("price", "qty"))
    none = F.slice(level, 1, 0)
    first = F.col("n") + F.when(F.col("n") % 50 == 0, 1).otherwise(0)
    snap = F.col("kind") == "snapshot"
    return rows.select(
        "venue", "symbol", "t", "seq", "kind", first.alias("first"), F.col("n").alias("last"),
        F.when(snap & (F.col("side") == "bid"), level).otherwise(none).alias("bids"), F.when(snap & (F.col("side") == "ask"), level).otherwise(none).alias("asks"),
        F.when(~snap, F.array(F.struct("side", "price", "qty"))).alias("changes"),
    )


def _touch(book: DataFrame) -> DataFrame:
    return book.select(
        "venue", "symbol", "t", "seq", "status", rounded(market.mid()).alias("mid"), rounded(market.spread().cast("double")).alias("spread"), rounded(market.microprice()).alias("microprice"),
        F.size(market.depth("bids", 5)).alias("bid_depth"), market.level_count("asks").alias("ask_levels"),
    )


#: Levels hold from their change to the next one of their price and side, or to the next snapshot; a gap empties the book up to it.
_BOOKS = """WITH u AS (SELECT l_returnflag AS venue, 'S' || (l_partkey % 20) AS symbol, epoch_us(l_shipdate) * 1000 AS t, l_orderkey * 8 + l_linenumber AS seq, l_linenumber % 2 = 0 AS bid,
  floor(l_extendedprice / l_quantity * 100) / 100 AS price, CASE WHEN l_linenumber = 5 THEN 0 ELSE l_quantity END::double AS qty FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY t, seq, price) AS n FROM u),
p AS (SELECT *, (n - 1) // 64 AS epoch FROM n),
g AS (SELECT *, min(CASE WHEN n % 50 = 0 AND n % 64 <> 1 THEN n END) OVER (PARTITION BY venue, symbol, epoch) AS gap FROM p),
live AS (SELECT * FROM g WHERE gap IS NULL OR n <= gap),
lvl AS (SELECT *, coalesce(lead(n) OVER (PARTITION BY venue, symbol, epoch, bid, price ORDER BY n), 1000000000) AS until FROM live WHERE gap IS NULL OR n < gap),
j AS (SELECT a.venue, a.symbol, a.t, a.seq, a.n, a.gap, b.bid, b.price, b.qty FROM live a LEFT JOIN lvl b ON b.venue = a.venue AND b.symbol = a.symbol AND b.epoch = a.epoch AND b.n <= a.n AND a.n < b.until AND b.qty > 0 AND (a.gap IS NULL OR a.n < a.gap)),
top AS (SELECT venue, symbol, t, seq, n, any_value(gap) AS gap, max(price) FILTER (WHERE bid) AS bp, min(price) FILTER (WHERE NOT bid) AS ap, arg_max(qty, price) FILTER (WHERE bid) AS bq, arg_min(qty, price) FILTER (WHERE NOT bid) AS aq,
  count(*) FILTER (WHERE bid) AS nb, count(*) FILTER (WHERE NOT bid) AS na FROM j GROUP BY venue, symbol, t, seq, n),
touch AS (SELECT venue, symbol, t, seq, n, CASE WHEN n = gap THEN 'Gapped' ELSE 'Live' END AS status, round((bp + ap) / 2, 6) AS mid, round(ap - bp, 6) AS spread, round((bp * aq + ap * bq) / (bq + aq), 6) AS microprice,
  least(5, nb)::int AS bid_depth, na::int AS ask_levels FROM top)"""
_TOUCH = "venue, symbol, t, seq, status, mid, spread, microprice, bid_depth, ask_levels"
add("order_book", f"{_BOOKS} SELECT {_TOUCH} FROM touch")(lambda s, d: _touch(market.order_book(book_updates(s, d), 5)))
add("order_book_bursts", f"{_BOOKS} SELECT {_TOUCH} FROM touch QUALIFY row_number() OVER (PARTITION BY venue, symbol, t ORDER BY n DESC) = 1")(lambda s, d: _touch(market.order_book_bursts(book_updates(s, d), 5)))


def _market_events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select(nanos(F.col("ts")).alias("t"), F.col("event_id").alias("seq"), "event_type", "value")
    trade = F.col("event_type").isin("purchase", "signup")
    return e.select("t", "seq", F.when(trade, "trade").otherwise("book").alias("kind"), F.when(trade, F.struct(F.col("event_type").alias("symbol"), F.col("value").alias("price"))).alias("trade"),
                    F.when(~trade, F.struct(F.col("event_type").alias("symbol"), F.col("value").alias("level"))).alias("book"))


add("market_trades", "SELECT epoch_us(ts) * 1000 AS t, event_id AS seq, event_type AS symbol, value AS price FROM events WHERE event_type IN ('purchase', 'signup')")(lambda s, d: market.trades(_market_events(s, d)))
add("market_book_updates", "SELECT epoch_us(ts) * 1000 AS t, event_id AS seq, event_type AS symbol, value AS level FROM events WHERE event_type NOT IN ('purchase', 'signup')")(lambda s, d: market.book_updates(_market_events(s, d)))


def _bursts(spark: SparkSession, sf: str) -> DataFrame:
    e = _market_events(spark, sf).withColumn("t", F.floor(F.col("t") / HOUR) * HOUR)
    return e.groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "kind", "trade", "book"))), lambda x: F.struct(x["kind"].alias("kind"), x["trade"].alias("trade"), x["book"].alias("book"))).alias("v"))


def _burst_sql(kind: str, value: str) -> str:
    return f"SELECT epoch_us(ts) * 1000 // {HOUR} * {HOUR} AS t, count(*) AS n, round(sum(value), 6) AS v, arg_max(value, event_id) AS last FROM events WHERE event_type {kind} IN ('purchase', 'signup') GROUP BY 1"


def _burst_query(kind: str, field: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = market.select_bursts(_bursts(spark, sf), kind, kind)
        return rows.select("t", F.size("v").cast("long").alias("n"), rounded(F.aggregate("v", F.lit(0.0), lambda a, x: a + x[field])).alias("v"), F.element_at("v", -1)[field].alias("last"))

    return run


add("market_trades_bursts", _burst_sql("", "price"))(_burst_query("trade", "price"))
add("market_book_updates_bursts", _burst_sql("NOT", "level"))(_burst_query("book", "level"))


def _socket(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    status = F.col("event_type").isin("purchase", "signup")
    item = F.struct(
        F.col("event_id").alias("seq"), F.when(status, "status").otherwise("message").alias("kind"), F.when(status, F.when(F.col("value") > 50, "open").otherwise("closed")).alias("status"),
        F.col("event_type").alias("topic"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("text"),
    )
    return e.groupBy((F.floor(nanos(F.col("ts")) / HOUR) * HOUR).alias("t")).agg(F.sort_array(F.collect_list(item)).alias("v"))


add("ws_messages", f"SELECT epoch_us(ts) * 1000 // {HOUR} * {HOUR} AS t, count(*) AS n, arg_min(event_type, event_id) AS topic, arg_max(event_type || ':' || event_id, event_id) AS last FROM events WHERE event_type NOT IN ('purchase', 'signup') GROUP BY 1")(
    lambda s, d: market.ws_messages(_socket(s, d)).select("t", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0))["topic"].alias("topic"), F.element_at("v", -1)["text"].alias("last"))
)
add("ws_status", f"SELECT epoch_us(ts) * 1000 // {HOUR} * {HOUR} AS t, CASE WHEN arg_max(value, event_id) > 50 THEN 'open' ELSE 'closed' END AS status FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1")(
    lambda s, d: market.ws_status(_socket(s, d)).select("t", F.col("v").alias("status"))
)

# ---- time-series analysis over daily sums; several series are the five event types


def _series(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).df.groupBy("k", (F.floor(F.col("t") / (6 * HOUR)) * 6 * HOUR).alias("t")).agg(F.sum("v").alias("v"))
    return e.withColumn("seq", F.lit(0).cast("long"))


def _multi(spark: SparkSession, sf: str) -> DataFrame:
    wide = _series(spark, sf).groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("v"))
    return wide.withColumn("seq", F.lit(0).cast("long"))


add("forecast")(lambda s, d: analysis.forecast(_series(s, d), ["k"], 32, 4, (4,)))


def _aligned_sql(window: int) -> str:
    """x(w, i, j, v): value of series j in the i-th sample of the window that ends at sample w, filled forward, then backward; m(w, t, n) the windows."""
    return f"""g AS (SELECT event_type AS k, epoch_us(ts) * 1000 // {6 * HOUR} * {6 * HOUR} AS t, sum(value) AS v FROM events GROUP BY 1, 2),
s AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY k) - 1 AS j, v FROM g),
r AS (SELECT t, row_number() OVER (ORDER BY t) AS i, count(*) AS width FROM s GROUP BY t),
m AS (SELECT w.i AS w, w.t, count(*) AS n, max(o.width) AS width FROM r w JOIN r o ON o.i BETWEEN w.i - {window - 1} AND w.i GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT m.w, o.i, o.t, q.j FROM m JOIN r o ON o.i BETWEEN m.w - {window - 1} AND m.w JOIN (SELECT unnest(range(1000)) AS j) q ON q.j < m.width),
x AS (SELECT c.w, c.i, c.j, coalesce(last_value(s.v IGNORE NULLS) OVER (PARTITION BY c.w, c.j ORDER BY c.i), first_value(s.v IGNORE NULLS) OVER (PARTITION BY c.w, c.j ORDER BY c.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v
      FROM c LEFT JOIN s ON s.t = c.t AND s.j = c.j)"""


#: Dynamic time warping cell by cell, all pairs of all windows together: rows of the matrix are lists from index 0 on.
_DTW = f"""{_aligned_sql(12)},
l AS (SELECT w, j, list(v ORDER BY i) AS v FROM x GROUP BY 1, 2),
d AS (
  SELECT a.w, a.j AS a, b.j AS b, a.v AS x, b.v AS y, len(a.v) AS n, 0 AS c, list_concat([0.0::double], list_transform(a.v, lambda z: 'inf'::double)) AS prev, ['inf'::double] AS cur FROM l a JOIN l b ON a.w = b.w AND a.j < b.j
  UNION ALL
  SELECT w, a, b, x, y, n, c + 1, CASE WHEN c % n = n - 1 THEN list_append(cur, z) ELSE prev END, CASE WHEN c % n = n - 1 THEN ['inf'::double] ELSE list_append(cur, z) END
  FROM (SELECT *, pow(x[c // n + 1] - y[c % n + 1], 2) + least(prev[c % n + 2], cur[c % n + 1], prev[c % n + 1]) AS z FROM d WHERE c < n * n)),
p AS (SELECT m.t, d.w, d.a, d.b, sqrt(d.prev[d.n + 1]) AS d FROM d JOIN m USING (w) WHERE c = d.n * d.n)"""


@add("outlier", f"""WITH {_aligned_sql(16)},
e AS (SELECT *, quantile_cont(v, 0.5) OVER (PARTITION BY w, i) AS mid FROM x),
h AS (SELECT w, j, avg(abs(v - mid)) AS gap FROM e GROUP BY 1, 2),
o AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY w) AS med FROM h),
z AS (SELECT *, quantile_cont(abs(gap - med), 0.5) OVER (PARTITION BY w) AS mad FROM o)
SELECT m.t, coalesce(string_agg(j::varchar, ',' ORDER BY j) FILTER (WHERE 0.6745 * (gap - med) > 3.5 * CASE WHEN mad = 0 THEN 1e-12 ELSE mad END), '') AS outliers FROM z JOIN m USING (w) GROUP BY m.t""")
def outlier(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.outlier(_multi(spark, sf), [], 16).select("t", F.array_join(F.col("outliers").cast("array<string>"), ",").alias("outliers"))


@add("dtw", f"WITH RECURSIVE {_DTW} SELECT t, a::int AS a, b::int AS b, round(d, 6) AS d FROM p")
def dtw(spark: SparkSession, sf: str) -> DataFrame:
    rows = analysis.dtw(_multi(spark, sf), [], 12).select("t", F.posexplode("distances").alias("a", "row"))
    return rows.select("t", "a", F.posexplode("row").alias("b", "d")).where("a < b").select("t", "a", "b", rounded("d").alias("d"))


@add("cluster", f"""WITH RECURSIVE {_DTW},
near AS (SELECT w, a, b FROM p WHERE d <= 150 UNION SELECT w, b, a FROM p WHERE d <= 150),
reach AS (SELECT w, a, a AS b FROM near UNION SELECT r.w, r.a, n.b FROM reach r JOIN near n ON n.w = r.w AND n.a = r.b),
root AS (SELECT w, a, min(b) AS root FROM reach GROUP BY 1, 2),
label AS (SELECT w, a, dense_rank() OVER (PARTITION BY w ORDER BY root) - 1 AS label FROM root)
SELECT m.t, string_agg(coalesce(label.label, -1)::varchar, ',' ORDER BY l.j) AS labels FROM l JOIN m USING (w) LEFT JOIN label ON label.w = m.w AND label.a = l.j WHERE m.width > 1 GROUP BY m.t""")
def cluster(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.cluster(_multi(spark, sf), [], 12, 150.0).select("t", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


add("changepoint")(lambda s, d: analysis.changepoint(_series(s, d), ["k"], 32))
add("seasons")(lambda s, d: analysis.seasons(_series(s, d), ["k"], 32))

# ---- sources and sinks
add("ticker", "SELECT 1000 + i * 250 AS t, true AS v FROM range(5000) r(i)")(lambda s, d: ticks.ticker(s, 250, 5_000, 1_000).df.select("t", "v"))
add("counter", "SELECT i * 100 AS t, i + 1 AS v FROM range(5000) r(i)")(lambda s, d: ticks.counter(s, 100, 5_000).df.select("t", "v"))
add("constant", "SELECT 5::bigint AS t, 7::int AS v")(lambda s, d: ticks.constant(s, 7, 5).df.select("t", "v"))
add("never", "SELECT 0::bigint AS t, 0.0::double AS v WHERE false")(lambda s, d: ticks.never(s).df.select("t", "v"))
add("replay_results", "SELECT * FROM (VALUES (0::bigint, 1.5::double), (10, 2.5), (10, 3.5), (25, NULL)) x(t, v)")(lambda s, d: ticks.values(s, [(0, 1.5), (10, 2.5), (10, 3.5), (25, None)]).df.select("t", "v"))


add("spawn_map", f"WITH {E} SELECT k, t, round(v * 3, 6) AS v FROM e")(lambda s, d: out(events(s, d).spawn_map(lambda v: v * 3)))
add("produce_async", "SELECT i * 7 AS t, (i * i % 101)::double AS v FROM range(20000) r(i)")(lambda s, d: live.produce(s, lambda: ((i * 7, float(i * i % 101)) for i in range(20_000)), "double").df.select("t", "v"))
add("channel", "SELECT i // 3 * 10 AS t, count(*) AS n, sum(i)::bigint AS v, max(i)::bigint AS last FROM range(10000) r(i) GROUP BY 1")(
    lambda s, d: live.channel(s, lambda: ((i // 3 * 10, i) for i in range(10_000)), "bigint").df.select("t", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("v"), F.element_at("v", -1).alias("last"))
)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@add("csv_round_trip", f"WITH {E} SELECT k, t, v FROM e")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    to = _folder(spark, "csv")
    rows = events(spark, sf).df
    files.csv_write(Stream(rows.withColumn("v", F.struct("k", "v"))), to)
    return files.csv_read(spark, to, "time bigint, k string, v double", "time").df.select("v.k", "t", "v.v")


@add("lines_round_trip", "SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) * 10 AS t, event_id || '|' || event_type AS v FROM events")
def lines_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    to = _folder(spark, "lines")
    e = spark.read.parquet(f"{sf}/events.parquet").select(nanos(F.col("ts")).alias("t"), F.col("event_id").alias("seq"), F.concat(F.col("event_id").cast("string"), F.lit("|"), "event_type").alias("v"))
    files.write_lines(Stream(e), to)
    return files.replay_lines(spark, to, 0, 10).df.select("t", "v")


@add("result_cache", "SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1")
def result_cache(spark: SparkSession, sf: str) -> DataFrame:
    to = _folder(spark, "cache")
    make = lambda: spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("event_type").alias("k")).agg(F.count("*").alias("n"))
    files.cached(spark, to, "events by type", make)
    return files.cached(spark, to, "events by type", lambda: make().limit(0))


# ---- scalar helpers
add("kdb_epoch", "SELECT event_id, epoch_us(ts) * 1000 - 946684800000000000 AS v FROM events")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", helpers.to_kdb(nanos(F.col("ts"))).alias("v")))
add("pretty_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(epoch_us(ts) % 1000000 * 1000 AS varchar), 9, '0') AS v FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", helpers.pretty(nanos(F.col("ts"))).alias("v"))
)
add("time_window", f"WITH {E} SELECT k, t, v FROM e WHERE t >= 1704067200000000000 AND t < 1704067200000000000 + {3 * DAY}")(
    lambda s, d: out(Stream(events(s, d).df.where(helpers.within(F.col("t"), 1704067200000000000, 1704067200000000000 + 3 * DAY)), ("k",)))
)
add("fix_fields", "SELECT event_id, event_type AS symbol, cast(value AS varchar) AS price, 2 AS parties, 'b' || event_id AS second FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet")
    .withColumn("m", F.concat(F.lit("8=FIX.4.4\x0135=D\x0155="), "event_type", F.lit("\x0144="), F.col("value").cast("string"), F.lit("\x01453=2\x01448=a\x01447=D\x01448=b"), F.col("event_id").cast("string"), F.lit("\x01447=D\x01")))
    .select("event_id", helpers.fix_field(F.col("m"), 55).alias("symbol"), helpers.fix_field(F.col("m"), 44).alias("price"), helpers.fix_group_count(F.col("m"), 453).alias("parties"),
            helpers.fix_field(F.concat(F.lit(""), F.get(helpers.fix_groups(F.col("m"), 453, 448), F.lit(1))), 448).alias("second"))
)
add("envelope", "SELECT event_id, event_type AS topic, value AS v FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet")
    .select("event_id", helpers.from_envelope(helpers.envelope(F.col("event_type"), nanos(F.col("ts")), F.col("value")), "double").alias("m"))
    .select("event_id", F.col("m.topic").alias("topic"), F.col("m.payload").alias("v"))
)
add("fixed_point", "SELECT o_orderkey, cast(o_totalprice AS double) AS v FROM orders")(
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", helpers.fixed(F.col("o_totalprice").cast("string")).cast("double").alias("v"))
)


@add("flagship", f"""WITH {E}, s AS (SELECT k, t, seq, avg(v) OVER w AS mean, coalesce(stddev_samp(v) OVER w, 0) AS std, min(v) OVER w AS lo, max(v) OVER w AS hi FROM e
 WINDOW w AS (PARTITION BY k ORDER BY t, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
 SELECT k, t // {HOUR} * {HOUR} + {HOUR} AS t, round(arg_max(mean, seq), 6) AS mean, round(arg_max(std, seq), 6) AS std, arg_max(lo, seq) AS lo, arg_max(hi, seq) AS hi FROM s GROUP BY 1, 2""")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling mean, deviation, minimum and maximum of ten ticks, as they stand at the end of each hour with ticks."""
    rows = stats.statistics(events(spark, sf).df, ["k"], ["mean", "std", "min", "max"], Span.count(10))
    hour = (F.floor(F.col("t") / HOUR) * HOUR + HOUR).alias("t")
    last = F.max_by(F.struct("mean", "std", "min", "max"), "seq").alias("s")
    return rows.groupBy("k", hour).agg(last).select("k", "t", rounded("s.mean").alias("mean"), rounded("s.std").alias("std"), F.col("s.min").alias("lo"), F.col("s.max").alias("hi"))


def queries():
    return QUERIES


def oracle_sql():
    return ORACLE
