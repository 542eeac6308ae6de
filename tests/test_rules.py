"""Rules for nulls, ties, late rows and empty inputs; taps, sinks, stamps and groups; costs of long keys."""

import logging
import math
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tempoweir.operators import kernels, keyed, latency, market
from tempoweir.sources import files
from tempoweir.sources.ticks import counter, values
from tempoweir.stream import Decay, Span, Stream
from tempoweir.streaming import state


def only(s):
    return [v for _, v in s.collect()]


def plain(spark, xs, kind="double"):
    return values(spark, [(i * 100, x) for i, x in enumerate(xs)], kind)


XS = [None, 4.0, None, 2.0, 8.0]


def test_null_ticks(spark):
    s = plain(spark, XS)
    assert only(s.ewma_per_tick(0.5)) == [None, 4.0, 4.0, 3.0, 5.5]
    assert only(s.ewma(Decay.half_life(100))) == [None, 4.0, 4.0, 2.5, 5.25]
    assert only(s.median()) == [None, 4.0, 4.0, 3.0, 4.0]
    assert only(s.median(Span.count(3))) == [None, 4.0, 4.0, 3.0, 5.0]
    assert only(s.median(Span.nanos(200))) == [None, 4.0, 4.0, 3.0, 5.0]
    assert only(s.median(time_weighting=True)) == [None, 4.0, 4.0, 4.0, 4.0]
    assert only(s.fold(1.0, lambda a, x: a + x, "double")) == [1.0, 5.0, 5.0, 7.0, 15.0]
    assert only(s.reduce(lambda a, x: a + x)) == [None, 4.0, 4.0, 6.0, 14.0]
    assert only(s.throttle(200)) == [None, None, 8.0]
    assert only(s.drop_small_change(lambda a, b: abs(a - b) < 3)) == XS
    assert only(s.sum()) == [None, 4.0, 4.0, 6.0, 14.0]


def test_medians_skip_nan(spark):
    nan = float("nan")
    assert only(plain(spark, [1.0, nan, 3.0]).median()) == [1.0, 1.0, 2.0]
    assert only(plain(spark, [nan, 1.0, 3.0]).median(Span.count(2))) == [None, 1.0, 2.0]


def test_empty_streams(spark):
    s = plain(spark, [])
    for made in (s.median(), s.median(Span.count(2), True), s.ewma_per_tick(0.1), s.throttle(5), s.fold(0.0, lambda a, x: a, "double"), s.join(s, lambda a, b: a + b), s.window(5), s.custom_node([s], (True, True), kernels.RunningMedian, "double")):
        assert made.collect() == []
    assert market.order_book(spark.createDataFrame([], UPDATE)).count() == 0
    assert latency.latency_report(spark.createDataFrame([], "a long, b long"), ["a", "b"]).count() == 0


def test_ties(spark):
    """The last of several ticks of one input at an instant is held; time spans hold the whole instant, count spans do not."""
    a, b = values(spark, [(10, 1.0), (10, 2.0), (20, 3.0)], seed=0.0), values(spark, [(10, 10.0), (15, 20.0)], seed=0.0)
    assert a.join(b, lambda x, y: x + y).collect() == [(10, 12.0), (15, 22.0), (20, 23.0)]
    assert a.join_passive(b, lambda x, y: x + y).collect() == [(10, 12.0), (20, 23.0)]
    assert b.sample(a).collect() == [(10, 10.0), (20, 20.0)]
    assert only(a.sum(Span.nanos(5))) == [3.0, 3.0, 3.0] and only(a.median(Span.nanos(5))) == [1.5, 1.5, 3.0]
    assert only(a.median(Span.count(2))) == [1.0, 1.5, 2.5]


def test_fan(spark):
    s = values(spark, [(0, 1.0), (0, 2.0), (10, 3.0), (20, 4.0)])
    odd = lambda x, i: x.filter_value(lambda v: v % 2 == 1) if i == 0 else x.map(lambda v: v * 10)
    assert s.fan(2, odd).df.orderBy("t", "seq").select("t", "seq", "v").collect() == [(0, 0, 1.0), (0, 1, 20.0), (10, 2, 3.0), (20, 3, 40.0)]
    # what comes from another tick competes with all of its instant
    assert s.fan(2, lambda x, i: x.delay(10) if i else x).collect() == [(0, 1.0), (0, 2.0), (10, 3.0), (20, 4.0), (30, 4.0)]
    assert s.fan(2, lambda x, i: x if i else x.delay(10)).collect() == [(0, 1.0), (0, 2.0), (10, 1.0), (10, 2.0), (20, 3.0), (30, 4.0)]


def test_late_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("10,a\n30,b\n20,c\n")
    with pytest.raises(PySparkException, match="time 20 after 30"):
        files.csv_read(spark, str(tmp_path), "t long, v string", "t").collect()
    assert [v.v for v in only(files.csv_read(spark, str(tmp_path), "t long, v string", "t", late="sort"))] == ["a", "c", "b"]


def test_late_rows_of_streams(spark, tmp_path):
    for i, ts in enumerate([(10, 20), (15, 30)]):
        spark.createDataFrame([("k", t, 0, 1.0) for t in ts], "k string, t long, seq long, v double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    src = spark.readStream.schema("k string, t long, seq long, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="time 15 after 20"):
        state.run_available(state.stateful(src, "k", kernels.ewma(alpha=0.5)), "late", str(tmp_path / "cp"))


@pytest.mark.parametrize("make", [kernels.running_median, lambda: kernels.weighted_median(span=250), lambda: kernels.window_median(3), lambda: kernels.fold(0.0, lambda a, x: a + x)], ids=["median", "weighted", "window", "fold"])
def test_streamed_kernels(spark, tmp_path, make):
    rows = [(k, i * 100, i, float((i * 7 + len(k)) % 11)) for k in ("a", "bb") for i in range(30)]
    shape = "k string, t long, seq long, v double"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 10 == part], shape).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    src = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = state.run_available(state.stateful(src, "k", make()), f"s{abs(hash(str(tmp_path)))}", str(tmp_path / "cp"))
    want = Stream(spark.createDataFrame(rows, shape), ("k",))._run(make(), "double").df
    assert sorted(map(tuple, got.select("k", "t", "v").collect())) == sorted(map(tuple, want.select("k", "t", "v").collect()))


def test_tumbling_stream(spark, tmp_path):
    shape = "k string, t long, seq long, v double"
    second = 10**9
    spark.createDataFrame([("a", i * second, i, float(i)) for i in range(10)], shape).coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    spark.createDataFrame([("a", 100 * second, 0, 0.0)], shape).coalesce(1).write.parquet(str(tmp_path / "in" / "p1"))
    src = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = state.run_available(state.tumbling(src, "k", 4 * second), f"t{abs(hash(str(tmp_path)))}", str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == [("a", 4 * second, 4, 6.0, 0.0, 3.0), ("a", 8 * second, 4, 22.0, 4.0, 7.0), ("a", 12 * second, 2, 17.0, 8.0, 9.0)]


def test_try_forms_abort(spark):
    a, b = plain(spark, [1.0, 2.0]), plain(spark, [3.0, -1.0])
    for made in (
        a.try_join(b, lambda x, y: x + y, lambda x, y: y < 0), a.try_bimap(b, lambda x, y: x + y, lambda x, y: y < 0), a.try_join_passive(b, lambda x, y: x + y, lambda x, y: y < 0),
        a.try_join3(b, b, lambda x, y, z: x, lambda x, y, z: z < 0), a.try_trimap(b, b, lambda x, y, z: x, lambda x, y, z: y < 0),
    ):
        with pytest.raises(PySparkException, match="failed"):
            made.collect()


def test_taps_and_sinks(spark, tmp_path, capsys, caplog):
    n = counter(spark, 100, 4)
    seen = []
    assert n.inspect(lambda df: seen.append(df.count())) is n and seen == [4]
    n.print()
    assert "|300|0" in capsys.readouterr().out.replace(" ", "")
    timed, watch = n.timed("ticks of n")
    assert len(timed.df.collect()) == 4 and watch.get == {"ticks": 4, "first": 0, "last": 300}
    assert only(n.logged("n")) == [1, 2, 3, 4]
    assert only(n.logged("n", logging.CRITICAL + 1)) == [1, 2, 3, 4]
    last = []
    assert n.finally_(last.append) == 4 and last == [4]
    broken = n.try_map(lambda v: v, lambda v: v > 2)
    with pytest.raises(PySparkException):
        broken.finally_(last.append)
    assert last == [4, None]
    to = str(tmp_path / "rows")
    def put(row):
        with open(to + str(row.t), "w") as f:
            f.write(str(row.v))
    n.for_each(put)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["rows0", "rows100", "rows200", "rows300"]
    files.write_lines(n, str(tmp_path / "lines"))
    files.write_lines(n, str(tmp_path / "lines"), append=True)
    assert sorted(only(files.replay_lines(spark, str(tmp_path / "lines")))) == ["1", "1", "2", "2", "3", "3", "4", "4"]
    tail = files.tail_lines(spark, str(tmp_path / "lines"))
    assert tail.isStreaming and state.run_available(tail, "tail", str(tmp_path / "cp")).count() == 8
    assert files.jdbc_predicates("at", 0, 2 * 10**9, 10**9) == ["at >= to_timestamp(0) + interval '0 microseconds' AND at < to_timestamp(1) + interval '0 microseconds'", "at >= to_timestamp(1) + interval '0 microseconds' AND at < to_timestamp(2) + interval '0 microseconds'"]


def test_custom_kernels(spark):
    class Last:
        held = None

        def run(self, times, values):
            at = [i for i, x in enumerate(values) if x["tick1"]]
            return at, [values[i]["v0"] * 10 + values[i]["v1"] for i in at]

    a, b = values(spark, [(0, 1.0), (10, 2.0)], seed=0.0), values(spark, [(5, 3.0), (10, 4.0)], seed=0.0)
    assert a.custom_node([b], (True, True), Last, "double").collect() == [(5, 13.0), (10, 24.0)]

    def every_other():
        n = 0

        def step(row):
            nonlocal n
            n += 1
            if n % 2:
                yield row

        return step

    assert only(counter(spark, 1, 5).custom(every_other, "long")) == [1, 3, 5]


def test_groups(spark):
    rows = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 1, 2.0), ("a", 5, 0, 3.0), ("b", 7, 0, 4.0), ("a", 9, 0, 5.0)], "k string, t long, seq long, v double")
    lives = spark.createDataFrame([("a", 0, 9), ("b", 1, None)], "k string, added long, removed long")
    got = keyed.dynamic_group_fold(rows, lives, "k", 0.0, lambda acc, k, v: acc + v, lambda acc, k: -acc, "double")
    assert sorted((r.t, r.v) for r in got.collect()) == [(0, 1.0), (5, 4.0), (7, 8.0), (9, -8.0)]


def test_stamps(spark):
    rows = spark.createDataFrame([(5, 0, [(1, 0), (2, 9)]), (6, 7, None)], "a long, b long, v array<struct<x: long, y: long>>")
    ticks = iter(range(100, 200))
    assert [(r.a, r.b) for r in latency.stamp(rows, "b", F.lit(3).cast("long")).collect()] == [(5, 3), (6, 7)]
    assert [r.c for r in latency.stamp_all(rows, ["b", "c"], F.lit(3).cast("long")).collect()] == [3, 3]
    before = time.time_ns()
    got = latency.stamp_precise(rows, "b").collect()
    assert before <= got[0].b <= time.time_ns() and got[1].b == 7
    assert latency.stamp_precise(rows.coalesce(1), "b", lambda: next(ticks)).first().b == 100
    assert [r.v for r in latency.stamp_each(rows, "v", "y", F.lit(4).cast("long")).collect()] == [[(1, 4), (2, 9)], None]
    got = latency.stamp_precise_each(rows, "v", "y").collect()
    assert got[0].v[0].y >= before and got[0].v[1].y == 9 and got[1].v is None


def test_histogram_is_close(spark):
    ns = [i * i * 37 for i in range(1, 4_000)]
    rows = spark.createDataFrame([(1, 1 + x) for x in ns], "a long, b long")
    r = latency.latency_report(rows, ["a", "b"]).first()
    for q, got in ((0.5, r.p50_ns), (0.99, r.p99_ns), (0.999, r.p999_ns)):
        exact = sorted(ns)[math.ceil(q * len(ns)) - 1]
        assert exact <= got <= exact * 1.03125
    assert (r.n, r.min_ns, r.max_ns) == (len(ns), ns[0], ns[-1])


UPDATE = "venue string, symbol string, t long, seq long, kind string, first long, last long, bids array<struct<price: decimal(38,9), qty: decimal(38,9)>>, asks array<struct<price: decimal(38,9), qty: decimal(38,9)>>, changes array<struct<side: string, price: decimal(38,9), qty: decimal(38,9)>>"


def test_books_of_large_numbers(spark):
    """Prices beyond 64 bits, empty lists, null lists, sequence numbers that are absent, stale rows and a gap."""
    from decimal import Decimal as D

    big = D(10) ** 20
    rows = [
        ("v", "s", 1, 0, "delta", 1, 1, None, None, [("bid", D(3), D(1))]), ("v", "s", 2, 0, "snapshot", 1, 1, [(big, D(2)), (D(1), D(0))], [], None), ("v", "s", 2, 1, "delta", 2, 2, None, None, [("ask", big + 1, D(5)), ("bid", D(7), D("0.000000001"))]),
        ("v", "s", 3, 0, "delta", 2, 2, None, None, [("bid", D(9), D(9))]), ("v", "s", 4, 0, "delta", 5, 5, None, None, []), ("v", "s", 5, 0, "delta", 6, 6, None, None, []), ("v", "s", 6, 0, "snapshot", None, None, None, [(D(4), D(4))], None),
    ]
    df = spark.createDataFrame(rows, UPDATE)
    got = [(r.t, r.seq, r.status, r.last_seq, [tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in market.order_book(df).orderBy("t", "seq").collect()]
    bids = [(big, D(2)), (D(7), D("0.000000001"))]
    assert got == [(2, 0, "Live", 1, [(big, D(2))], []), (2, 1, "Live", 2, bids, [(big + 1, D(5))]), (4, 0, "Gapped", None, [], []), (6, 0, "Live", None, [], [(D(4), D(4))])]
    one = [(r.t, r.seq, len(r.bids), r.bid_levels) for r in market.order_book_bursts(df, 1).orderBy("t").collect()]
    assert one == [(2, 1, 1, 2), (4, 0, 0, 0), (6, 0, 0, 0)]
    levels = market.order_book(df).select("t", market.level_count("bids").alias("n"), market.microprice().alias("m")).where("t = 2").orderBy("n").collect()
    assert [r.n for r in levels] == [1, 2] and math.isclose(levels[1].m, 1e20)


def test_long_keys_stay_cheap(spark):
    """100 000 ticks of one key; a quadratic kernel takes minutes here."""
    df = spark.range(100_000).select((F.col("id") * 1_000).alias("t"), F.lit(0).cast("long").alias("seq"), (F.hash("id") % 10_000).cast("double").alias("v"))
    s = Stream(df)
    for made in (s.median(), s.median(time_weighting=True), s.median(Span.nanos(10**11)), s.median(Span.nanos(5 * 10**7), True), s.ewma_per_tick(0.1), s.throttle(5_000)):
        began = time.perf_counter()
        made.df.write.format("noop").mode("overwrite").save()
        assert time.perf_counter() - began < 30


def test_variance_of_long_spans_stays_cheap(spark):
    """200 000 ticks of one key, half of them in the span: a frame would add up 15 thousand million samples."""
    s = counter(spark, 10, 200_000, kind="double").map(lambda v: v % 97)
    begin = time.monotonic()
    last = s.variance(Span.nanos(1_000_000)).df.orderBy(F.desc("t")).first()["v"]
    assert time.monotonic() - begin < 60
    assert last == pytest.approx(np.var((np.arange(99_999, 200_000) + 1) % 97, ddof=1), rel=1e-12)


def test_variance_of_spans_by_brute_force(spark):
    """Ticks of one instant, null, NaN, large and timeless ones, over several batches of rows."""
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 3_000, 900))
    v = [None if i % 11 == 0 else float(rng.normal() * (1e9 if i == 400 else 1)) for i in range(900)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        for span in (0, 40, 500, 5_000):
            s = values(spark, list(zip(t.tolist(), v, strict=True)))
            for got, root in ((s.variance(Span.nanos(span)), False), (s.std(Span.nanos(span)), True)):
                for (at, have), now in zip(got.collect(), t, strict=True):
                    held = [x for x, u in zip(v, t, strict=True) if now - span <= u <= now and x is not None]
                    want = np.var(held, ddof=1) if len(held) > 1 else 0.0
                    assert at == now and have == pytest.approx(np.sqrt(want) if root else want, rel=1e-9)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    odd = values(spark, [(0, float("nan")), (5, 1.0), (20, 2.0), (21, 4.0), (None, 1.0), (None, 3.0)]).variance(Span.nanos(10)).df.orderBy("seq").collect()
    assert [r["v"] for r in odd[:1] + odd[2:]] == [0.0, 0.0, 2.0, 2.0, 2.0] and math.isnan(odd[1]["v"])


def test_seasons_and_forms_of_forecasts():
    from tempoweir.operators import analysis

    t = np.arange(96)
    two = 10 + 0.2 * t + 3 * np.sin(2 * np.pi * t / 4) + 5 * np.cos(2 * np.pi * t / 12)
    parts = analysis.mstl(two, (12, 4, 400))
    assert sorted(parts) == [4, 12] and np.abs(two - sum(parts.values()) - (10 + 0.2 * t)).max() < 0.5
    noise = np.random.default_rng(2).standard_normal(96)
    flat, _ = analysis.ets(5 + noise, 6, 1.96)
    assert np.ptp(flat) < 0.3 and abs(flat[0] - 5) < 0.7
    rising, half = analysis.ets(0.5 * t + 0.1 * noise, 6, 1.96)
    assert np.allclose(rising, 0.5 * (96 + np.arange(6)), atol=0.5) and (np.diff(half) > 0).all()
    assert np.allclose(analysis.ets(np.full(12, 3.0), 2, 1.96)[0], 3)
    assert np.allclose(analysis.loess(t.astype(float), 2.0 * t, t + 0.5, 11), 2 * t + 1)


def test_forecasts_follow_seasons(spark):
    t = np.arange(64)
    y = 20 + 0.1 * t + 4 * np.sin(2 * np.pi * t / 8)
    from tempoweir.operators import analysis

    rows = plain(spark, y.tolist()).df
    last = analysis.forecast(rows, [], 64, 8, (8,)).orderBy(F.desc("t")).first()
    ahead = np.arange(64, 72)
    assert np.abs(np.array(last.point) - (20 + 0.1 * ahead + 4 * np.sin(2 * np.pi * ahead / 8))).max() < 0.6
    assert all(a <= p <= b for a, p, b in zip(last.lower, last.point, last.upper))
    assert analysis.forecast(rows.limit(11), [], 64, 2).count() == 0


def test_null_samples_of_analysis(spark):
    from tempoweir.operators import analysis

    s = plain(spark, [None, *[float(i % 4) for i in range(40)], None]).df
    assert analysis.seasons(s, [], 32).count() > 0 and analysis.changepoint(s, [], 32).count() > 0 and analysis.forecast(s, [], 32, 2).count() > 0
