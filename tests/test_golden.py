"""Golden vectors of values and tick times."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempoweir.functions import helpers
from tempoweir.operators import analysis, keyed, latency, market
from tempoweir.sources import files
from tempoweir.sources.ticks import constant, counter, never, ticker, values
from tempoweir.stream import Span, Stream, bounded


def only(s):
    return [v for _, v in s.collect()]


def series(spark, xs, kind="double", step=100):
    return values(spark, [(i * step, x) for i, x in enumerate(xs)], kind)


def close(a, b):
    assert len(a) == len(b) and all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a, b)), (a, b)


def test_row_and_frame_ops(spark):
    assert only(series(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2], "long").distinct()) == [0, 1, 2]
    assert len(only(series(spark, [float("nan")] * 3).distinct())) == 3
    assert series(spark, [100.0, 100.005, 100.02, 100.025]).drop_small_change(lambda a, b: abs(a - b) < 0.01).collect() == [(0, 100.0), (200, 100.02)]
    n = counter(spark, 100, 4)
    assert only(n.difference()) == [1, 1, 1]
    assert [tuple(v) for v in only(n.pairwise())] == [(1, 2), (2, 3), (3, 4)]
    assert only(counter(spark, 1, 9).limit(3)) == [1, 2, 3]
    assert only(counter(spark, 1, 4).skip(3)) == [4]
    assert only(counter(spark, 1, 6).take_while(lambda v: v % 4 != 0)) == [1, 2, 3]
    assert only(counter(spark, 1, 3).accumulate()) == [[1], [1, 2], [1, 2, 3]]
    assert only(never(spark)) == [] and only(constant(spark, 7)) == [7]


def test_windows(spark):
    s = counter(spark, 100, 9)
    assert s.window(250, flush=True).collect() == [(300, [1, 2, 3]), (500, [4, 5]), (800, [6, 7, 8])]
    assert only(counter(spark, 100, 9, 1000).window(250, flush=True)) == [[1, 2, 3], [4, 5], [6, 7, 8]]
    assert only(counter(spark, 100, 4).window(0)) == [[1], [2], [3]]
    assert only(counter(spark, 1, 5).buffer(2)) == [[1, 2], [3, 4]]
    assert only(counter(spark, 1, 5).buffer(2, flush=True)) == [[1, 2], [3, 4], [5]]


def test_rolling(spark):
    s = counter(spark, 100, 5, kind="double")
    close(only(s.sum(Span.count(3))), [1, 3, 6, 9, 12])
    close(only(s.mean(Span.count(3))), [1, 1.5, 2, 3, 4])
    close(only(s.min(Span.count(2))), [1, 1, 2, 3, 4])
    odd = series(spark, [float((n * 7) % 13) for n in range(1, 9)])
    close(only(odd.min(Span.count(3))), [7, 1, 1, 1, 2, 2, 3, 3])
    close(only(odd.max(Span.count(3))), [7, 7, 8, 8, 9, 9, 10, 10])
    close(only(odd.limit(5).median(Span.count(3))), [7, 4, 7, 2, 8])
    close(only(s.variance(Span.count(0))), [0] * 5)
    close(only(s.variance()), [0, 0.5, 1, 5 / 3, 2.5])
    close(only(s.median()), [1, 1.5, 2, 2.5, 3])
    close(only(s.sum(Span.nanos(250))), [1, 3, 6, 9, 12])
    close(only(s.mean(Span.nanos(250))), [1, 1.5, 2, 3, 4])
    close(only(counter(spark, 10**9, 6, kind="double").mean(Span.seconds(3))), [1, 1.5, 2, 2.5, 3.5, 4.5])


def test_time_weighted(spark):
    s = counter(spark, 100, 5, kind="double")
    for span, mean, var in (
        (Span(), [1, 1, 1.5, 2, 2.5], [0, 0, 0.25, 2 / 3, 1.25]),
        (Span.count(4), [1, 1, 1.5, 2, 3], [0, 0, 0.25, 2 / 3, 2 / 3]),
        (Span.nanos(250), [1, 1, 1.5, 2.5, 3.5], [0, 0, 0.25, 0.25, 0.25]),
    ):
        close(only(s.mean(span, True)), mean)
        close(only(s.variance(span, True)), var)
        close(only(s.median(span, True)), mean)
    close(only(s.mean(Span.count(1), True)), [1, 2, 3, 4, 5])
    close(only(s.std(Span.count(1), True)), [0] * 5)


def test_ewma_and_folds(spark):
    close(only(series(spark, [1.0, 2.0, 3.0, 4.0]).ewma_per_tick(0.5)), [1, 1.5, 2.25, 3.125])
    close(only(series(spark, [1.0, 2.0, 3.0, 4.0]).ewma_half_life(100)), [1, 1.5, 2.25, 3.125])
    close(only(series(spark, [0.0, 0.0, 5.0]).ewma_per_tick(0.5)), [0, 0, 2.5])
    close(only(series(spark, [1.0, 5.0]).ewma_half_life(0)), [1, 5])
    assert only(counter(spark, 1, 4).fold(0, lambda a, v: a + v, "long")) == [1, 3, 6, 10]
    assert only(counter(spark, 1, 3).reduce(lambda a, v: a * v)) == [1, 2, 6]
    assert only(series(spark, [1], "long").feedback(1, lambda x: 2 * x, 5)) == [1, 2, 4, 8, 16]
    assert [t for t, _ in counter(spark, 100, 8).throttle(250).collect()] == [0, 300, 600]


def test_joins(spark):
    n = counter(spark, 100, 3)
    assert only(n.join(n.map(lambda v: v * 2, 0), lambda a, b: a + b)) == [3, 6, 9]
    src, cond = bounded([counter(spark, 100, 20), ticker(spark, 30, 20)], cycles=10)
    assert src.filter_value(lambda v: v >= 2).filter(cond).collect() == [(100, 2), (120, 2), (150, 2), (180, 2), (200, 3), (210, 3)]
    fast, slow = counter(spark, 10, 6), counter(spark, 30, 2).map(lambda v: v + 100)
    assert only(Stream.combine([fast, slow])) == [[1, 101], [2], [3], [4, 102], [5], [6]]
    assert only(fast.merge(fast.map(lambda v: -v))) == [1, 2, 3, 4, 5, 6]
    assert [v for v in only(constant(spark, 7).sample(ticker(spark, 100, 3)))] == [7, 7, 7]
    rows = Stream.build_dataframe({"a": counter(spark, 100, 3), "b": counter(spark, 200, 2)}).orderBy("t").collect()
    assert [(r.t, r.a, r.b) for r in rows] == [(0, 1, 1), (100, 2, None), (200, 3, 2)]
    with pytest.raises(Exception, match="broken"):
        n.try_map(lambda v: v, lambda v: v > 2, "broken").collect()


def test_bounds_and_delays(spark):
    assert len(bounded([counter(spark, 100, 50)], duration=305)[0].collect()) == 6
    late = counter(spark, 10, 40).delay(100)
    assert only(bounded([counter(spark, 10, 40), late], duration=120)[1]) == [1, 2, 3, 4]
    made = counter(spark, 100, 12).delay_with_reset(500, counter(spark, 1000, 2)).collect()
    assert made == [(0, 1), (600, 2), (700, 3), (800, 4), (900, 5), (1000, 11), (1600, 12)]


def test_keyed(spark):
    rows = [(i, i, k, c) for i, (k, c) in enumerate([(1, False), (2, False), (3, False), (1, True), (4, False), (2, False), (3, False)])]
    got = keyed.demux_map(spark.createDataFrame(rows, "t long, seq long, item int, close boolean"), 2).orderBy("t").collect()
    assert [(r.item, r.slot) for r in got] == [(1, 0), (2, 1), (3, 2), (1, 0), (4, 0), (2, 1), (3, 2)]
    assert {(r.child, r.v) for r in counter(spark, 1, 4).demux(2, lambda v: v - 1).df.collect()} == {(0, 1), (1, 2), (2, 3), (2, 4)}


UPDATE = "venue string, symbol string, t bigint, seq bigint, kind string, first bigint, last bigint, bids array<struct<price: decimal(38,9), qty: decimal(38,9)>>, asks array<struct<price: decimal(38,9), qty: decimal(38,9)>>, changes array<struct<side: string, price: decimal(38,9), qty: decimal(38,9)>>"


def _level(p, q):
    return {"price": Decimal(p), "qty": Decimal(q)}


def test_order_book(spark):
    snap = lambda t, n: ("x", "A", t, 0, "snapshot", n, n, [_level(100, 1)], [_level(102, 1)], None)
    delta = lambda t, n, side, p, q: ("x", "A", t, 0, "delta", n, n, None, None, [{"side": side, **_level(p, q)}])
    rows = [snap(100, None), delta(200, None, "bid", 101, 1), delta(300, None, "ask", 102, 0)]
    got = market.order_book(spark.createDataFrame(rows, UPDATE)).select("t", market.mid().alias("m")).orderBy("t").collect()
    assert [(r.t, r.m) for r in got] == [(100, 101.0), (200, 101.5), (300, None)]
    rows = [snap(100, 10), delta(200, 13, "bid", 101, 1), delta(300, 14, "bid", 101, 1), snap(400, 20)]
    got = market.order_book(spark.createDataFrame(rows, UPDATE)).orderBy("t").collect()
    assert [(r.t, r.status) for r in got] == [(100, "Live"), (200, "Gapped"), (400, "Live")]
    rows = [snap(100, None)] + [("x", "A", 200, i, "delta", None, None, None, None, [{"side": "bid", **_level(p, 1)}]) for i, p in enumerate(("100.25", "100.5", "100.75"))]
    got = market.order_book_bursts(spark.createDataFrame(rows, UPDATE)).orderBy("t").collect()
    assert len(got) == 2 and float(got[1].bids[0].price) == 100.75 and len(got[1].bids) == 4


def test_latency(spark):
    rows = [(10, 20), (10, 10), (20, 10), (0, 10), (None, 10)]
    got = latency.hops(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], []).select("class").collect()
    assert [r[0] for r in got] == ["measured", "same_instant", "backwards", "unstamped", "unstamped"]


def test_analysis():
    y = np.concatenate([np.zeros(40), np.full(40, 8.0)]) + 0.1 * np.sin(np.arange(80))
    assert any(abs(i - 40) <= 2 for i in analysis.change_points(y))
    assert 12 in analysis.season_lengths(np.sin(2 * np.pi * np.arange(120) / 12))
    point, half = analysis.ets(np.arange(30.0), 3, 1.96)
    assert np.allclose(point, [30, 31, 32], atol=0.1) and (half < 1).all()
    x = np.array([[0, 1, 2, 3], [0, 1, 2, 3.1], [9, 9, 9, 9.0]])
    assert analysis.dbscan(analysis.dtw_matrix(x), 0.5, 2) == [0, 0, -1]
    assert analysis.mad_outliers(np.vstack([x[:2], x[:1] + 0.05, x[2:]])) == [3]


def test_helpers(spark):
    assert helpers.time_slices(5, 25, 10) == [(5, 10), (10, 20), (20, 25)]
    assert helpers.quote_table('a.b"c') == '"a"."b""c"'
    m = F.lit("8=FIX.4.4\x0155=A\x01453=2\x01448=x\x01447=D\x01448=y\x01447=E\x01")
    row = spark.range(1).select(helpers.fix_field(m, 55).alias("s"), helpers.fix_groups(m, 453, 448).alias("g"), helpers.pretty(F.lit(1_000_000_001)).alias("p")).first()
    assert row.s == "A" and len(row.g) == 2 and row.g[1].startswith("448=y") and row.p == "1970-01-01T00:00:01.000000001"


def test_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text("1001,1\n1002,2\n1003,3\n1003,4\n1004,5\n")
    s = files.csv_read(spark, str(tmp_path / "q.csv"), "time bigint, x int", "time")
    packed = Stream.combine([s]).collect()
    assert [(t, [r.x for r in v]) for t, v in packed] == [(1001, [1]), (1002, [2]), (1003, [3, 4]), (1004, [5])]
    files.csv_write(s, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out")).count() == 5
    (tmp_path / "l.txt").write_text("a\nb\nc\n")
    assert files.replay_lines(spark, str(tmp_path / "l.txt"), 10, 5).collect() == [(10, "a"), (15, "b"), (20, "c")]
    made = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path), "q", lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
