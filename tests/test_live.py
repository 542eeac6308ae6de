"""Sources that are fed while a run goes on, and the cache of results."""

import time

import pytest

from tempoweir.sources import files, live
from tempoweir.streaming import state


def until(query, done, seconds=60):
    end = time.time() + seconds
    try:
        while not done() and time.time() < end:
            assert query.isActive, query.exception()
            time.sleep(0.3)
        return done()
    finally:
        query.stop()


def test_producers(spark):
    s = live.produce(spark, lambda: [(1, 2.0), (1, 3.0), (9, None)], "double")
    assert s.collect() == [(1, 2.0), (1, 3.0), (9, None)] and live.produce(spark, lambda: [], "string").collect() == []
    with pytest.raises(Exception, match="time 3 after 5"):
        live.produce(spark, lambda: [(5, 1), (3, 1)], "int").collect()

    def broken():
        yield 1, 1
        raise OSError("line is down")

    with pytest.raises(Exception, match="line is down"):
        live.produce(spark, broken, "int").collect()
    assert live.channel(spark, lambda: [(1, "a"), (1, "b"), (2, "c")], "string").collect() == [(1, ["a", "b"]), (2, ["c"])]


def test_poll(spark, tmp_path):
    marks = iter(range(1_000_000))
    query = live.poll(spark, lambda: next(marks), "int").writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path)).start()
    rows = lambda: spark.table("polled").orderBy("seq").collect()
    assert until(query, lambda: len(rows()) > 2)
    got = rows()
    assert [r.v for r in got] == list(range(len(got))) and [r.t for r in got] == sorted(r.t for r in got)


def test_growing_file(spark, tmp_path):
    file, rows = tmp_path / "x.log", lambda: [r.value for r in spark.table("tailed").orderBy("offset").collect()]
    query = live.tail_file(spark, str(file), 8).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    file.write_text("one\r\ntwo\nthr")
    try:
        end = time.time() + 60
        while rows() != ["one", "two"] and time.time() < end:
            time.sleep(0.3)
        assert rows() == ["one", "two"]
        with open(file, "a") as f:
            f.write("ee and a long line\nfour")
    finally:
        assert until(query, lambda: rows() == ["one", "two", "three and a long line"])


def test_pushes(spark, tmp_path):
    rows, source = live.external(spark, str(tmp_path / "in"), "int")
    source.push(1, 2)
    source.push(3)
    assert sorted(r.v for r in state.run_available(rows, "pushed", str(tmp_path / "cp")).collect()) == [1, 2, 3]
    source.push(4)
    bursts = []
    live.packed(rows, bursts.append, str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(sum(bursts, [])) == [1, 2, 3, 4]


def test_cache_drops_what_was_not_used(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    get = lambda n, most=None: files.cached(spark, str(tmp_path), f"q{n}", lambda: make(n), most).count()
    assert [get(1), get(2), get(1)] == [1, 2, 1] and made == [1, 2]
    time.sleep(1.1)
    assert get(1) == 1 and get(3, 1) == 3 and made == [1, 2, 3]
    assert len(list(tmp_path.iterdir())) == 1 and get(1) == 1 and made == [1, 2, 3, 1]


def test_rows_reach_a_database(spark, tmp_path):
    """The Derby that Spark brings stands in for a server."""
    from tempoweir.functions.helpers import quote_table
    from tempoweir.sources.ticks import values
    from tempoweir.stream import Stream
    from pyspark.sql import functions as F

    url, properties = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    s = values(spark, [(1_704_067_200_000_001_000, 1.5), (1_704_067_201_000_000_000, 2.5)])
    files.jdbc_write(Stream(s.df.withColumn("v", F.struct(F.col("v").alias("price")))), url, "ticks", properties)
    got = spark.read.jdbc(url, quote_table("ticks"), properties=properties).select(F.unix_micros(F.col("time").cast("timestamp")).alias("t"), "price").orderBy("t").collect()
    assert [tuple(r) for r in got] == [(1_704_067_200_000_001, 1.5), (1_704_067_201_000_000, 2.5)]
