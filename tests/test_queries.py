"""Registered queries against their SQL, and streaming against batch."""

import importlib.util
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tempoweir.operators import kernels
from tempoweir.plans import catalog
from tempoweir.streaming import state

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{round(v, 6) + 0.0:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(key(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sql, name):
    df = catalog.queries()[name](spark, DATA)
    got = _norm([tuple(r) for r in df.collect()], df.columns)
    rel = sql.execute(catalog.oracle_sql()[name])
    want = _norm(rel.fetchall(), [d[0] for d in rel.description])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def _matches_on(spark, tmp_path, name, rows):
    """Whether a query over events made of VALUES (id, ts, user, type, value) gives the rows of its SQL."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE TABLE events AS SELECT id::bigint AS event_id, ts::timestamp AS ts, u::bigint AS user_id, k::varchar AS event_type, v::double AS value, '{{}}' AS props FROM (VALUES {rows}) x(id, ts, u, k, v)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = catalog.queries()[name](spark, str(tmp_path))
    rel = con.execute(catalog.oracle_sql()[name])
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(rel.fetchall(), [d[0] for d in rel.description])


def test_stamps_of_the_same_instant(spark, tmp_path):
    """A stage reached at the produce instant (value 0) is stamped; missing values and times count as unstamped."""
    at = "'2024-01-01 00:10:00'"
    _matches_on(spark, tmp_path, "stamp_each", f"(1, {at}, 1, 'a', 0.0), (2, {at}, 1, 'a', 1.5), (11, {at}, 1, 'a', 2.0), (3, {at}, 1, 'b', NULL), (4, NULL, 1, 'b', 2.0), (22, NULL, 1, 'b', 2.0)")


def test_fan_keeps_ticks_that_share_an_instant(spark, tmp_path):
    """Also where their ids are equal or missing."""
    at, late = "'2024-01-01 00:10:00'", "'2024-01-01 00:20:00'"
    _matches_on(spark, tmp_path, "fan", f"(1, {at}, 1, 'a', 70.0), (2, {at}, 1, 'a', 50.0), (3, {at}, 1, 'a', 80.0), (4, {late}, 1, 'a', 10.0), (5, {late}, 1, 'b', 90.0), (5, {late}, 1, 'b', 20.0), (5, {late}, 1, 'b', 20.0), (6, {late}, 1, 'b', NULL), (NULL, {late}, 1, 'b', 75.0), (NULL, {late}, 1, NULL, 75.0)")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("make", [lambda: kernels.ewma(alpha=0.3), lambda: kernels.throttle(3_600 * 10**9)], ids=["ewma", "throttle"])
def test_streaming_matches_batch(spark, tmp_path, make):
    base = catalog.events(spark, DATA).df
    for i in range(3):  # three files, in order of time
        base.where((F.col("seq") * 3 / base.count()).cast("int") == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    src = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = state.run_available(state.stateful(src, "k", make()), f"out_{abs(hash(str(tmp_path)))}", str(tmp_path / "cp"))
    want = catalog.Stream(base, ("k",))._run(make(), "double").df
    assert _norm([tuple(r) for r in got.select("k", "t", "v").collect()], ["k", "t", "v"]) == _norm([tuple(r) for r in want.select("k", "t", "v").collect()], ["k", "t", "v"])


def test_llm_is_optional(monkeypatch):
    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("tempoweir.llm", "corpus_pipeline") else find(name, *a))
    assert set(__spark_entry__.queries()) == set(catalog.queries()) and set(__spark_entry__.oracle_sql()) == set(catalog.oracle_sql())
