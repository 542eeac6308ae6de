"""Embedding near-dedup: Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so cosine c is Euclidean distance sqrt(2 - 2c).  A table
buckets them by ``k`` quantised random Gaussian projections floor((a.v + b) / w);
``k`` follows the number of vectors and ``L`` tables make a pair at the threshold
share a bucket with the probability asked for.  A table takes 24 bytes of a vector: its
bucket, its id and a sketch, the signs of 64 more projections.  Pairs of a bucket whose
sketches differ in at most MOST_SIGNS places (of pairs at the threshold one in 2 000
differs more) are candidates.  Only candidates get their vectors: as single pairs
where a bucket holds few of them, else as a task of all vectors that have one.  Each
pair is checked by its cosine in double precision, and counted in the first table that
it shares, which is found from the vectors again.

Equal vectors (by a 128-bit hash) are one class and enter with its size.  A bucket above CHUNK
vectors is dealt in chunks, each pair of chunks being a task of its own, so that
no task holds more than 2 * CHUNK vectors; links of dense buckets leave a task as counts and as a
spanning forest, never as all pairs.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths do not link.  Repeated rows are
vectors of their own.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempoweir.llm import tokens
from tempoweir.llm.common import cut, table
from tempoweir.llm.graph import components, forest

THRESHOLD = 0.9
RECALL = 0.97
WIDTH = 2.5
OCCUPANCY = 24  # unrelated vectors meant to share a bucket
CHUNK = 1_024
SIGNS, MOST_SIGNS = 64, 19
FEW = 4  # candidate pairs of a vector up to which a bucket's pairs go singly
SEED = 20_251


def _collides(distance: float, width: float) -> float:
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = _collides(math.sqrt(2 - 2 * threshold), WIDTH), _collides(math.sqrt(2), WIDTH)
    k = max(1, round(math.log(max(1.0, n / OCCUPANCY)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


class _Tables:
    """Keys and sketches of vectors of any length; key: 48 bits of the bucket, then the table's number."""

    def __init__(self, k: int, tables: int) -> None:
        self.k, self.tables, self.made = k, tables, {}

    def _planes(self, d: int):
        if d not in self.made:
            rng = np.random.default_rng(SEED + d)
            n = self.tables * self.k
            odd = rng.integers(1, 1 << 62, self.k).astype(np.uint64) | np.uint64(1)
            self.made[d] = rng.standard_normal((d, n)), rng.uniform(0, WIDTH, n), odd, rng.standard_normal((d, SIGNS))
        return self.made[d]

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables)"""
        a, b, odd, _ = self._planes(x.shape[1])
        cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).astype(np.uint64).reshape(-1, self.tables, self.k)
        t = np.arange(self.tables, dtype=np.uint64)
        with np.errstate(over="ignore"):
            mixed = tokens.mix((cell * odd).sum(2, dtype=np.uint64) + tokens.mix((t << np.uint64(32)) + np.uint64(x.shape[1])))
        return ((mixed & ~np.uint64(0xFFFF)) | t).view(np.int64)

    def sketches(self, x: np.ndarray) -> np.ndarray:
        planes = self._planes(x.shape[1])[3]
        return np.packbits(x @ planes > 0, axis=1).view("<u8")[:, 0].view(np.int64)


def _matrices(vectors: pa.Array):
    """(rows, normalised vectors) of each length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, start = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        x = flat[start[rows][:, None] + np.arange(d)].astype(np.float64)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _bucketer(k: int, tables: int):
    def bucket(batches):
        of = _Tables(k, tables)
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            for rows, x in _matrices(batch.column("v")):
                for lo in range(0, len(rows), 2_048):
                    part = slice(lo, lo + 2_048)
                    keys, signs, ids = of.keys(x[part]), pa.array(of.sketches(x[part])), pa.array(nodes[rows[part]])
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, t])), ids, signs], ["key", "node", "sketch"])

    return bucket


def _groups(batches, columns: list[str], task: list[str]):
    """Columns of whole tasks, several at once, with the edges between them; rows come sorted by task."""
    held = None
    for batch in batches:
        new = {c: batch.column(c) for c in columns}
        if held is not None:
            new = {c: pa.concat_arrays([held[c], new[c]]) for c in columns}
        n = len(new[columns[0]])
        if not n:
            continue
        cut_at = np.zeros(n, bool)
        cut_at[0] = True
        for c in task:
            v = new[c].to_numpy(zero_copy_only=False)
            cut_at[1:] |= v[1:] != v[:-1]
        edges = np.flatnonzero(cut_at)
        last = int(edges[-1])  # may go on in the next batch
        if last:
            yield {c: new[c].slice(0, last) for c in columns}, edges
        held = {c: new[c].slice(last) for c in columns}
    if held is not None and len(held[columns[0]]):
        yield held, np.array([0, len(held[columns[0]])])


def _sketcher(batches):
    """Candidate pairs (a, b, t) of buckets with few, and members (key, ci, cj, chunk, a) of those with many."""
    columns, task = ["key", "ci", "cj", "chunk", "node", "sketch"], ["key", "ci", "cj"]
    for rows, edges in _groups(batches, columns, task):
        key, ci, cj, chunk, node, sketch = (rows[c].to_numpy(zero_copy_only=False) for c in columns)
        size = np.diff(edges)
        start, length = np.repeat(edges[:-1], size), np.repeat(size, size)
        place = np.arange(len(key)) - start
        crossed = ci != cj
        one, two = [], []
        for shift in range(1, int(size.max(initial=0))):
            i = np.flatnonzero(place + shift < length)
            i = i[~crossed[i] | (chunk[i] != chunk[i + shift])]
            near = np.bitwise_count((sketch[i] ^ sketch[i + shift]).view(np.uint64)) <= MOST_SIGNS
            one.append(i[near])
            two.append(i[near] + shift)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))
        n = len(key)
        met = np.zeros(n, bool)
        met[i] = met[j] = True
        of = start[i]  # a task is known by its first row
        dense = np.bincount(of, minlength=n) > FEW * np.bincount(start[met], minlength=n)
        few = ~dense[of]
        i, j = i[few], j[few]
        a, b, t = np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), (key[i] & 0xFFFF).astype(np.int32)
        m = np.flatnonzero(met & dense[start])
        none = lambda count, kind: pa.nulls(count, kind)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(t), none(len(a), pa.int64()), none(len(a), pa.int32()), none(len(a), pa.int32()), none(len(a), pa.int32())], ["a", "b", "t", "key", "ci", "cj", "chunk"])
        yield pa.RecordBatch.from_arrays([pa.array(node[m]), none(len(m), pa.int64()), pa.array((key[m] & 0xFFFF).astype(np.int32)), pa.array(key[m]), pa.array(ci[m]), pa.array(cj[m]), pa.array(chunk[m])], ["a", "b", "t", "key", "ci", "cj", "chunk"])


def _out(a, b, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(b, pa.int64()), pa.array(np.asarray(n, np.int64))], ["a", "b", "n"])


def _pair_checker(threshold: float, k: int, tables: int):
    """Counts and links of single pairs whose first shared table is the one they came from."""

    def check(batches):
        of = _Tables(k, tables)
        for batch in batches:
            a, b, t, na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "t", "na", "nb"))
            lengths = [np.diff(batch.column(c).offsets.to_numpy()) for c in ("va", "vb")]
            keep = np.zeros(len(a), bool)
            for d in np.unique(lengths[0]):
                rows = np.flatnonzero((lengths[0] == d) & (lengths[1] == d))
                for lo in range(0, len(rows), 2_048):
                    part = rows[lo : lo + 2_048]
                    if not len(part):
                        continue
                    x, y = (next(iter(_matrices(batch.column(c).take(pa.array(part)))))[1] for c in ("va", "vb"))
                    first = np.argmax(of.keys(x) == of.keys(y), axis=1)
                    keep[part] = ((x * y).sum(1) >= threshold) & (first == t[part])
            a, b, na, nb = a[keep], b[keep], na[keep], nb[keep]
            none = [None] * (2 * len(a))
            yield _out(np.concatenate([a, b, a]), none + b.tolist(), np.concatenate([nb, na, np.zeros(len(a), np.int64)]))

    return check


def _dense_checker(threshold: float, k: int, tables: int):
    """Counts and forests of tasks (key, ci, cj); between chunks only if there are two."""

    def check(batches):
        of = _Tables(k, tables)
        columns, task = ["key", "ci", "cj", "chunk", "node", "size", "v"], ["key", "ci", "cj"]
        for rows, edges in _groups(batches, columns, task):
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                key, ci, cj, chunk, node, size = (rows[c].slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in columns[:-1])
                for at, x in _matrices(rows["v"].slice(lo, hi - lo)):
                    linked = x @ x.T >= threshold
                    np.fill_diagonal(linked, False)
                    if ci[0] != cj[0]:
                        linked &= chunk[at][:, None] != chunk[at][None, :]
                    keys = of.keys(x)
                    for u in range(int(key[0] & 0xFFFF)):
                        linked &= keys[:, u][:, None] != keys[:, u][None, :]
                    n = (linked.astype(np.float64) @ size[at]).astype(np.int64)
                    links, some = forest(linked), np.flatnonzero(n)
                    own = node[at]
                    yield _out(
                        np.concatenate([own[some], [own[i] for i, _ in links]]), [None] * len(some) + [int(own[j]) for _, j in links], np.concatenate([n[some], np.zeros(len(links), np.int64)])
                    )

    return check


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links and component_id of every row."""
    good = F.coalesce(
        (F.size(vec_col) > 0)
        & ~F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        & F.exists(vec_col, lambda c: c != 0),
        F.lit(False),
    )
    v = F.transform(vec_col, lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), good.alias("good"), F.when(good, v).alias("v"))
    named = rows.where("good and vec_id is not null").select("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    classes = cut(named.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.first("v").alias("v")))
    # an id with several vectors is several nodes, named by numbers below all ids
    twins = classes.withColumn("turn", F.row_number().over(Window.partitionBy("node").orderBy("h1", "h2")))
    again = cut(twins.where("turn > 1").select("h1", "h2", (-F.abs(F.xxhash64("h1", "h2")) - (1 << 62)).alias("other")))
    if not again.isEmpty():
        classes = cut(classes.join(again, ["h1", "h2"], "left").select("h1", "h2", F.col("node").alias("id"), F.coalesce("other", "node").alias("node"), "size", "v"))
    else:
        classes = classes.withColumn("id", F.col("node"))
    k, tables = plan(classes.count(), threshold, recall)
    spread = classes.select("node", "v").mapInArrow(_bucketer(k, tables), "key bigint, node bigint, sketch bigint")
    # how many chunks a bucket takes; one row a bucket, and only of buckets with company
    held = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("c"))
    dealt = spread.join(held, "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    dealt = dealt.select("key", F.least("chunk", "o").alias("ci"), F.greatest("chunk", "o").alias("cj"), "chunk", "node", "sketch")
    task = ["key", "ci", "cj"]
    met = cut(dealt.repartition(*task).sortWithinPartitions(*task).mapInArrow(_sketcher, "a bigint, b bigint, t int, key bigint, ci int, cj int, chunk int"))

    shape = "a bigint, b bigint, n bigint"
    pairs = met.where("b is not null").groupBy("a", "b").agg(F.min("t").alias("t"))
    side = lambda x: classes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("v").alias(f"v{x}"))
    single = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t", "na", "nb", "va", "vb").mapInArrow(_pair_checker(threshold, k, tables), shape)
    members = met.where("b is null").select("key", "ci", "cj", "chunk", F.col("a").alias("node")).join(classes.select("node", "size", "v"), "node")
    dense = members.repartition(*task).sortWithinPartitions(*task).mapInArrow(_dense_checker(threshold, k, tables), shape)
    checked = cut(single.unionByName(dense))

    found = components(checked.where("b is not null"))
    counts = checked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    # components are named by nodes: the least id in each
    linked = found.join(classes.select("node", "id"), "node")
    linked = linked.join(linked.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("node", "component_id")
    of = classes.join(counts, "node", "left").join(linked, "node", "left").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    good_rows = named.select("vec_id", "h1", "h2").join(of, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    rest = rows.where("not good or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good_rows.unionByName(rest)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
#: All pairs in SQL are a cross join; tests measure recall against brute force.
ORACLE: dict[str, str] = {}
