"""N-gram Jaccard join: universe partition and pigeonhole, exactly verified.

A text is its set of distinct word shingles.  Sets fall into size bands; sets of
a band (and larger partners, which lie in the same band or the next) differ in at
most H shingles, so hashing shingles into H + 1 segments leaves one segment equal
in both.  Segments are indexed by a signature of their shingles, a subset of them
also by signatures with one shingle left out.  The signature of an empty segment holds the set's size
too, lest all sets with an empty segment meet; a probe asks for each size that a partner can have
(not below a similarity of 2/3, where empty segments are too common to ask so).  A probe spends H + 1 units on its
segments: none on those whose signature is cheap to hit by chance (at most one
shingle), two (equal, or one shingle apart) on as many others that are indexed
with deletions.  Signatures travel packed by bucket; the texts that meet in one
are joined into clusters.  Chance meetings chain unrelated texts, the more the more
texts there are, so clusters above CHUNK are taken apart first: all their pairs are compared
by sketches, whose differing bits are at most the shingles that the sets do not share, and
only pairs within the bound stay joined.  Inside a cluster every pair is verified exactly,
in tasks of at most 2 * CHUNK texts, counting links and keeping a spanning forest.

Equal sets (by a 128-bit digest) are one class and enter once.  Shingles are
compared by 64-bit hashes.  Null and empty texts have no shingles and link with
nothing; a text shorter than a shingle is one shingle.  Rows of one id are one
document with the links of each row; rows without id have no component.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempoweir.llm import tokens
from tempoweir.llm.common import cut, fresh, table, text_bytes
from tempoweir.llm.graph import components, forest

CHUNK = 256
#: As CHUNK, of sketches.
SKETCHES = 4_096
BUCKET_BYTES = 4 << 20
LEAST_BITS = 8
_M1, _M2, _M3 = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingle_sets(column, k: int):
    """Sorted distinct 64-bit shingles of each text, chunk by chunk of texts."""
    for w in tokens.words(column, tokens.NOT_SPACE, tokens.LOWER):
        at, h = tokens.windows(w, k)
        ends = np.searchsorted(w.doc[at], np.arange(w.hi - w.lo), "right")
        starts = tokens.word_starts(w)
        sets, lo = [], 0
        for d, hi in enumerate(ends):
            n = int(w.counts[d])
            if n >= k:
                sets.append(np.unique(h[lo:hi]))
            elif n:
                whole = tokens.rolling(w.hashes[starts[d] : starts[d] + n], n)
                with np.errstate(over="ignore"):
                    sets.append(tokens.mix(whole + np.uint64(n)))
            else:
                sets.append(h[:0])
            lo = hi
        yield sets


def sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles' counts in as many cells as there are shingles, rounded up to a power of two, 64 at least."""
    cells = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    at = (tokens.mix(s + _M1) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells).astype(np.uint8) & 1).tobytes()


def _profiler(k: int):
    def profile(batches):
        for batch in batches:
            n, one, two, drawn = [], [], [], []
            with np.errstate(over="ignore"):
                for sets in shingle_sets(batch.column("text"), k):
                    for s in sets:
                        n.append(len(s))
                        one.append(int(tokens.mix(s ^ _M1).sum(dtype=np.uint64)))
                        two.append(int(tokens.mix(s + _M2).sum(dtype=np.uint64)))
                        drawn.append(sketch(s))
            as_long = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), pa.array(n, pa.int64()), as_long(one), as_long(two), pa.array(drawn, pa.binary())], ["id", "t", "n", "h1", "h2", "sketch"])

    return profile


@lru_cache
def bands(num: int, den: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper sizes of the bands, their segments and how many of these are indexed with deletions."""
    tops, low = [], 1
    while low <= most:
        tops.append(low * den // num)
        low = tops[-1] + 1
    top = np.array(tops, np.int64)
    segments = top * (den - num) // num + 1
    # so many that segments left out can be made up for: their share of all, by Poisson, and three deviations
    mean = num / (den - num)
    small = np.exp(-mean) * (1 + mean)
    rich = max(0.05, 1 - np.exp(-mean) * (1 + mean + mean * mean / 2))
    needed = np.ceil(segments * small / rich + 3 * np.sqrt(segments * small) + 2).astype(np.int64)
    return top, segments, np.minimum(segments, needed)


def _spend(sizes: np.ndarray, deletable: int) -> np.ndarray:
    """Units spent on each segment, len(sizes) in all."""
    units = np.ones(len(sizes), np.int8)
    cheap = np.flatnonzero(sizes <= 1)
    rich = np.flatnonzero(sizes[:deletable] >= 2)
    cheap, rich = cheap[np.argsort(sizes[cheap], kind="stable")], rich[np.argsort(-sizes[rich], kind="stable")]
    for a, b in zip(cheap, rich, strict=False):
        # two shingles with one left out are hit as easily as one: that pays only for an empty segment
        if sizes[b] < 3 and sizes[a]:
            break
        units[a], units[b] = 0, 2
    return units


def _signed(elements, of, n: np.ndarray, band: int, segments: int, deletable: int, index: bool, reach: tuple[np.ndarray, np.ndarray], sized: bool = True):
    """Signatures (key, text, probes, is_index) of texts under one band.

    elements, of: shingles of these texts and the text of each; n: sizes of the texts;
    reach: least and largest size of an indexed partner.
    """
    sizes = len(n)
    with np.errstate(over="ignore"):
        spot = ((tokens.mix(elements ^ _M3) >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        seg = of * segments + spot.astype(np.int64)
        value = tokens.mix(elements + _M3)
        low = np.bincount(seg, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=sizes * segments).astype(np.uint64)
        high = np.bincount(seg, weights=(value >> np.uint64(32)).astype(np.float64), minlength=sizes * segments).astype(np.uint64)
        total = low + (high << np.uint64(32))
        count = np.bincount(seg, minlength=sizes * segments)
        mark = tokens.mix(np.uint64(band << 32) + np.arange(segments, dtype=np.uint64))
        units = np.ones(sizes * segments, np.int8)
        for d in np.flatnonzero((count.reshape(sizes, segments) <= 1).any(1)):
            units[d * segments : (d + 1) * segments] = _spend(count[d * segments : (d + 1) * segments], deletable)
        base = total + np.tile(mark, sizes)
        text = np.arange(len(base)) // segments
        empty = (count == 0) & sized
        full = tokens.mix(np.where(empty, base + tokens.mix(n.astype(np.uint64))[text], base))
        take = np.flatnonzero((units > 0) & ~empty) if not index else np.arange(len(full))
        # probes of empty segments, for each size but the own one, which the index rows stand for
        asked = np.flatnonzero(empty & (units > 0))
        many = (reach[1] - reach[0] + 1)[text[asked]]
        asked = np.repeat(asked, many)
        other = reach[0][text[asked]] + np.arange(len(asked)) - np.repeat(np.cumsum(many) - many, many)
        asked, other = (x[(other != n[text[asked]]) | (not index)] for x in (asked, other))
        alike = tokens.mix(base[asked] + tokens.mix(other.astype(np.uint64)))
        # what a segment of one shingle is without it no probe asks for
        left = np.flatnonzero((spot < np.uint64(deletable)) & (count[seg] > 1)) if index else np.flatnonzero(units[seg] == 2)
        less = tokens.mix(total[seg[left]] - value[left] + mark[spot[left].astype(np.int64)])
    return (
        np.concatenate([full[take], alike, less]),
        np.concatenate([text[take], text[asked], of[left]]),
        np.concatenate([units[take] > 0, np.ones(len(asked), bool), units[seg[left]] == 2]),
        np.concatenate([np.full(len(take), index), np.zeros(len(asked), bool), np.full(len(left), index)]),
    )


def _signer(k: int, num: int, den: int, bits: int):
    def sign(batches):
        top, segments, deletable = bands(num, den)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            keys, docs, probes, indexed, lo = [], [], [], [], 0
            for sets in shingle_sets(batch.column("text"), k):
                n = np.array([len(s) for s in sets], np.int64)
                own = np.searchsorted(top, n)
                for shift in (0, 1):
                    band = own - shift
                    # the smallest partner must reach into the band, and the band must allow a difference
                    may = (n > 0) & (band >= 0) & (segments[np.maximum(band, 0)] > 1)
                    if shift:
                        may &= -(-n * num // den) <= top[np.maximum(band, 0)]
                    for b in np.unique(band[may]):
                        these = np.flatnonzero(may & (band == b))
                        flat = np.concatenate([sets[i] for i in these])
                        of = np.repeat(np.arange(len(these)), n[these])
                        low = max(int(top[b - 1]) + 1 if b else 1, 1)
                        # an indexed partner is of this band; of equal sizes either asks
                        reach = np.maximum(-(-n[these] * num // den), low), np.minimum(n[these] * den // num, int(top[b]))
                        key, at, probe, is_index = _signed(flat, of, n[these], int(b), int(segments[b]), int(deletable[b]), not shift, reach, num >= 2 * (den - num))
                        keys.append(key)
                        docs.append(rank[these[at] + lo])
                        probes.append(probe)
                        indexed.append(is_index)
                lo += len(sets)
            if not keys:
                continue
            key, doc, probe, index = (np.concatenate(x) for x in (keys, docs, probes, indexed))
            bucket = (key >> np.uint64(64 - bits)).astype(np.uint32)
            turn = np.lexsort((doc, bucket))
            key, doc, probe, index, bucket = key[turn], doc[turn], probe[turn], index[turn], bucket[turn]
            held = (ids[order].astype(np.uint64) ^ np.uint64(1 << 63))[doc]
            edges = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
            of, payload = [], []
            for a, z in zip(edges, np.append(edges[1:], len(bucket)), strict=True):
                low = key[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                distinct, count = np.unique(held[a:z], return_counts=True)
                of.append(int(bucket[a]))
                payload.append(
                    int(distinct[0]).to_bytes(8, "little") + tokens.pack(np.diff(distinct)) + tokens.pack(count)
                    + np.packbits(probe[a:z]).tobytes() + np.packbits(index[a:z]).tobytes() + low.tobytes()
                )
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "payload"])

    return sign


def _meet(key, rows):
    """Links from an indexed text to all that probe a signature, and from a probe to all indexed."""
    keys, ids, probes, indexed = [], [], [], []
    for raw in rows["payload"].to_pylist():
        view = memoryview(raw)
        gaps, at = tokens.unpack(view, 8)
        count, at = tokens.unpack(view, at)
        held = np.cumsum(np.concatenate([[np.uint64(int.from_bytes(view[:8], "little"))], gaps]), dtype=np.uint64)
        n = int(count.sum())
        size = -(-n // 8)
        probes.append(np.unpackbits(np.frombuffer(view[at : at + size], np.uint8), count=n).astype(bool))
        indexed.append(np.unpackbits(np.frombuffer(view[at + size : at + 2 * size], np.uint8), count=n).astype(bool))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :7] = np.frombuffer(view[at + 2 * size :], np.uint8).reshape(-1, 7)
        keys.append(wide.view("<u8")[:, 0])
        ids.append(np.repeat(held, count.astype(np.int64)))
    k, ids, probe, index = (np.concatenate(x) for x in (keys, ids, probes, indexed))
    order = np.argsort(k)
    k, ids, probe, index = k[order], ids[order], probe[order], index[order]
    edges = np.flatnonzero(np.diff(k, prepend=~k[0]))
    size = np.diff(np.append(edges, len(k)))
    most = np.uint64((1 << 64) - 1)
    centre = np.minimum.reduceat(np.where(index, ids, most), edges)
    asker = np.minimum.reduceat(np.where(probe, ids, most), edges)
    both = (centre != most) & (asker != most) & (size > 1)
    row = np.flatnonzero(np.repeat(both, size))
    a, p = np.repeat(centre, size)[row], np.repeat(asker, size)[row]
    x = np.concatenate([a[probe[row]], p[index[row]]])
    y = np.concatenate([ids[row][probe[row]], ids[row][index[row]]])
    pair = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)])[x != y], axis=0)
    signed = (pair ^ np.uint64(1 << 63)).view(np.int64)
    return pa.table({"a": pa.array(signed[:, 0]), "b": pa.array(signed[:, 1])})


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of up to 2 * CHUNK sets."""
    n = len(sets)
    if n <= 6:
        out = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    new = np.diff(flat[order], prepend=~flat[order[0]]) != 0
    term = np.cumsum(new) - 1
    shared = np.bincount(term)[term] > 1
    of, term = of[order][shared], term[shared]
    term = np.cumsum(np.diff(term, prepend=-1) != 0) - 1 if len(term) else term
    out = np.zeros((n, n), np.float64)
    width = 4_096
    for lo in range(0, int(term[-1]) + 1 if len(term) else 0, width):
        a, z = np.searchsorted(term, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[of[a:z], term[a:z] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verifier(k: int, num: int, den: int, task: list[str]):
    def one(rows):
        sets = [s for part in shingle_sets(pa.array([r["text"] for r in rows], pa.large_string()), k) for s in part]
        node, side, copies = np.array([r["node"] for r in rows]), np.array([r["side"] for r in rows]), np.array([r["copies"] for r in rows])
        n = np.array([len(s) for s in sets])
        common = intersections(sets)
        linked = (common > 0) & (den * common >= num * (n[:, None] + n[None, :] - common)) & (node[:, None] != node[None, :])
        if len(set(side.tolist())) > 1:
            linked &= side[:, None] != side[None, :]
        links = (linked * copies[None, :]).sum(1)
        pairs = forest(linked)
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[at], [node[i] for i, _ in pairs]]).astype(np.int64)),
                pa.array([None] * len(at) + [int(node[j]) for _, j in pairs], pa.int64()),
                pa.array(np.concatenate([links[at], np.zeros(len(pairs))]).astype(np.int64)),
            ],
            ["a", "b", "n"],
        )

    return _by_task(one, task)


def _near(sketches: list[bytes], n: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that join what all pairs of sketches within the bound join, of different sides if there are two.

    Sets that link differ in at most (den - num) / (den + num) of their sizes' sum, and by no
    fewer shingles than their sketches by bits.  The longer sketch of two is folded.
    """
    cells = np.array([len(x) for x in sketches])
    label, found, apart = np.arange(len(n)), [], len(set(side.tolist())) > 1
    for length in np.unique(cells):
        own = np.flatnonzero(cells == length)
        cols = np.flatnonzero((cells >= length) & (cells * num <= 2 * length * den))
        own, cols = own[np.argsort(n[own], kind="stable")], cols[np.argsort(n[cols], kind="stable")]

        def bits(at, length=length):
            out = []
            for i in at:
                x = np.frombuffer(sketches[i], np.uint8)
                while len(x) > length:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                out.append(x.tobytes())
            return np.frombuffer(b"".join(out), np.uint64).reshape(len(at), -1)

        left, right = bits(own), np.ascontiguousarray(bits(cols).T)
        step = max(1, (1 << 20) // len(cols))
        for a in range(0, len(own), step):
            rows = own[a : a + step]
            lo, hi = np.searchsorted(n[cols], [-(-n[rows[0]] * num // den), n[rows[-1]] * den // num + 1])
            to = cols[lo:hi]
            most = (n[rows][:, None] + n[to][None, :]) * (den - num) // (den + num)
            differ = np.zeros(most.shape, np.int32)
            for w in range(left.shape[1]):
                differ += np.bitwise_count(left[a : a + step, w, None] ^ right[None, w, lo:hi])
            keep = (differ <= most) & (np.abs(n[rows][:, None] - n[to][None, :]) <= most) & (rows[:, None] != to[None, :])
            if apart:
                keep &= side[rows][:, None] != side[to][None, :]
            for r in np.flatnonzero(keep.any(1)):
                i, partners = int(rows[r]), to[keep[r]]
                others, first = np.unique(label[partners], return_index=True)
                for other, j in zip(others.tolist(), partners[first].tolist(), strict=True):
                    if other != label[i]:
                        found.append((i, j))
                        label[label == other] = label[i]
    return found


def _sifter(num: int, den: int, task: list[str]):
    def one(rows):
        node = np.array([r["node"] for r in rows])
        pairs = _near([r["sketch"] for r in rows], np.array([r["n"] for r in rows]), np.array([r["side"] for r in rows]), num, den)
        return pa.RecordBatch.from_arrays([pa.array([node[p[side]] for p in pairs], pa.int64()) for side in (0, 1)], ["a", "b"])

    return _by_task(one, task)


def _by_task(one, task: list[str]):
    """``one`` over the rows of each task of two rows or more, which come together."""

    def walk(batches):
        held, key = [], None
        for batch in batches:
            for row in batch.to_pylist():
                at = tuple(row[c] for c in task)
                if at != key:
                    if len(held) > 1:
                        yield one(held)
                    held, key = [], at
                held.append(row)
        if len(held) > 1:
            yield one(held)

    return walk


def _taken_apart(members: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Members, those of clusters above CHUNK in the clusters that their sketches leave."""
    large = cut(members.groupBy("cluster").count().where(F.col("count") > CHUNK).select("cluster"))
    if large.isEmpty():
        return members
    chained = cut(members.join(large, "cluster"))
    task = ["cluster", "s1", "c1", "s2", "c2"]
    dealt = _tasks(chained, num, den, SKETCHES).join(chained.select("node", "n").join(sketches, "node"), "node").repartition(*task).sortWithinPartitions(*task, "node")
    near = components(dealt.mapInArrow(_sifter(num, den, task), "a bigint, b bigint"))
    rest = chained.drop("cluster").join(near.withColumnRenamed("component", "cluster"), "node")
    return cut(members.join(large, "cluster", "left_anti").unionByName(rest))


def _tasks(members: DataFrame, num: int, den: int, chunk: int = CHUNK) -> DataFrame:
    """(node, copies, task columns, side): members of clusters dealt so that each pair that can link meets in one task.

    A cluster of up to ``chunk`` members is one task.  Larger ones are dealt by size
    (partners lie in the same size class or the next) and by hash within it.
    """
    size_class = F.floor(F.log("n") / F.log(F.lit(den / num)) + 1e-9).cast("int")
    sized = members.withColumn("s", size_class)
    counts = sized.groupBy("cluster", "s").agg(F.count("*").alias("m")).withColumn("all", F.sum("m").over(Window.partitionBy("cluster")))
    # cut, so that its joins are of plain exchanges and a large cluster's partition can be split
    chunks = cut(counts.where(F.col("all") > chunk).select("cluster", "s", F.ceil(F.col("m") / chunk).cast("int").alias("c")))
    small = sized.join(chunks.select("cluster"), "cluster", "left_anti").select(
        "node", "copies", "cluster", F.lit(-1).alias("s1"), F.lit(0).alias("c1"), F.lit(-1).alias("s2"), F.lit(0).alias("c2"), F.lit(0).alias("side")
    )
    # sizes a hair apart may fall one class further, by rounding: take two classes up
    dealt = sized.join(chunks, ["cluster", "s"]).withColumn("h", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    other = chunks.select("cluster", F.col("s").alias("so"), F.col("c").alias("co"))
    met = dealt.join(other, (dealt["cluster"] == other["cluster"]) & F.abs(F.col("s") - F.col("so")).between(0, 2)).drop(other["cluster"])
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("co") - 1)))
    first = (F.col("s") < F.col("so")) | ((F.col("s") == F.col("so")) & (F.col("h") <= F.col("o")))
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    big = met.select(
        "node", "copies", "cluster", pick("s", "so").alias("s1"), pick("h", "o").alias("c1"), pick("so", "s").alias("s2"), pick("o", "h").alias("c2"),
        F.when((F.col("s") == F.col("so")) & (F.col("h") == F.col("o")), 0).otherwise(F.when(first, 1).otherwise(2)).alias("side"),
    )
    return small.unionByName(big)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles, n_links and component_id of every row; sets link at Jaccard num/den or more."""
    num, den = similarity
    size = text_bytes(docs, text_col)
    bits = max(LEAST_BITS, (-(-size // BUCKET_BYTES) - 1).bit_length())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    profile = cut(rows.mapInArrow(_profiler(shingle), "id bigint, t bigint, n bigint, h1 bigint, h2 bigint, sketch binary"))
    digest = ["n", "h1", "h2"]
    classes = profile.where("n > 0 and id is not null").groupBy(*digest).agg(F.min(F.struct("id", "t", "sketch")).alias("first"), F.countDistinct("id").alias("copies"))
    classes = classes.select(*digest, "copies", F.col("first.id").alias("least_id"), F.col("first.t").alias("t"), F.col("first.sketch").alias("sketch"))
    # an id that is the least of several classes names one of them; the others get numbers below all ids
    turn = F.row_number().over(Window.partitionBy("least_id").orderBy(*digest))
    named = F.when(turn == 1, F.col("least_id")).otherwise(-F.abs(F.xxhash64(*digest)) - (1 << 62))
    classes = cut(classes.select("*", named.alias("node")))
    # bad rows have no class and no key: they stay out of the join
    of = profile.where("n > 0 and id is not null").join(classes.select(*digest, "node", "least_id", "copies"), digest).select("id", "n", "node", "least_id", "copies")
    none = F.lit(None).cast("long")
    of = cut(of.unionByName(profile.where("n = 0 or id is null").select("id", "n", none.alias("node"), none.alias("least_id"), none.alias("copies"))))

    # one text of each class is signed, so that copies reach no bucket
    first = classes.select("node", F.col("least_id").alias("id"), "t")
    texts = rows.where("id is not null")
    signed = texts.join(first, ["id", "t"]).select(F.col("node").alias("id"), "text").mapInArrow(_signer(shingle, num, den, bits), "bucket int, payload binary")
    met = signed.groupBy("bucket").applyInArrow(_meet, "a bigint, b bigint")
    clusters = components(met).withColumnRenamed("component", "cluster")
    members = cut(classes.select("node", "n", "copies").join(clusters, "node"))
    members = _taken_apart(members, classes.select("node", "sketch"), num, den)

    task = ["cluster", "s1", "c1", "s2", "c2"]
    # the few tasks go to the texts by id and hash, which are dealt so already, and not the texts to the tasks by node
    dealt = texts.join(_tasks(members, num, den).join(first, "node"), ["id", "t"]).drop("id", "t").repartition(*task).sortWithinPartitions(*task, "node")
    checked = cut(dealt.mapInArrow(_verifier(shingle, num, den, task), "a bigint, b bigint, n bigint"))
    found = components(checked.where("b is not null"))
    # a component is called by the least id of its classes
    found = found.join(classes.select("node", "least_id"), "node")
    least = found.groupBy("component").agg(F.min("least_id").alias("least"))
    found = found.select("node", "component").join(least, "component").select("node", "least")
    counts = checked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    linked = cut(found.join(counts, "node", "full"))
    classed = of.where("node is not null").join(linked, "node", "left")
    alone = of.where("node is null").withColumns({"least": none, "links": none})
    out = classed.select("id", "n", "copies", "least_id", "least", "links").unionByName(alone.select("id", "n", "copies", "least_id", "least", "links"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("least", "least_id", "id")).alias("component_id"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"), shingle=4, similarity=(85, 100))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five words, 0.8) the document of least id, once.

    Documents without id are kept.
    """
    links = jaccard_links(docs)
    stay = links.where("doc_id = component_id").select("doc_id").distinct()
    (turn,) = fresh(docs, "turn_")
    named = docs.where("doc_id is not null").join(stay, "doc_id").withColumn(turn, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(turn) == 1)
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
#: A similarity join over whole texts takes SQL far too long; tests hold it against brute force.
ORACLE: dict[str, str] = {}
