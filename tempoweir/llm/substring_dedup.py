"""Substring dedup: repeated token windows are removed, their first place stays.

Rabin-Karp hashes of every window of ``window`` words are counted in Spark.
Documents are dealt to blocks by a hash of their id.  A block hashes all its
windows, keeps the first of equal ones and sends each hash bucket one packed row
(hashes and ids), so that a window which a third of all documents share reaches
a bucket once a block and not once a document.  The bucket answers with a bitmap
of those entries that start in an earlier document.  The block, met again in
document order, merges the repeated windows into maximal removal intervals.

Windows are equal if their 64-bit hashes are: for n windows in all, about
n^2 / 2^65 pairs differ and are still taken as equal.

Order is that of the id (null ids last, rows of one id by text, nulls as empty
texts), then of the place.  Null and empty texts have no words and nothing to
remove; texts shorter than a window stay whole.  Repeated rows are documents of
their own: all but the first are removed.  Other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweir.llm import tokens
from tempoweir.llm.common import table, text_bytes

WINDOW = 20
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 4 << 20
LEAST_BLOCKS = 32
LEAST_BITS = 8  # with the bucket's bits, 56 bits sent make 64

OUT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept_text string"


class _Block:
    """A block's texts in order, and the first of its equal windows."""

    def __init__(self, rows: pa.Table, window: int):
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", rows["text"].fill_null(""))
        self.rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        counts, hashes, starts, docs, words, lo = [], [], [], [], 0, 0
        for w in tokens.words(self.rows["text"]):
            at, h = tokens.windows(w, window)
            counts.append(w.counts)
            hashes.append(h)
            starts.append(at + words)
            docs.append(w.doc[at] + lo)
            words += len(w.starts)
            lo += w.hi - w.lo
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.counts, self.n_words = join(counts, np.int64), words
        self.hashes, self.starts, self.docs = join(hashes, np.uint64), join(starts, np.int64), join(docs, np.int64)
        self.first = np.sort(np.unique(self.hashes, return_index=True)[1])

    def buckets(self, bits: int):
        """(bucket, indices of the first windows in it), in order."""
        of = (self.hashes[self.first] >> np.uint64(64 - bits)).astype(np.uint32)
        order = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[order].astype(np.int64), prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(order)], strict=False):
            yield int(of[order[lo]]), self.first[order[lo:hi]]


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    """Ids as unsigned integers of the same order, nulls last."""
    raw = ids.cast(pa.int64()).fill_null((1 << 63) - 1).to_numpy()
    return raw.astype(np.uint64) ^ np.uint64(1 << 63)


def _send(bits: int, window: int):
    def send(key, rows):
        block = _Block(rows, window)
        ids = _order(block.rows["doc_id"])
        of, payload = [], []
        for bucket, at in block.buckets(bits):
            held, n = np.unique(ids[block.docs[at]], return_counts=True)
            low = block.hashes[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
            of.append(bucket)
            payload.append(int(held[0]).to_bytes(8, "little") + tokens.pack(np.diff(held)) + tokens.pack(n) + low.tobytes())
        g = key[0].as_py()
        return pa.table({"bucket": pa.array(of, pa.int32()), "g": pa.array([g] * len(of), pa.int32()), "payload": pa.array(payload, pa.binary())})

    return send


def _answer(key, rows):
    hashes, ids, sizes = [], [], []
    for raw in rows["payload"].to_pylist():
        view = memoryview(raw)
        gaps, at = tokens.unpack(view, 8)
        n, at = tokens.unpack(view, at)
        held = np.cumsum(np.concatenate([[np.uint64(int.from_bytes(view[:8], "little"))], gaps]), dtype=np.uint64)
        ids.append(np.repeat(held, n.astype(np.int64)))
        low = np.frombuffer(view[at:], np.uint8).reshape(-1, 7)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :7] = low
        hashes.append(wide.view("<u8")[:, 0])
        sizes.append(len(low))
    h, ids = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(h)
    edges = np.flatnonzero(np.diff(h[order], prepend=~h[order[0]]))
    least = np.minimum.reduceat(ids[order], edges)
    later = np.zeros(len(h), bool)
    later[order] = ids[order] > np.repeat(least, np.diff(np.append(edges, len(h))))
    bits, groups, lo = [], [], 0
    for g, n in zip(rows["g"].to_pylist(), sizes, strict=True):
        if later[lo : lo + n].any():
            groups.append(g)
            bits.append(np.packbits(later[lo : lo + n]).tobytes())
        lo += n
    return pa.table({"g": pa.array(groups, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(groups), pa.int32()), "later": pa.array(bits, pa.binary())})


def _finish(bits: int, window: int):
    def finish(rows, answers):
        block = _Block(rows, window)
        repeated = np.ones(len(block.hashes), bool)
        repeated[block.first] = False
        said = dict(zip(answers["bucket"].to_pylist(), answers["later"].to_pylist(), strict=True))
        if said:
            for bucket, at in block.buckets(bits):
                if raw := said.get(bucket):
                    repeated[at] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(at)).astype(bool)
        starts = block.starts[repeated]
        edge = np.bincount(starts, minlength=block.n_words + 1) - np.bincount(starts + window, minlength=block.n_words + 1)[: block.n_words + 1]
        gone = np.cumsum(edge)[: block.n_words] > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        last = np.cumsum(block.counts)
        removed = before[last] - before[last - block.counts]
        spans, kept = [], []
        for text, n, out, hi in zip(block.rows["text"], block.counts, removed, last, strict=True):
            found = text.as_py().encode().split()
            if out:
                mask = gone[hi - n : hi]
                turn = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
                found = compress(found, ~mask)
            else:
                spans.append([])
            kept.append(b" ".join(found).decode())
        return pa.table(
            {
                "doc_id": block.rows["doc_id"].cast(pa.int64()),
                "n_words": pa.array(block.counts),
                "n_removed": pa.array(removed.astype(np.int64)),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept_text": pa.array(kept, pa.string()),
            }
        )

    return finish


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, spans of removed words and the kept text."""
    size = text_bytes(docs, text_col)
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    bits = max(LEAST_BITS, (-(-size // BUCKET_BYTES) - 1).bit_length())
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "g", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    )
    sent = base.groupBy("g").applyInArrow(_send(bits, window), "bucket int, g int, payload binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "g int, bucket int, later binary")
    return base.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_finish(bits, window), OUT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
#: Windows of whole texts in SQL take far longer than a check allows; tests hold it against brute force.
ORACLE: dict[str, str] = {}
