"""Quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1, unlabelled text is drawn from
all documents.  The class prior p is estimated as the share of 1 among the training
labels or, where these are all 1, from trusted and unlabelled texts alone.  With it a
logistic model over shape features of the whole text minimises

    p R_P(+) + max(0, R_U(-) - p R_P(-)),

stepping back where the second term falls below zero.  Nothing is learnt from
rows whose crc32(id as text) mod 3 is 1; id, labels, lang and source are never
inputs of a score.  The fit takes at most FIT_ROWS positives and FIT_ROWS
unlabelled rows, those of least hash; every row of the table is scored.

Null and empty texts are scored by their (all-zero) features.  Repeated rows get
equal scores; a document with several labels is a trusted positive only if all
say 1.  Null ids are held out of the fit and scored.  Without trusted positives
or without unlabelled rows every score is 0.5.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweir.llm import tokens
from tempoweir.llm.common import fresh, table

FIT_ROWS = 20_000
STEPS = 1_500
RATE = 0.05
WEIGHT_DECAY = 1e-4
PRIOR_STEPS, PRIOR_RATE = 400, 0.5

#: Byte classes whose shares are features.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "|", "#$%&*+=<>@^~_{}[]\\/", ".,;:'\"()-", "\n")


def features(column) -> np.ndarray:
    """A row of bounded features for each text."""
    lookup = np.full(256, len(CLASSES), np.int64)
    for k, chars in enumerate(CLASSES):
        lookup[list(chars.encode())] = k
    data, offsets = tokens.buffers(column)
    rows = []
    for w in tokens.words(column):
        n_docs = w.hi - w.lo
        at = offsets[w.lo : w.hi + 1] - offsets[w.lo]
        size = np.diff(at)
        of = np.repeat(np.arange(n_docs), size)
        width = len(CLASSES) + 1
        shares = np.bincount(of * width + lookup[w.data], minlength=n_docs * width).reshape(n_docs, width) / np.maximum(size, 1)[:, None]
        n = np.maximum(w.counts, 1)
        same = np.flatnonzero((w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1]))
        adjacent = np.bincount(w.doc[same], minlength=n_docs) / n
        order = np.lexsort((w.hashes, w.doc))
        h, d = w.hashes[order], w.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        # repeats beyond those that long texts have anyway: against the root of the length
        distinct = np.bincount(d[new], minlength=n_docs)
        rare = np.where(w.counts > 0, 1 - np.minimum(1, distinct / (n**0.75)), 0)
        length = np.bincount(w.doc, weights=w.ends - w.starts, minlength=n_docs) / n
        joined = np.bincount(w.doc[lookup[w.data[w.ends - 1]] == 5], minlength=n_docs) / n if len(w.ends) else np.zeros(n_docs)
        rows.append(np.column_stack([np.sqrt(shares), np.sqrt(adjacent), rare, np.minimum(length, 30) / 30, joined, np.log1p(w.counts) / 10]))
    return np.concatenate(rows) if rows else np.zeros((0, len(CLASSES) + 6))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, bias) that minimise the non-negative PU risk."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    x_p, x_u = (positive - mean) / scale, (unlabelled - mean) / scale
    w, b = np.zeros(x_p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, STEPS + 1):
        z_p, z_u = x_p @ w + b, x_u @ w + b
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        up, down_p, down_u = -sigmoid(-z_p) / len(z_p), sigmoid(z_p) / len(z_p), sigmoid(z_u) / len(z_u)
        g_p, g_u = (prior * (up - down_p), down_u) if negative >= 0 else (prior * down_p, -down_u)
        g = np.append(x_p.T @ g_p + x_u.T @ g_u + WEIGHT_DECAY * w, g_p.sum() + g_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return mean, scale, w, float(b)


def prior_from(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, without negative labels.

    A logistic model tells trusted from unlabelled rows; above any cut of its scores the
    unlabelled hold at least that share of what the positives hold, and the least such ratio is the estimate.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    x_p, x_u = (positive - mean) / scale, (unlabelled - mean) / scale
    w, b = np.zeros(x_p.shape[1]), 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(PRIOR_STEPS):
        g_p, g_u = -sigmoid(-(x_p @ w + b)) / len(x_p), sigmoid(x_u @ w + b) / len(x_u)
        w, b = w - PRIOR_RATE * (x_p.T @ g_p + x_u.T @ g_u + 1e-3 * w), b - PRIOR_RATE * float(g_p.sum() + g_u.sum())
    s_p, s_u = x_p @ w, x_u @ w
    cuts = np.quantile(s_p, np.linspace(0.02, 0.8, 40))
    return float(min((s_u >= c).mean() / (s_p >= c).mean() for c in cuts))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def _feature_rows(batches):
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("trusted"), pa.array(list(x), pa.list_(pa.float64()))], ["trusted", "x"])


def learn(docs: DataFrame, labels: DataFrame):
    """Model over (doc_id, text) and (doc_id, quality); None if there is nothing to learn from."""
    may = (F.col("doc_id").isNotNull()) & ~held_out(F.col("doc_id"))
    known = labels.where(may & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.join(docs.where(may).select("doc_id").distinct(), "doc_id", "left_semi")
    share = known.agg(F.avg((F.col("quality") == 1).cast("double")).alias("p")).first()["p"]
    least = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    trusted = least(known.where("quality = 1").select("doc_id")).withColumn("trusted", F.lit(True))
    web = least(docs.where(may).select("doc_id").distinct()).withColumn("trusted", F.lit(False))
    drawn = F.broadcast(trusted.unionByName(web))  # 2 * FIT_ROWS rows at most
    rows = docs.where(may).join(drawn, "doc_id").select("trusted", "text").mapInArrow(_feature_rows, "trusted boolean, x array<double>").toArrow()
    if not rows.num_rows:
        return None
    flat = rows["x"].combine_chunks().flatten().to_numpy()
    x = flat.reshape(rows.num_rows, -1)
    is_trusted = rows["trusted"].combine_chunks().to_numpy(zero_copy_only=False)
    if not is_trusted.any() or is_trusted.all():
        return None
    # rows come in no fixed order: sums over a sorted matrix are the same in every run
    order = lambda part: part[np.lexsort(part.T)]
    positive, unlabelled = order(x[is_trusted]), order(x[~is_trusted])
    prior = share if share < 1 else prior_from(positive, unlabelled)
    return fit(positive, unlabelled, min(0.98, max(0.05, prior)))


def _scorer(model, into: str, text: str):
    def score(batches):
        for batch in batches:
            x = features(batch.column(text))
            if model is None:
                s = np.full(len(x), 0.5)
            else:
                mean, scale, w, b = model
                s = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w + b, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, into])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the chance of quality 1 as a last column, ``score_`` or, where that is taken, with an underscore more."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = learn(plain, labels.select(F.col("doc_id"), F.col("quality")))
    (into,) = fresh(docs, "score_")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scorer(model, into, text_col), f"{shape}, `{into}` double")


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("score_").alias("score"),
        (F.col("score_") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted to be of quality 1, with their columns."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(scored.columns[-1]) >= 0.5).select(*docs.columns)


QUERIES = {"op3_quality_pu": op3_quality_pu}
#: A fitted model has no SQL; tests measure held-out accuracy.
ORACLE: dict[str, str] = {}
