"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits or runs of other marks, case kept; features are single tokens, pairs of neighbours, and
echoes: pairs that stand again at a distance of 1 to 8 tokens, whatever their words, with one feature for each distance.
A text's feature value is its count over the root of the number of features, so a score is one sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import unused
from .text import Words, raw_texts, slices

BITS = 18
#: Most labelled rows that a fit takes, the first in the order of a seeded hash of doc_id.
FIT_ROWS = 8192
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-4, 1e-3
THRESHOLD = 0.3
ECHOES = range(1, 9)


def _features(raw: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, and where each text's begin."""
    w = Words(raw, lower=False, punctuation=True)
    one = (w.hash >> np.uint64(64 - bits)).astype(np.int32)
    doc, _, pair = w.grams(2)
    two = (pair >> np.uint64(64 - bits)).astype(np.int32)
    docs, found = [w.doc, doc], [one, two]
    for lag in ECHOES:
        h, d = w.hash, w.doc
        at = np.flatnonzero((h[lag + 1 :] == h[1 : len(h) - lag]) & (h[lag:-1] == h[: len(h) - lag - 1]) & (d[lag + 1 :] == d[: len(d) - lag - 1])) if len(h) > lag + 1 else np.empty(0, np.int64)
        docs.append(d[at])
        found.append(np.full(len(at), lag, np.int32))
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(doc[order], np.arange(w.n + 1))


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after per-coordinate FTRL-proximal steps over (label, different feature numbers, their counts), in the order given."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    work = []
    for y, i, c in rows:
        work.append((y, np.append(i, np.int32(bias)), np.append(c / np.sqrt(max(1, c.sum())), 1.0)))
    for _ in range(epochs):
        for y, i, x in work:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(len(z)))
    return w[:bias], float(w[bias])


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Fit on at most ``most`` different rows of labels (doc_id, quality) whose text is in docs; one task sees them, in a fixed order.

    Labels that are null or not 0 or 1 are left out, as are rows without doc_id. A label counts once, with one of the texts if its
    doc_id has several; null and empty texts count as such. Without any label the weights are zero. What the one task holds is
    bounded: at most ``most`` rows of at most 2 ** bits different features, 8 bytes each.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("_h")).distinct().orderBy("_h", "_id", "quality").limit(most)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_h", "_id", "quality", "text")

    def feature_rows(batches):
        for b in batches:
            raw = raw_texts(b.column(3))
            found = []
            for a, e in slices(raw):
                f, ptr = _features(raw[a:e], bits)
                for i in range(e - a):
                    found.append(np.concatenate(np.unique(f[ptr[i] : ptr[i + 1]], return_counts=True)).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.binary())], ["_h", "_id", "quality", "f"])

    def fit(batches):
        rows = [(y, *np.frombuffer(f, "<i4").reshape(2, -1)) for b in batches for y, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        w, bias = ftrl(rows, bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])

    # repeats of a doc_id are reduced before the shuffle
    rows = texts.mapInArrow(feature_rows, "_h long, _id long, quality int, f binary").groupBy("_h", "_id", "quality").agg(F.min("f").alias("f"))
    got = rows.repartition(1).sortWithinPartitions("_h", "_id", "quality").mapInArrow(fit, "w binary, bias double").collect()
    return (np.frombuffer(got[0].w), got[0].bias) if got else (np.zeros(1 << bits), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], columns: list[str], bits: int = BITS, text: str = "text", out: str = "score") -> DataFrame:
    """``columns`` of docs and ``out`` (one of that name is replaced), the probability of label 1; null and empty texts have the bias alone. 2 MB of weights go along."""
    w, bias = model
    columns = [c for c in columns if c != out]
    schema = docs.select(*columns).schema.add(out, "double")

    def of(batches):
        for b in batches:
            raw = raw_texts(b.column(len(columns)))
            p = np.empty(len(raw))
            for a, e in slices(raw):
                f, ptr = _features(raw[a:e], bits)
                total = np.concatenate(([0.0], np.cumsum(w[f])))
                size = np.diff(ptr)
                z = bias + (total[ptr[1:]] - total[ptr[:-1]]) / np.sqrt(np.maximum(size, 1))
                p[a:e] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(p)], [*columns, out])

    return docs.select(*columns, F.col(text).cast("string").alias(unused(docs, "_text"))).mapInArrow(of, schema)


def held_out(fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == fold, F.lit(False))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~held_out(0)))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
