"""Approximate nearest neighbours by inner product over shifted space-filling curves.

Vectors are projected to a few random directions, shifted and put on a Hilbert curve, several times anew. Each curve is cut into
ranges of about equal size, ordered inside a cell by one more direction of the curve; equal vectors share a place. A query looks at its own range and the next one on either side, on every curve. Candidates are
scored in double precision on the original vectors, and the best of all curves are merged.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

CURVES, DIMS, BITS = 12, 8, 5
#: A query sees the ranges of a curve that hold its own key and the ones beside it. A range has SHARE of all vectors, and at least LEAST.
SHARE, LEAST = 0.05, 256
#: Vectors, the first in the order of a seeded hash, on which scales and range bounds are fit.
SAMPLE = 20_000
#: Vectors and queries that meet in one task; a larger range is cut into pieces.
PIECE, CHUNK = 4096, 2048


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows) of 0 to 2**bits - 1, as uint64."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(n):
            on = (x[i] & high) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    key = np.zeros(len(turn), np.uint64)
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << np.uint64(1)) | (((c ^ turn) >> level) & 1).astype(np.uint64)
    return key


def along(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """x @ directions; equal rows always give the same bits, in any batch."""
    return np.stack([products(x, np.broadcast_to(d, x.shape)) for d in directions.T], axis=1)


class Curves:
    """Projections, shifts and range bounds."""

    def __init__(self, sample: np.ndarray, ranges: int, curves: int = CURVES, seed: int = 5):
        rng, width = np.random.default_rng(seed), sample.shape[1]
        dims = min(DIMS, width)
        self.maps = [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)]
        self.shift = rng.uniform(0, 0.5, (curves, dims))
        self.inner = [np.linalg.qr(rng.normal(size=(width, 1)))[0] for _ in range(curves)]
        self.middle = [along(sample, d)[:, 0].mean() for d in self.inner]
        self.reach = [8 * max(along(sample, d)[:, 0].std(), 1e-12) for d in self.inner]
        self.low, self.scale = [], []
        for m in self.maps:
            y = along(sample, m)
            mid, spread = y.mean(0), np.maximum(y.std(0), 1e-12) * 2.5
            self.low.append(mid - spread)
            self.scale.append(4 * spread)
        self.bounds = [np.quantile(self.key(k, sample), np.arange(1, ranges) / ranges, method="lower") if len(sample) else np.empty(0, np.uint64) for k in range(curves)]

    def key(self, curve: int, x: np.ndarray) -> np.ndarray:
        """Curve place, with the place along the inner direction behind it; of the vector alone."""
        u = ((along(x, self.maps[curve]) - self.low[curve]) / self.scale[curve] + self.shift[curve]) * (1 << BITS)
        inner = (along(x, self.inner[curve])[:, 0] - self.middle[curve]) / self.reach[curve] + 0.5
        tie = (np.clip(inner, 0, 1 - 2.0**-24) * (1 << 23)).astype(np.uint64)
        return (hilbert(np.clip(u, 0, (1 << BITS) - 1).astype(np.int64), BITS) << np.uint64(23)) | tie

    def range_of(self, curve: int, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds[curve], self.key(curve, x), "right")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; the same two rows always give the same bits."""
    return (np.ascontiguousarray(a) * np.ascontiguousarray(b)).sum(axis=1)


def _best(queries, qids, x, ids, k):
    """The k candidates of each query, ties to the smaller id."""
    s = queries @ x.T
    s[qids[:, None] == ids[None, :]] = -np.inf
    m = min(k, len(ids))
    edge = np.partition(s, len(ids) - m, axis=1)[:, len(ids) - m]
    slack = 1e-9 * np.maximum(1, np.linalg.norm(queries, axis=1) * np.linalg.norm(x, axis=1).max())
    r, c = np.nonzero((s >= (edge - slack)[:, None]) & (s > -np.inf))
    score = products(queries[r], x[c])
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return qids[r[keep]], ids[c[keep]], score[keep]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the distinct rows that take part."""
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(ok).dropDuplicates()


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row (vec_id, embedding) whose vec_id is divisible by ``every``.

    Rows without vec_id, with a null, empty or zero vector or one with null or non-finite components take no part. Vectors of each length are
    searched among themselves. Repeated rows count once; of rows that share a vec_id the best score counts. Of equal vectors only the k + 1
    smallest ids can be among the nearest, so the others stay out as candidates, not as queries. An empty table gives an empty one.

    A window is 3 ranges of max(least, share * n) of the n vectors on each curve. With share 0 windows are of a fixed number of vectors and
    work grows as queries do; that suits vectors with structure. Without structure (next to equal distances) recall then falls as n
    grows, and only a share of all vectors keeps it.
    """
    spark = vectors.sparkSession
    double = vectors.select(F.col("embedding")).dtypes[0][1] == "array<double>"
    rows = staged(usable(vectors).withColumn("w", F.size("v")))
    found = [_search(rows.where(F.col("w") == x.w).drop("w"), x.w, x.n, x.q, every, k, share, least, double) for x in rows.groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).orderBy("w").collect() if x.q]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _search(rows: DataFrame, width: int, n: int, queries: int, every: int, k: int, share: float, least: int, double: bool) -> DataFrame:
    """query_id, vec_id, score of the best that each curve's window holds; n rows of ``width`` numbers, of which some are queries."""
    alike = Window.partitionBy(F.xxhash64("v"), F.hash("v")).orderBy("vec_id")
    kept = staged(rows.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).drop("_n"))
    m = kept.count()
    sample = kept.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(SAMPLE).toPandas()
    ranges = int(max(1, m // max(least, share * m)))
    curves = Curves(np.stack(sample["v"].to_numpy()), ranges)
    pieces = int(-(-m // (ranges * PIECE)))
    chunks = int(-(-3 * queries // (ranges * CHUNK)))
    kind = np.float64 if double else np.float32

    def deal(query):
        def of(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy()
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                body = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                for c in range(len(curves.maps)):
                    at = curves.range_of(c, x)
                    for step in (-1, 0, 1) if query else (0,):
                        for other in range(pieces if query else chunks):
                            own = ids * 2654435761 % (1 << 31) % (chunks if query else pieces)
                            piece, chunk = (np.full(len(ids), other), own) if query else (own, np.full(len(ids), other))
                            ok = np.flatnonzero((at + step >= 0) & (at + step < ranges))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), c, np.int32)), pa.array((at + step)[ok].astype(np.int32)), pa.array(piece[ok].astype(np.int32)), pa.array(chunk[ok].astype(np.int32)), pa.array(np.full(len(ok), query)), b.column(0).take(pa.array(ok)), body.take(pa.array(ok))], ["curve", "range", "piece", "chunk", "q", "vec_id", "v"])

        return of

    schema = "curve int, range int, piece int, chunk int, q boolean, vec_id long, v binary"
    dealt = kept.mapInArrow(deal(False), schema).unionByName(rows.where(F.col("vec_id") % every == 0).mapInArrow(deal(True), schema))

    def search(pdf):
        q = pdf["q"].to_numpy()
        if q.all() or not q.any():
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        x = np.frombuffer(b"".join(pdf["v"]), kind).reshape(len(pdf), width).astype(np.float64)
        ids = pdf["vec_id"].to_numpy()
        a, b, s = zip(*[_best(x[q][i : i + 256], ids[q][i : i + 256], x[~q], ids[~q], k) for i in range(0, int(q.sum()), 256)])
        return pd.DataFrame({"query_id": np.concatenate(a), "vec_id": np.concatenate(b), "score": np.concatenate(s)})

    return dealt.groupBy("curve", "range", "piece", "chunk").applyInPandas(search, "query_id long, vec_id long, score double")


def op5_hilbert_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
