"""LM scoring: marginal probability of a text over all segmentations into subword pieces.

Pieces come from a public vocabulary file whose scores give their first weights; expectation maximisation over the training words then
fits the weights. A word is its bytes after a mark for its start; any byte is a piece as well, so each word has a
segmentation. Each training word, and the end, also is an edge of its own over its whole length, so what is gathered grows with the corpus:
with c of N training tokens it weighs c / (N + V), V being the number of different ones, and the paths of pieces weigh V / (N + V) in all.
A text's probability is the product of its words' and of the end's, so the forward recursion runs once for each different
word. Words are counted by a shuffle; the most frequent ones, of a bounded number, go to all tasks, the others meet
their scores in a join.
"""

from __future__ import annotations

from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .scratch import staged
from .text import Words, raw_texts, slices

#: Most words whose scores go to all tasks (24 bytes each).
TOP = 200_000
#: Most rounds of the fit, which ends before if a round adds less than this share to the log-likelihood.
ROUNDS, GAIN = 6, 0.002
#: Words of more bytes than this are worked on one at a time.
WIDE = 64
PRIOR = 0.1
_B = np.uint64(0x9E3779B97F4A7C15)
#: First bits of a hash that tell where its search begins.
BITS = 18
_START = 32


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(4)
def pieces(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Byte strings of the usable pieces, and their first log weights: a vocabulary's scores fall with rank, and weights fall as one over rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece.strip() and b" " not in piece[1:]:
            low = piece.lower()
            found[low] = max(found.get(low, -1e9), -np.log(10 - model.get_score(i)))
    for b in range(256):
        found.setdefault(bytes([b]), -np.log(1e6))
    names = sorted(found)
    w = np.array([found[p] for p in names])
    return names, w - np.logaddexp.reduce(w)


class Lattice:
    """Prefix table of the pieces and their log weights (natural)."""

    def __init__(self, names: list[bytes], weights: np.ndarray):
        self.names, self.weights = names, weights
        prefixes: dict[bytes, int] = {}
        for i, p in enumerate(names):
            for j in range(1, len(p)):
                prefixes.setdefault(p[:j], -1)
            prefixes[p] = i
        keys = np.array([self._hash(p) for p in prefixes], np.uint64)
        order = np.argsort(keys)
        # the last key ends every search
        self.keys, self.ids = np.append(keys[order], np.uint64(2**64 - 1)), np.append(np.array(list(prefixes.values()))[order], -1)
        self.first = np.searchsorted(self.keys, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS)).astype(np.int32)
        self.longest = max(map(len, names))
        self.table = prefixes

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 1
        for b in piece:
            h = ((h ^ (b + 1)) * int(_B) + 0x632BE59BD9B4E019) & (2**64 - 1)
        return h

    def weighted(self, weights: np.ndarray) -> Lattice:
        """The same pieces with other weights."""
        other = copy(self)
        other.weights = weights
        return other

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of the first key that is no less than each hash."""
        at = self.first[h >> np.uint64(64 - BITS)]
        late = np.flatnonzero(self.keys[at] < h)
        while len(late):
            at[late] += 1
            late = late[self.keys[at[late]] < h[late]]
        return at

    def edges(self, rows: np.ndarray):
        """Start, length, rows and pieces of all occurrences in words of one length (rows of bytes)."""
        n, m = rows.shape
        for i in range(m):
            live, h = np.arange(n), np.ones(n, np.uint64)
            for size in range(1, min(self.longest, m - i) + 1):
                h = (h ^ (rows[live, i + size - 1].astype(np.uint64) + np.uint64(1))) * _B + np.uint64(0x632BE59BD9B4E019)
                at = self.find(h)
                ok = self.keys[at] == h
                live, h, piece = live[ok], h[ok], self.ids[at[ok]]
                if not len(live):
                    break
                real = piece >= 0
                yield i, size, live[real], piece[real]

    def forward(self, rows: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log marginals of words of one length; with counts, the pieces' expected uses are added to ``expected``."""
        n, m = rows.shape
        alpha = np.full((m + 1, n), -np.inf)
        alpha[0] = 0
        kept = []
        for i, size, live, piece in self.edges(rows):
            w = alpha[i, live] + self.weights[piece]
            alpha[i + size, live] = np.logaddexp(alpha[i + size, live], w)
            if expected is not None:
                kept.append((i, size, live, piece))
        if expected is not None:
            beta = np.full((m + 1, n), -np.inf)
            beta[m] = 0
            for i, size, live, piece in reversed(kept):
                w = self.weights[piece] + beta[i + size, live]
                beta[i, live] = np.logaddexp(beta[i, live], w)
            for i, size, live, piece in kept:
                np.add.at(expected, piece, counts[live] * np.exp(alpha[i, live] + self.weights[piece] + beta[i + size, live] - alpha[m, live]))
        return alpha[m]

    def forward_one(self, word: bytes, count: float = 0.0, expected: np.ndarray | None = None) -> float:
        """The same for one word of any length, in time that grows with its length."""
        m, edges = len(word), []
        alpha = np.full(m + 1, -np.inf)
        alpha[0] = 0.0
        for i in range(m):
            for size in range(1, min(self.longest, m - i) + 1):
                k = self.table.get(word[i : i + size])
                if k is None:
                    break
                if k >= 0:
                    alpha[i + size] = np.logaddexp(alpha[i + size], alpha[i] + self.weights[k])
                    edges.append((i, size, k))
        if expected is not None:
            beta = np.full(m + 1, -np.inf)
            beta[m] = 0.0
            for i, size, k in reversed(edges):
                w = self.weights[k] + beta[i + size]
                beta[i] = np.logaddexp(beta[i], w)
                expected[k] += count * np.exp(alpha[i] + w - alpha[m])
        return float(alpha[m])

    def words(self, words: list[bytes], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log marginals of words, each given without its start mark; with counts, the pieces' expected uses are added to ``expected``."""
        out = np.empty(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for m in np.unique(size):
            at = np.flatnonzero(size == m)
            if m > WIDE:
                for i in at:
                    out[i] = self.forward_one(b" " + words[i], 0.0 if counts is None else counts[i], expected)
                continue
            for k in range(0, len(at), 8192):
                part = at[k : k + 8192]
                rows = np.empty((len(part), m + 1), np.uint8)
                rows[:, 0] = _START
                rows[:, 1:] = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(-1, m)
                out[part] = self.forward(rows, None if counts is None else counts[part], expected)
        return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings buf[starts:ends], lower-cased, as an Arrow array."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(_LOWER[buf[at]].tobytes())])


def word_counts(docs: DataFrame) -> DataFrame:
    """word, h (its hash), c (occurrences in training texts), n (in all) from train (boolean), text."""

    def of(batches):
        for b in batches:
            raw, train = raw_texts(b.column(1)), b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, e in slices(raw, 4 << 20):
                w = Words(raw[a:e])
                if not len(w.hash):
                    continue
                h, first, back, n = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
                c = np.bincount(back, train[a:e][w.doc], len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([_gather(w.buf, w.starts[first], w.ends[first]), pa.array(h.view(np.int64)), pa.array(c), pa.array(n)], ["word", "h", "c", "n"])

    return docs.mapInArrow(of, "word binary, h long, c long, n long").groupBy("word", "h").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(counts: DataFrame, texts: int, path: str | None = None, rounds: int = ROUNDS) -> tuple[Lattice, float]:
    """Lattice and the log probability that the end, and no word, comes next, by EM over the training words; the state that is summed is as large as the vocabulary."""
    names, weights = pieces(path)
    lattice = Lattice(names, weights)
    prior = PRIOR + 1000 * np.exp(weights)
    used = counts.where("c > 0").select("word", "c")
    starts = np.array([n[:1] == b" " for n in names])
    end, before = 0.0, None
    for _ in range(rounds):

        def expect(batches, weights=weights):
            now, total, ll = lattice.weighted(weights), np.zeros(len(names)), 0.0
            for b in batches:
                if b.num_rows:
                    c = b.column(1).to_numpy().astype(float)
                    ll += float(c @ now.words(b.column(0).to_pylist(), c, total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], ll))], ["piece", "x"])

        total, ll = prior.copy(), 0.0
        for row in used.mapInArrow(expect, "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x")).orderBy("piece").collect():
            if row.piece < 0:
                ll = row.x
            else:
                total[row.piece] += row.x
        every = total.sum() + texts + 1
        weights, end = np.log(total / every), float(np.log((texts + 1) / (total[starts].sum() + texts + 1)))
        if before is not None and ll - before < GAIN * abs(before):
            break
        before = ll
    return lattice.weighted(weights), end


def lm_scores(docs: DataFrame, train, path: str | None = None, top: int = TOP) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    ``train``: a boolean column, which rows to learn from; null is false. Tokens are the words, A-Z lower-cased, and one end. base_score is the log10 probability
    by word counts, 0.5 added to each; score the lattice's. Null and empty texts have the end alone. Repeated rows count and
    are scored each. Without training rows all words are new to both models and the lattice has pieces alone. An empty table gives an empty one; more columns are ignored.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col("text").cast("string").alias("text"))
    counts = staged(word_counts(rows.select("train", "text")))
    texts = rows.where("train").count()
    got = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, kinds = got.n + texts, got.v + (texts > 0)
    scale = total + 0.5 * (kinds + 1)
    lattice, end = fit(counts, texts, path)
    weight = max(kinds, 1)  # of the paths of pieces, in tokens

    def log10_of(c, lp):
        with np.errstate(divide="ignore"):
            return (np.logaddexp(np.log(c), np.log(weight) + lp) - np.log(total + weight)) / np.log(10)

    def score(batches):
        for b in batches:
            lp = log10_of(b.column(2).to_numpy().astype(float), lattice.words(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(lp)], ["h", "c", "n", "lp"])

    scored = staged(counts.mapInArrow(score, "h long, c long, n long, lp double"))
    bins = scored.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    least, have = None, 0
    for row in bins:
        have += row.k
        if have > top:
            break
        least = row.least
    common = scored.where(F.col("n") >= least).toPandas().sort_values("h") if least is not None else None
    keys, c_top, lp_top = (np.empty(0, np.int64), np.empty(0), np.empty(0)) if common is None else (common["h"].to_numpy(), common["c"].to_numpy(), common["lp"].to_numpy())
    base_top, known_top = np.log10((c_top + 0.5) / scale), (c_top > 0).astype(np.int64)
    base_end = float(np.log10(((texts if texts else 0) + 0.5) / scale))
    end_known, score_end = int(texts > 0), float(log10_of(float(texts), end))

    def of(batches):
        for b in batches:
            raw = raw_texts(b.column(1))
            for a, e in slices(raw):
                w = Words(raw[a:e])
                h = w.hash.view(np.int64)
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                weigh = lambda v: np.bincount(w.doc[hit], v[at[hit]], w.n) if len(keys) else np.zeros(w.n)
                rare = ~hit
                ends = np.concatenate(([0], np.cumsum(np.bincount(w.doc[rare], minlength=w.n)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array(w.count + 1), pa.array(weigh(known_top).astype(np.int64) + end_known), pa.array(weigh(base_top) + base_end), pa.array(weigh(lp_top) + score_end), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[rare]))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    schema = rows.select("doc_id").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"), ("rare", ArrayType(LongType()))):
        schema = schema.add(name, kind)
    parts = staged(rows.select("doc_id", "text").mapInArrow(of, schema).withColumn("row", F.monotonically_increasing_id()))
    # a word that is not common can still fill a text: its repeats are counted before they move
    rare = parts.where(F.size("rare") > 0).select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("k"))
    rare = rare.join(scored.where(F.col("n") < least) if least is not None else scored, "h")
    sums = rare.groupBy("row").agg(F.sum(F.col("k") * (F.col("c") > 0).cast("long")).alias("known"), F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / F.lit(scale))).alias("base"), F.sum(F.col("k") * F.col("lp")).alias("lp"))
    out = parts.drop("rare").join(sums, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return out.select("doc_id", "n_tokens", plus("n_known", "known"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "base"), plus("score", "lp"))


def op9_lattice(spark, sf_dir: str) -> DataFrame:
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scores = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~out)
    return scores.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
