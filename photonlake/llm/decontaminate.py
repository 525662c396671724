"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment on words.

All word n-grams of an item are its seeds, so that an edited or partial copy is found by whichever are left. Where a document
has a seed, and enough of the item's words around it, those words are aligned with the item's; the score is the best local alignment over the item's number of words,
1 for a verbatim copy; an item of more than SEGMENT words scores as the best of its parts, each over its own number of words. An
item of fewer words than a seed has is one seed. The benchmark is worked on in blocks of bounded size, documents are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, mix, raw_texts, slices

N, THRESHOLD = 3, 0.45
MATCH, MISMATCH, GAP = 1.0, -0.4, -0.4
#: Most words of an item that are aligned at once; a longer item counts as several parts of about equal length.
SEGMENT = 256
#: Words of the benchmark in a block, and items in one.
BLOCK_WORDS, BLOCK_ITEMS = 2_000_000, 20_000
#: Windows aligned at once, and seed hits sorted at once, unless a single text has more.
LANES, HITS = 2048, 4 << 20


class Index:
    """Seeds of a block of items; sizes: the numbers of words that they have."""

    def __init__(self, ids: list[int], words: list[np.ndarray], grams: list[np.ndarray], n: int):
        self.ids, self.words = ids, words
        self.sizes = sorted({min(n, len(x)) for x in words})
        h = np.concatenate(grams) if ids else np.empty(0, np.uint64)
        seg = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if ids else np.empty(0, np.int64)
        at = np.concatenate([np.arange(len(g)) for g in grams]) if ids else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.seg, self.at = h[order], seg[order], at[order]
        self.quick = np.zeros(1 << 20, bool)
        self.quick[self.h & np.uint64((1 << 20) - 1)] = True


def align(item: np.ndarray, windows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best local alignment score of each item (row, padded with zeros) with its window (row, padded with zeros)."""
    n, width = windows.shape
    slope = -GAP * np.arange(1, width + 1)
    before, best = np.zeros((n, width)), np.zeros(n)
    for i in range(item.shape[1]):
        s = np.where((windows == item[:, i : i + 1]) & (windows != 0), MATCH, MISMATCH)
        diagonal = np.zeros((n, width))
        diagonal[:, 1:] = before[:, :-1]
        row = np.maximum(np.maximum(diagonal + s, before + GAP), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        row[i >= size] = 0
        best = np.maximum(best, row.max(axis=1))
        before = row
    return best


def _seeds(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and hash of every run of k words; runs of other lengths have other hashes."""
    doc, at, h = w.grams(k)
    return doc, at, mix(h ^ np.uint64(k))


def _hits(raw: list, index: Index, threshold: float):
    """Text number, item id and score of every text and item that reach the threshold."""
    w = Words(raw)
    doc, at, h = (np.concatenate(x) for x in zip(*[_seeds(w, k) for k in index.sizes])) if index.sizes else (np.empty(0, np.int64),) * 3
    if len(index.sizes) > 1:
        order = np.argsort(doc, kind="stable")
        doc, at, h = doc[order], at[order], h[order]
    if not len(h):
        return []
    some = np.flatnonzero(index.quick[h & np.uint64((1 << 20) - 1)])
    left, right = np.searchsorted(index.h, h[some], "left"), np.searchsorted(index.h, h[some], "right")
    count = right - left
    some, left, count = some[count > 0], left[count > 0], count[count > 0]
    if not len(some):
        return []
    found: dict[tuple[int, int], float] = {}
    whole = np.concatenate((np.flatnonzero(doc[some][1:] != doc[some][:-1]) + 1, [len(some)]))
    ends, start = np.cumsum(count), 0
    while start < len(some):
        most = ends[start] - count[start] + HITS
        k = np.searchsorted(ends[whole - 1], most, "right") - 1
        stop = int(max(whole[k] if k >= 0 else 0, whole[np.searchsorted(whole, start, "right")]))
        _aligned(w, index, doc[some[start:stop]], at[some[start:stop]], left[start:stop], count[start:stop], threshold, found)
        start = stop
    return [(d, i, s) for (d, i), s in sorted(found.items())]


def _promising(w: Words, index: Index, doc: np.ndarray, seg: np.ndarray, a: np.ndarray, z: np.ndarray, threshold: float) -> np.ndarray:
    """Which windows hold enough of the item's words; each adds 1 to the score at most, so that the others stay below the threshold."""
    live = np.zeros(w.n, bool)
    live[doc] = True
    place = np.flatnonzero(live[w.doc])
    names, code = np.unique(w.hash[place], return_inverse=True)
    total = len(w.hash) + 1
    key = np.sort(code * total + place)
    size = np.fromiter(map(len, index.words), np.int64, len(index.words))[seg]
    ok = np.zeros(len(seg), bool)
    for k in range(0, len(seg), LANES):
        lane = slice(k, k + LANES)
        item = np.concatenate([index.words[j] for j in seg[lane]])
        of = np.repeat(np.arange(len(seg[lane])), size[lane])
        c = np.minimum(np.searchsorted(names, item), len(names) - 1)
        at = np.minimum(np.searchsorted(key, c * total + a[lane][of]), len(key) - 1)
        there = (names[c] == item) & (key[at] >= c * total + a[lane][of]) & (key[at] < c * total + z[lane][of])
        ok[lane] = np.bincount(of, there, len(seg[lane])) >= threshold * size[lane] - 1e-6
    return ok


def _aligned(w: Words, index: Index, doc: np.ndarray, at: np.ndarray, left: np.ndarray, count: np.ndarray, threshold: float, found: dict) -> None:
    """Puts the best score of every text and item into found; doc, at: each seed's place, left, count: its entries in the index."""
    each = np.repeat(np.arange(len(count)), count)
    entry = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + left[each]
    seg, doc, shift = index.seg[entry], doc[each], at[each] - index.at[entry]
    order = np.lexsort((shift, seg, doc))
    seg, doc, shift = seg[order], doc[order], shift[order]
    size = np.fromiter(map(len, index.words), np.int64, len(index.words))
    # one window for neighbouring diagonals of a text and item; a wide one starts anew
    slack = np.maximum(4, size[seg] // 4)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1]) | (shift[1:] - shift[:-1] > slack[1:])))
    head = np.flatnonzero(new)
    low, high = shift[head], np.maximum.reduceat(shift, head)
    wide = (high - low) // (2 * slack[head]) + 1
    cell = np.repeat(np.arange(len(head)), wide)
    part = np.arange(len(cell)) - np.repeat(np.cumsum(wide) - wide, wide)
    seg, doc, slack, low = seg[head][cell], doc[head][cell], slack[head][cell], low[cell] + 2 * slack[head][cell] * part
    a = np.maximum(low - slack, w.ptr[doc])
    z = np.minimum(low + 3 * slack + size[seg], w.ptr[doc + 1])
    ok = _promising(w, index, doc, seg, a, z, threshold)
    seg, doc, a, z = seg[ok], doc[ok], a[ok], z[ok]
    by_size = np.argsort(size[seg], kind="stable")
    for k in range(0, len(by_size), LANES):
        lane = by_size[k : k + LANES]
        m = int(size[seg[lane]].max())
        items = np.zeros((len(lane), m), np.uint64)
        width = int((z[lane] - a[lane]).max())
        windows = np.zeros((len(lane), width), np.uint64)
        for r, j in enumerate(lane):
            items[r, : size[seg[j]]] = index.words[seg[j]]
            windows[r, : z[j] - a[j]] = w.hash[a[j] : z[j]]
        for j, s in zip(lane, align(items, windows, size[seg[lane]]) / size[seg[lane]]):
            key = (int(doc[j]), index.ids[seg[j]])
            if s >= threshold and s > found.get(key, 0):
                found[key] = float(s)


def _blocks(benchmark: DataFrame):
    ids, texts, words = [], [], 0
    for row in benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1] or "")
        words += len(texts[-1]) // 4
        if words > BLOCK_WORDS or len(ids) >= BLOCK_ITEMS:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def _index(ids: list[int], texts: list[str], n: int) -> Index:
    w = Words([t.encode() for t in texts])
    names, words, grams = [], [], []
    seeds = {k: _seeds(w, k) for k in range(1, n + 1)}
    for d in range(w.n):
        mine = w.hash[w.ptr[d] : w.ptr[d + 1]]
        k = min(n, len(mine))
        if not k:
            continue
        doc, _, h = seeds[k]
        own = h[np.searchsorted(doc, d) : np.searchsorted(doc, d + 1)]
        parts = -(-len(mine) // SEGMENT)
        for part in range(parts):
            a, z = len(mine) * part // parts, len(mine) * (part + 1) // parts
            names.append(ids[d])
            words.append(mine[a:z])
            grams.append(own[a : z - k + 1])
    return Index(names, words, grams, n)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """doc_id, item_id, score of every document and item (item_id, text) that align at or above the threshold.

    Null and empty texts match nothing, an item of fewer than n words matches where it stands whole; items without item_id are left out. Repeated rows of docs give
    repeated rows; of items that share an id the best counts. More columns are ignored. Empty tables give an empty one.
    """
    out = None
    for ids, texts in _blocks(benchmark):
        index = _index(ids, texts, n)

        def of(batches, index=index):
            for b in batches:
                raw = raw_texts(b.column(1))
                for a, e in slices(raw):
                    got = _hits(raw[a:e], index, threshold)
                    at = pa.array([a + d for d, _, _ in got], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([i for _, i, _ in got], pa.int64()), pa.array([s for _, _, s in got], pa.float64())], ["doc_id", "item_id", "score"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, item_id long, score double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = N, least: int = N) -> DataFrame:
    """The rows of docs, with all their columns, that align with no item of at least ``least`` words at or above the threshold.

    A word or two of a shorter item are no proof of a leak, so contamination() reports them but no row goes for them. Null and empty texts
    stay, repeated rows stay or go alike, and an empty benchmark leaves all rows.
    """
    for ids, texts in _blocks(benchmark.where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= least)):
        index, names = _index(ids, texts, n), docs.columns

        def of(batches, index=index, at=names.index("text")):
            for b in batches:
                raw = raw_texts(b.column(at))
                keep = np.ones(len(raw), bool)
                for a, e in slices(raw):
                    keep[[a + d for d, _, _ in _hits(raw[a:e], index, threshold)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(of, docs.schema)
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
