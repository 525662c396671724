"""Vectorised word, shingle and hash arithmetic over Arrow batches.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; lower-casing touches A-Z alone.
A null text counts as an empty one. Texts are worked on whole; slices only bound the memory of one step.
Hashes are 64 bits and the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on, unless a single text is longer.
SLICE = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = _BYTE.copy()
_LOW[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE + (1 << 16)), base, np.uint64)
        full[0] = 1
        have = np.cumprod(full)
        if n <= SLICE + (1 << 16):
            _powers[name] = have
    return have[:n]


def raw_texts(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each value, without copies; null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if len(column) == 0:
        return []
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    found = [view[a:b] for a, b in zip(ends, ends[1:])]
    if column.null_count:
        found = [b if ok else memoryview(b"") for b, ok in zip(found, column.is_valid().to_pylist())]
    return found


def trim() -> None:
    """Gives memory that is free back to the system: workers wait for their next task beside others that work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(raw: list, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row; free memory is given back behind the last."""
    start, size = 0, 0
    for i, b in enumerate(raw):
        if i > start and size + len(b) > most:
            yield start, i
            start, size = i, 0
        size += len(b)
    if len(raw) > start:
        yield start, len(raw)
    trim()


class Words:
    """Hash and place of every word of some texts; ``ptr[d]:ptr[d + 1]`` are those of text d."""

    def __init__(self, raw: list, lower: bool = True, punctuation: bool = False):
        self.n = len(raw)
        lens = np.fromiter(map(len, raw), np.int64, self.n)
        self.base = np.concatenate(([0], np.cumsum(lens + 1)))
        self.buf = buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8) if self.n else np.full(1, 32, np.uint8)
        kind = _CLASS[buf] if punctuation else (~_SPACE[buf]).view(np.int8)
        change = np.flatnonzero(np.diff(kind)) + 1
        edges = np.concatenate(([0], change))
        live = kind[edges] != 0
        ends = np.concatenate((change, [len(buf)]))
        self.starts, self.ends = edges[live], ends[live]
        total = np.cumsum((_LOW if lower else _BYTE)[buf] * _power("r", _R, len(buf)))
        before = np.where(self.starts > 0, total[self.starts - 1], np.uint64(0))
        self.hash = mix((total[self.ends - 1] - before) * _power("i", _RINV, len(buf))[self.starts])
        self.ptr = np.searchsorted(self.starts, self.base)
        self.count = np.diff(self.ptr)
        self.doc = np.repeat(np.arange(self.n), self.count)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def grams(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and hash of every run of k words inside a text; short: a text of 1 to k - 1 words has all of them as one run."""
        m = len(self.hash) - k + 1
        if m > 0:
            h = self.hash[:m].copy()
            for j in range(1, k):
                h = h * _STEP + self.hash[j : j + m]
            ok = self.doc[:m] == self.doc[k - 1 :] if k > 1 else np.ones(m, bool)
            at = np.flatnonzero(ok)
            doc, h = self.doc[at], mix(h[at])
        else:
            at = doc = np.empty(0, np.int64)
            h = np.empty(0, np.uint64)
        if short and len(few := np.flatnonzero((self.count > 0) & (self.count < k))):
            extra = []
            for d in few:
                x = np.uint64(self.count[d])
                with np.errstate(over="ignore"):
                    for w in self.hash[self.ptr[d] : self.ptr[d + 1]]:
                        x = x * _STEP + w
                extra.append(x)
            doc, at, h = np.concatenate((doc, few)), np.concatenate((at, self.ptr[few])), np.concatenate((h, mix(np.array(extra, np.uint64))))
        return doc, at, h


_CLASS = np.full(256, 2, np.int8)  # 0 space, 1 letters, digits and what is not ASCII, 2 the rest
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, ascending, one text after the other, and where each text's begin."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
        doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(n + 1))
