"""Vectorised decoders and encoders of event recordings: bytes to columns and back.

A decoder gives (t, x, y, p, trigger_t, trigger_p, trigger_id). Bit layouts are those of the public formats.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import warnings
from collections.abc import Iterator

import numpy as np

from .aedat import aedat3, aedat4, encode4

#: What the names of compressed files end with.
COMPRESSED = (".gz", ".bz2", ".xz", ".zst")
_NONE = (np.empty(0, np.int64),) * 3


def decompress(path: str, data: bytes) -> tuple[str, bytes]:
    """Name without a compression suffix, and the plain bytes."""
    for suffix, f in ((".gz", gzip.decompress), (".bz2", bz2.decompress), (".xz", lzma.decompress)):
        if path.endswith(suffix):
            return path[: -len(suffix)], f(data)
    if path.endswith(".zst"):
        import zstandard

        return path[:-4], zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
    return path, data


def header(data: bytes) -> tuple[dict[str, str], int]:
    """Fields of the leading ``% key value`` lines, and where the rest begins."""
    found, at = {}, 0
    while data[at : at + 2] == b"% ":
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        key, _, value = data[at + 2 : end].decode("latin-1").strip().partition(" ")
        found[key] = value.strip()
        at = end + 1
        if key == "end":
            break
    return found, at


def sniff(path: str, data: bytes) -> str:
    """Format by suffix, else by the first 512 bytes."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "bin":
        raise NotImplementedError("the .bin format is reserved")
    if suffix in EXTRA:
        return suffix
    fixed = {"dat": "dat", "csv": "csv", "txt": "csv", "npz": "npz", "aer": "aer", "evt2": "evt2", "evt21": "evt21", "evt4": "evt4", "evt3": "evt3", "aedat4": "aedat4", "h5": "hdf5", "hdf5": "hdf5"}
    if suffix in fixed:
        return fixed[suffix]
    head, fields = data[:512], header(data)[0]
    if "Version" in fields or fields.get("Data", "").startswith("file"):
        return "dat"
    if head.startswith(b"#!AER-DAT"):
        return "aedat" + head[9:10].decode()
    declared = (fields.get("format", "").split(";")[0] or ("EVT" + fields["evt"] if "evt" in fields else "")).upper()
    known = {"EVT2": "evt2", "EVT2.0": "evt2", "EVT2.1": "evt21", "EVT21": "evt21", "EVT3": "evt3", "EVT3.0": "evt3", "EVT4": "evt4"}
    if declared in known:
        return known[declared]
    if suffix in ("raw", "evt") or fields:
        return "evt3"
    raise ValueError(f"unknown format: {path}")


def _carry(hit: np.ndarray, value: np.ndarray, start: int = 0) -> np.ndarray:
    """At each place the value at the last hit so far, or start."""
    at = np.flatnonzero(hit)
    return np.repeat(np.concatenate(([start], value[at])), np.diff(np.concatenate(([0], at, [len(hit)]))))


def _clock(value: np.ndarray, hit: np.ndarray, state: dict) -> tuple[np.ndarray, np.ndarray]:
    """At each place the value at the last hit so far, and how often these values have gone down; state goes from piece to piece."""
    at = np.flatnonzero(hit)
    down = np.zeros(len(hit), np.int64)
    if len(at):
        down[at] = value[at] < np.concatenate(([state.get("high", 0)], value[at][:-1]))
    high, wraps = _carry(hit, value, state.get("high", 0)), np.cumsum(down) + state.get("wraps", 0)
    if len(hit):
        state |= {"high": int(high[-1]), "wraps": int(wraps[-1])}
    return high, wraps


def _from_first(state: dict, hit: np.ndarray, *columns: np.ndarray):
    """Columns from the first hit on, at the start of a recording that has one."""
    a = int(np.argmax(hit)) if not state and hit.any() else 0
    return tuple(c[a:] for c in columns)


def _spread(mask: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and set bits (of 32 at most), ascending."""
    bits = np.unpackbits(mask.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.nonzero(bits.view(bool))


# Decoders of pieces: a recording may be cut before words that set the high part of the clock (see cuts), and ``state`` is what one
# piece leaves to the next; an empty one is the start.


def evt2(body: bytes, state: dict | None = None):
    state = {} if state is None else state
    w = np.frombuffer(body[: len(body) // 4 * 4], "<u4").astype(np.int64)
    (w,) = _from_first(state, w >> 28 == 8, w)
    kind, value = w >> 28, w & 0xFFFFFFF
    high, wraps = _clock(value, kind == 8, state)
    t = (high << 6) + (wraps << 34) + ((w >> 22) & 63)
    ev, tr = kind <= 1, kind == 10
    return t[ev], (w[ev] >> 11) & 2047, w[ev] & 2047, kind[ev], t[tr], w[tr] & 1, (w[tr] >> 8) & 15


def evt21(body: bytes, state: dict | None = None):
    state = {} if state is None else state
    w = np.frombuffer(body[: len(body) // 8 * 8], "<u8")
    low, top = (w & np.uint64(0xFFFFFFFF)).astype(np.int64), (w >> np.uint64(32)).astype(np.int64)
    low, top = _from_first(state, low >> 28 == 8, low, top)
    kind, value = low >> 28, low & 0xFFFFFFF
    high, wraps = _clock(value, kind == 8, state)
    t = (high << 6) + (wraps << 34) + ((low >> 22) & 63)
    ev, tr = np.flatnonzero(kind <= 1), kind == 10
    row, bit = _spread(top[ev], 32)
    at = ev[row]
    return t[at], ((low[at] >> 11) & 2047) + bit, low[at] & 2047, kind[at], t[tr], top[tr] & 1, (top[tr] >> 8) & 31


def evt4(body: bytes, state: dict | None = None):
    state = {} if state is None else state
    w = np.frombuffer(body[: len(body) // 4 * 4], "<u4").astype(np.int64)
    kind, at = w >> 28, np.arange(len(w))
    # the word behind a vector word is its mask, whatever it looks like: in a row of such words every second one, and the one behind an odd row
    like = (kind == 12) | (kind == 13)
    before = np.concatenate(([False], like[:-1])) if len(w) else like
    vector = like & ((at - _carry(like & ~before, at)) % 2 == 0)
    mask = np.concatenate(([False], vector[:-1])) if len(w) else like
    kind = np.where(mask, -1, kind)
    w, kind = _from_first(state, kind == 14, w, kind)
    value = w & 0xFFFFFFF
    high, wraps = _clock(value, kind == 14, state)
    t = (high << 6) + (wraps << 34) + ((w >> 22) & 63)
    one = np.flatnonzero((kind == 10) | (kind == 11))
    many = np.flatnonzero(((kind == 12) | (kind == 13)) & (np.arange(len(w)) + 1 < len(w)))
    row, bit = _spread(w[many + 1], 32) if len(many) else (np.empty(0, int), np.empty(0, int))
    at, add = np.concatenate((one, many[row])), np.concatenate((np.zeros(len(one), np.int64), bit))
    order = np.argsort(at, kind="stable")
    at, add = at[order], add[order]
    tr = kind == 9
    return t[at], ((w[at] >> 11) & 2047) + add, w[at] & 2047, kind[at] & 1, t[tr], w[tr] & 1, (w[tr] >> 8) & 31


def evt3(body: bytes, state: dict | None = None, strict: bool = False):
    """16-bit words. A group is a VECT_12, a second one behind it, and a VECT_8 behind that; each moves the base on by 32. A VECT_8
    elsewhere is passed over with a warning, or is an error if strict. Only TIME_LOW moves the clock."""
    state = {} if state is None else state
    w = np.frombuffer(body[: len(body) // 2 * 2], "<u2").astype(np.int64)
    (w,) = _from_first(state, w >> 12 == 8, w)
    kind, value, at = w >> 12, w & 0xFFF, np.arange(len(w))
    high, wraps = _clock(value, kind == 8, state)
    t = _carry(kind == 6, (wraps << 24) + (high << 12) + value, state.get("t", 0))
    y = _carry(kind == 0, w & 2047, state.get("y", 0))
    vec12 = kind == 4
    before = np.concatenate(([False], vec12[:-1])) if len(w) else vec12
    second = vec12 & ((at - _carry(vec12 & ~before, at)) % 2 == 1)
    third = (kind == 5) & (np.concatenate(([False], second[:-1])) if len(w) else vec12)
    stray = int(((kind == 5) & ~third).sum())
    if stray and strict:
        raise ValueError("vector word that follows no group")
    if stray:
        warnings.warn(f"{stray} vector words follow no group and are passed over", stacklevel=2)
    group = np.cumsum(vec12 & ~second)
    base = kind == 3
    origin = _carry(base, (w & 2047) - 32 * group, state.get("origin", 0)) + 32 * (group - 1)
    polarity = _carry(base, (w >> 11) & 1, state.get("polarity", 0))
    if len(w):
        state |= {"t": int(t[-1]), "y": int(y[-1]), "origin": int(origin[-1]) + 32, "polarity": int(polarity[-1])}
    one, many = np.flatnonzero(kind == 2), np.flatnonzero(vec12 | third)
    row, bit = _spread(w[many] & np.where(third[many], 0xFF, 0xFFF), 12) if len(many) else (np.empty(0, int), np.empty(0, int))
    place, add = np.concatenate((one, many[row])), np.concatenate((np.zeros(len(one), np.int64), bit))
    order = np.argsort(place, kind="stable")
    place, add = place[order], add[order]
    single = kind[place] == 2
    x = np.where(single, w[place] & 2047, (origin[place] + 12 * second[place] + 24 * third[place] + add) & 65535)
    p = np.where(single, (w[place] >> 11) & 1, polarity[place])
    tr = kind == 10
    return t[place], x, y[place], p, t[tr], w[tr] & 1, (w[tr] >> 8) & 15


def dat(body: bytes, state: dict | None = None):
    """Records of 8 bytes, without the two bytes that tell their type and size."""
    state = {} if state is None else state
    w = np.frombuffer(body[: len(body) // 8 * 8], "<u4").reshape(-1, 2).astype(np.int64)
    _, wraps = _clock(w[:, 0], np.ones(len(w), bool), state)
    d = w[:, 1]
    return w[:, 0] + (wraps << 32), d & 16383, (d >> 14) & 16383, (d >> 28) & 1, *_NONE


#: Bytes a word, bits to shift a word for its kind, and the kind that sets the high part of the clock, of formats that are cut there.
PIECEWISE = {"evt2": (4, 28, 8), "evt21": (8, 28, 8), "evt3": (2, 12, 8), "evt4": (4, 28, 14), "dat": (8, None, None)}
#: Bytes that are decoded at once.
PIECE = 4 << 20
#: Bytes in which a word that sets the clock is looked for at once.
LOOK = 1 << 16


def body_at(fmt: str, data: bytes) -> int:
    """Where the words of a recording begin; refuses what the decoders do not read."""
    fields, at = header(data)
    if fmt == "evt21" and (order := fields.get("endianness", "legacy").lower()) != "legacy":
        raise NotImplementedError(f"EVT2.1 of endianness {order}")
    if fmt == "dat":
        if len(data) >= at + 2 and data[at + 1] not in (0, 8):
            raise NotImplementedError("DAT records of another size than 8")
        at += 2
    return at


class Words:
    """Bytes of a recording by their place: of a buffer, or of an open file, which is read as they are asked for."""

    def __init__(self, source):
        if hasattr(source, "read_at"):
            self.end, self.take = source.size(), lambda at, n: source.read_at(n, at)
        else:
            view = memoryview(source)
            self.end, self.take = len(view), lambda at, n: view[at : at + n]

    def head(self) -> bytes:
        """The first bytes, up to some way behind the header."""
        n = 1 << 16
        while True:
            found = bytes(self.take(0, n))
            if n >= self.end or header(found)[1] < n - 512:
                return found
            n *= 2


def spans(fmt: str, words: Words, start: int, end: int, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Begin and end of pieces of about ``size`` bytes. All but the first begin where a word sets the clock, which is looked for in small steps."""
    wide, shift, kind = PIECEWISE[fmt]
    at = start + size // wide * wide
    while at < end:
        if shift is not None:
            room = min(size, LOOK, end - at) // wide * wide
            w = np.frombuffer(words.take(at, room), f"<u{wide}")
            w = (w & 0xFFFFFFFF if wide == 8 else w) >> shift
            hit = w == kind
            if fmt == "evt4":  # what follows a vector word may be its mask
                last = np.concatenate((np.frombuffer(words.take(at - 4, 4), "<u4") >> 28, w[:-1]))
                hit &= (last != 12) & (last != 13)
            if not hit.any():
                at += max(len(w), 1) * wide
                continue
            at += int(np.argmax(hit)) * wide
        yield start, at
        start, at = at, at + size // wide * wide
    yield start, end


def pieces(fmt: str, data, size: int = PIECE, **options):
    """The columns of a recording (bytes or an open file) piece by piece, in memory that a piece bounds."""
    words, state = Words(data), {}
    for a, z in spans(fmt, words, body_at(fmt, words.head()), words.end, size):
        yield globals()[fmt](bytes(words.take(a, z - a)), state, **options)


def aer(body: bytes, t_start: int = 0, t_step: int = 0, timestamps=None):
    """Times by a step, or as given, one for each event at least."""
    w = np.frombuffer(body[: len(body) // 4 * 4], "<u4").astype(np.int64)
    if timestamps is None:
        t = t_start + t_step * np.arange(len(w))
    else:
        t = np.asarray(timestamps, np.int64)
        if t.ndim != 1 or len(t) < len(w):
            raise ValueError("timestamps must be one number for each event")
        t = t[: len(w)]
    return t, (w >> 9) & 511, w & 511, (w >> 18) & 1, *_NONE


def _after_comments(data: bytes) -> bytes:
    at = 0
    while data[at : at + 1] == b"#":
        at = data.find(b"\n", at) + 1 or len(data)
    return data[at:]


def aedat1(data: bytes):
    body = _after_comments(data)
    r = np.frombuffer(body[: len(body) // 6 * 6], np.dtype([("a", ">u2"), ("t", ">u4")]))
    a, t = r["a"].astype(np.int64), r["t"].astype(np.int64)
    t = t + (np.cumsum(np.concatenate((np.zeros(min(1, len(t)), np.int64), t[:-1] - t[1:] > 1 << 31))) << 32)
    return t, (a >> 1) & 127, (a >> 8) & 127, a & 1, *_NONE


def aedat2(data: bytes, layout: str = "davis"):
    if layout not in ("davis", "dvs128"):
        raise ValueError("layout is davis or dvs128")
    body = _after_comments(data)
    r = np.frombuffer(body[: len(body) // 8 * 8], ">u4").reshape(-1, 2).astype(np.int64)
    a, t = r[:, 0], r[:, 1]
    t = t + (np.cumsum(np.concatenate((np.zeros(min(1, len(t)), np.int64), t[:-1] - t[1:] > 1 << 31))) << 32)
    if layout == "dvs128":
        return t, (a >> 1) & 127, (a >> 8) & 127, a & 1, *_NONE
    live = a >> 31 == 0
    special = live & (((a >> 10) & 3 == 1) | ((a >> 10) & 3 == 3))
    ev = live & ~special
    return t[ev], (a[ev] >> 12) & 1023, (a[ev] >> 22) & 511, (a[ev] >> 11) & 1, t[special], (a[special] >> 11) & 1, np.zeros(special.sum(), np.int64)


def csv(data: bytes, delimiter: str = ",", order: tuple[str, ...] = ("t", "x", "y", "p")):
    """Leading digits count, what is no number or beyond 64 bits is 0, missing fields are 0, blank lines are skipped, integers wrap to their width."""
    import re

    lines = [s for s in data.decode("utf-8", "replace").splitlines() if s.strip()]
    names = [c.strip().lower() for c in lines[0].split(delimiter[0])] if lines else []
    if any(c in "txyp" and c for c in names):
        if not {"t", "x", "y", "p"} <= set(names):
            raise ValueError("the header lacks a column")
        order, lines = tuple(names), lines[1:]
    number = re.compile(r"[ \t]*([+-]?\d+)")
    whole = lambda f: n if (m := number.match(f)) and -(2**63) <= (n := int(m[1])) < 2**63 else 0
    table = [[whole(f) for f in s.split(delimiter[0])] for s in lines]
    col = lambda c: np.array([r[order.index(c)] if order.index(c) < len(r) else 0 for r in table], np.int64)
    return col("t"), col("x") & 65535, col("y") & 65535, col("p") & 255, *_NONE


def npz(data: bytes):
    z = np.load(io.BytesIO(data), allow_pickle=False)
    e = z["events"] if "events" in z else z
    return *[np.asarray(e[c]).astype(np.int64) for c in "txyp"], *_NONE


def _events_of(tree):
    if "events" in tree:
        return tree["events"]
    if "CD" in tree and "events" in tree["CD"]:
        return tree["CD"]["events"]
    raise ValueError("neither events nor CD/events")


def hdf5_columns(tree, first: int = 0, last: int | None = None):
    """Columns of rows first to last of a tree of arrays: ``events/t`` and so on, or a compound table ``events`` or ``CD/events``, whose p
    is brought to 0 or 1; ``t_offset`` is added to t."""
    at = _events_of(tree)
    table = hasattr(at, "dtype")
    rows = at[first:last] if table else {c: at[c][first:last] for c in "txyp"}
    t, x, y, p = (np.asarray(rows[c]).astype(np.int64) for c in "txyp")
    return t + (int(np.asarray(tree["t_offset"]).item()) if "t_offset" in tree else 0), x, y, np.clip(p, 0, 1) if table else p, *_NONE


def ms_index(t: np.ndarray) -> np.ndarray:
    """For each millisecond from that of the first time on to that of the last, the place of the first row that is not before it; then the number of rows. Times are in order."""
    if not len(t):
        return np.zeros(1, np.int64)
    return np.append(np.searchsorted(t, np.arange(t[0] // 1000, t[-1] // 1000 + 1) * 1000), len(t))


def ms_rows(tree, start_ms: int = 0, end_ms: int = -1) -> tuple[int, int]:
    """First and last row of [start_ms, end_ms) by a tree's ``ms_to_idx``; -1 is the end."""
    if "ms_to_idx" not in tree:
        raise ValueError("no millisecond index")
    if start_ms < 0 or 0 <= end_ms < start_ms:
        raise ValueError("bad range")
    index = np.asarray(tree["ms_to_idx"]).astype(np.int64)
    base, end = int(np.asarray(tree["ms_to_idx_offset"]).item()) if "ms_to_idx_offset" in tree else 0, len(index) - 1
    place = lambda ms: int(index[min(max(ms - base, 0), end)])
    return place(start_ms), place(end_ms) if end_ms >= 0 else int(index[end])


def hdf5_pieces(source, start_ms: int | None = None, end_ms: int = -1, rows: int = 1 << 20):
    """Columns of an HDF5 recording (bytes or an open file) piece by piece; of a range of milliseconds if one is given, by the file's index. Needs the h5py package."""
    import h5py

    with h5py.File(io.BytesIO(source) if isinstance(source, bytes) else source, "r") as tree:
        at = _events_of(tree)
        a, z = (0, len(at if hasattr(at, "dtype") else at["t"])) if start_ms is None and end_ms == -1 else ms_rows(tree, start_ms or 0, end_ms)
        for k in range(a, max(z, a + 1), rows):
            yield hdf5_columns(tree, k, min(z, k + rows))


def hdf5(data: bytes, **options):
    """Needs the h5py package."""
    return tuple(np.concatenate(c) for c in zip(*hdf5_pieces(data, **options)))


def _hdf5_bytes(t, x, y, p, width: int, height: int) -> bytes:
    """Columns under ``events``, and the millisecond index, which starts at ``ms_to_idx_offset`` where that is not 0. Needs the h5py package."""
    import h5py

    out = io.BytesIO()
    with h5py.File(out, "w") as tree:
        tree.attrs["width"], tree.attrs["height"] = width, height
        group = tree.create_group("events")
        for name, column, kind in (("t", t, "int64"), ("x", x, "uint16"), ("y", y, "uint16"), ("p", p, "uint8")):
            group.create_dataset(name, data=column.astype(kind), maxshape=(None,), chunks=(10_000,), compression="gzip", shuffle=True)
        tree.create_dataset("ms_to_idx", data=ms_index(t).astype(np.uint64), compression="gzip", shuffle=True)
        if len(t) and t[0] >= 1000:
            tree.create_dataset("ms_to_idx_offset", data=np.int64(t[0] // 1000))
    return out.getvalue()


#: Decoders of other formats, from bytes to the seven columns; a suffix of that name finds them.
EXTRA: dict = {}


def decode(path: str, data: bytes, fmt: str | None = None, **options):
    """Columns of a recording; ``fmt`` wins over suffix and content."""
    path, data = decompress(path, data)
    fmt = fmt or sniff(path, data)
    if fmt in EXTRA:
        return EXTRA[fmt](data, **options)
    if fmt in PIECEWISE:
        return tuple(np.concatenate(c) for c in zip(*pieces(fmt, data, **options)))
    if fmt not in ("aer", "aedat1", "aedat2", "aedat3", "aedat4", "csv", "npz", "hdf5"):
        raise NotImplementedError(f"format {fmt}")
    return globals()[fmt](data, **options)


def compress(name: str, data: bytes) -> tuple[str, bytes]:
    """A suffix, and the data in that compression; "" leaves it as it is."""
    if not name:
        return "", data
    if name == "zst":
        import zstandard

        return ".zst", zstandard.ZstdCompressor().compress(data)
    return f".{name}", {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}[name](data)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of some columns differs from the row before; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _with_triggers(t, x, y, p, triggers):
    """All rows by time, triggers first on a tie, with a column that tells triggers (whose x is the id)."""
    if triggers is None:
        return t, x, y, p, np.zeros(len(t), bool)
    tt, tp, ti = (np.asarray(c, np.int64) for c in triggers)
    mark = np.concatenate((np.zeros(len(t), bool), np.ones(len(tt), bool)))
    # events keep their order: each goes by the latest time so far
    order = np.lexsort((np.arange(len(mark)), ~mark, np.concatenate((np.maximum.accumulate(t) if len(t) else t, tt))))
    join = lambda a, b: np.concatenate((a, b))[order]
    return join(t, tt), join(x, ti), join(y, np.zeros_like(tt)), join(p, tp), mark[order]


def encode(fmt: str, t, x, y, p, width: int = 1280, height: int = 720, triggers=None, sep: str = ",", order: str = "txyp", header: bool = True, compressed: bool = False, compression: str = "none") -> bytes:
    """A recording of one format; events keep their order. triggers: columns t, p, id, which the EVT formats and AEDAT 4 hold; others warn.

    sep, order and header are for csv, compressed for npz, compression for AEDAT 4.
    """
    t, x, y, p = (np.asarray(c, np.int64) for c in (t, x, y, p))
    if triggers is not None and fmt not in ("evt2", "evt21", "evt3", "evt4", "aedat4"):
        warnings.warn(f"{fmt} holds no triggers", stacklevel=2)
    if fmt == "csv":
        if sorted(order) != list("ptxy"):
            raise ValueError("order must have t, x, y and p")
        columns = dict(zip("txyp", (t, x, y, p)))
        line = (sep.join(["%d"] * 4) + "\n").encode()
        return (sep.join(order).encode() + b"\n" if header else b"") + b"".join(line % r for r in zip(*[columns[c] for c in order]))
    if fmt == "npz":
        out = io.BytesIO()
        (np.savez_compressed if compressed else np.savez)(out, t=t, x=x.astype(np.uint16), y=y.astype(np.uint16), p=p.astype(np.uint8), width=width, height=height)
        return out.getvalue()
    if fmt == "hdf5":
        return _hdf5_bytes(t, x, y, p, width, height)
    if fmt == "aedat4":
        return encode4(t, x, y, p, width, height, None if triggers is None else triggers[:2], compression)
    if fmt == "aer":
        return ((y & 511) | (x & 511) << 9 | (p & 1) << 18).astype("<u4").tobytes()
    if fmt == "dat":
        return b"% Data file\n% Version 2\n% Height " + str(height).encode() + b"\n% Width " + str(width).encode() + b"\n\x0c\x08" + np.stack((t & 0xFFFFFFFF, (x & 16383) | (y & 16383) << 14 | (p & 1) << 28), 1).astype("<u4").tobytes()
    name = {"evt2": "EVT2", "evt21": "EVT21", "evt3": "EVT3", "evt4": "EVT4"}[fmt]
    head = f"% format {name};height={height};width={width}\n% geometry {width}x{height}\n% end\n".encode()
    t, x, y, p, mark = _with_triggers(t, x, y, p, triggers)
    one = np.ones(len(t), bool)
    if fmt == "evt3":
        turn = _changes(t >> 12)
        new_y = np.zeros(len(t), bool)
        new_y[~mark] = _changes(y[~mark])
        last = np.where(mark, 0xA000 | (x & 15) << 8 | (p & 1), 0x2000 | (p & 1) << 11 | (x & 2047))
        words = np.stack((0x8000 | (t >> 12) & 0xFFF, 0x6000 | t & 0xFFF, y & 2047, last), 1)
        return head + words[np.stack((turn, turn | _changes(t & 0xFFF), new_y, one), 1)].astype("<u2").tobytes()
    high, event, trigger = {"evt2": (8, 0, 10), "evt21": (8, 0, 10), "evt4": (14, 10, 9)}[fmt]
    low = (t & 63) << 22
    last = np.where(mark, trigger << 28 | low | (0 if fmt == "evt21" else (x & 31) << 8 | (p & 1)), (event + (p & 1)) << 28 | low | (x & 2047) << 11 | (y & 2047))
    words = np.stack((high << 28 | (t >> 6) & 0xFFFFFFF, last), 1).astype(np.uint64)
    if fmt == "evt21":
        words[:, 1] |= np.where(mark, (x & 31) << 8 | (p & 1), 1).astype(np.uint64) << np.uint64(32)
    return head + words[np.stack((_changes(t >> 6), one), 1)].astype("<u8" if fmt == "evt21" else "<u4").tobytes()
