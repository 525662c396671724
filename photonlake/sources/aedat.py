"""AEDAT 3.1 and 4.0: recordings made of packets. Same columns as the other codecs; a cut-off last packet is left out."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

_V3_HEAD = np.dtype([("kind", "<i2"), ("source", "<i2"), ("size", "<i4"), ("at_ts", "<i4"), ("overflow", "<i4"), ("capacity", "<i4"), ("number", "<i4"), ("valid", "<i4")])
_V3_SPECIAL, _V3_POLARITY = 0, 1
_V4_EVENT = np.dtype({"names": ["t", "x", "y", "p"], "formats": ["<i8", "<i2", "<i2", "u1"], "offsets": [0, 8, 10, 12], "itemsize": 16})
_V4_TRIGGER = np.dtype({"names": ["t", "kind"], "formats": ["<i8", "i1"], "offsets": [0, 8], "itemsize": 16})
_V4_VERSION = b"#!AER-DAT4.0\r\n"
#: Fixed values of the format: how packets are compressed.
COMPRESSION = {"none": 0, "lz4": 1, "lz4_high": 2, "zstd": 3, "zstd_high": 4}


def _v3_packets(data: bytes) -> Iterator[tuple[np.void, int]]:
    """Header and body place of each whole packet."""
    end, at = data.find(b"#!END-HEADER"), 0
    if end >= 0:
        at = data.find(b"\n", end) + 1 or len(data)
    while end < 0 and data[at : at + 1] == b"#":
        at = data.find(b"\n", at) + 1 or len(data)
    while at + _V3_HEAD.itemsize <= len(data):
        head = np.frombuffer(data, _V3_HEAD, 1, at)[0]
        body = at + _V3_HEAD.itemsize
        at = body + int(head["capacity"]) * int(head["size"])
        if head["size"] <= 0 or head["capacity"] < 0 or at > len(data):
            return
        yield head, body


def aedat3(data: bytes):
    """Valid polarity events, and special events of types 2 to 13 as triggers (even types rise, id 0); other packets are skipped."""
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {_V3_SPECIAL: [], _V3_POLARITY: []}
    for head, body in _v3_packets(data):
        kind, number = int(head["kind"]), min(int(head["number"]), int(head["capacity"]))
        if kind not in found or number <= 0:
            continue
        if head["size"] != 8 or head["at_ts"] != 4:
            raise ValueError(f"AEDAT 3 events of {head['size']} bytes")
        r = np.frombuffer(data, "<u4", 2 * number, body).reshape(-1, 2).astype(np.int64)
        r = r[r[:, 0] & 1 == 1]
        found[kind].append((r[:, 0], r[:, 1] + (int(head["overflow"]) << 31)))
    (d, t), (s, ts) = (tuple(map(np.concatenate, zip(*parts))) if (parts := found[k]) else (np.empty(0, np.int64),) * 2 for k in (_V3_POLARITY, _V3_SPECIAL))
    kind = (s >> 1) & 127
    outer = (kind >= 2) & (kind <= 13)
    return t, d >> 17, (d >> 2) & 32767, (d >> 1) & 1, ts[outer], 1 - kind[outer] % 2, np.zeros(outer.sum(), np.int64)


def _field(buf: bytes, base: int, k: int) -> int | None:
    """Place of field k of the root table of the FlatBuffer at base; None where it is left out."""
    table = base + struct.unpack_from("<I", buf, base)[0]
    vtable = table - struct.unpack_from("<i", buf, table)[0]
    if 4 + 2 * k >= struct.unpack_from("<H", buf, vtable)[0]:
        return None
    offset = struct.unpack_from("<H", buf, vtable + 4 + 2 * k)[0]
    return table + offset if offset else None


def _structs(buf: bytes, kind: np.dtype) -> np.ndarray:
    """The structs of a size-prefixed packet; none where the packet is malformed."""
    try:
        at = _field(buf, 4, 0)
        if at is None:
            return np.empty(0, kind)
        at += struct.unpack_from("<I", buf, at)[0]
        return np.frombuffer(buf, kind, struct.unpack_from("<I", buf, at)[0], at + 4)
    except (struct.error, ValueError):
        return np.empty(0, kind)


def _flat(fields: list[tuple[str, object]], ident: bytes = b"") -> bytes:
    """A FlatBuffer of one table. Fields: ("int", n), ("long", n) or ("vector", (count, bytes))."""
    head = 4 + len(ident)
    vtable_size = 4 + 2 * len(fields)
    table = -(-(head + vtable_size) // 8) * 8
    places, size = [], 4
    for kind, _ in fields:
        width = 8 if kind == "long" else 4
        size = -(-size // width) * width
        places.append(size)
        size += width
    out = bytearray(table + size)
    struct.pack_into("<I", out, 0, table)
    out[4:head] = ident
    struct.pack_into(f"<{2 + len(fields)}H", out, head, vtable_size, size, *places)
    struct.pack_into("<i", out, table, table - head)
    for (kind, value), place in zip(fields, places):
        if kind == "vector":
            out += bytes((4 - len(out)) % 8)
            struct.pack_into("<I", out, table + place, len(out) - table - place)
            out += struct.pack("<I", value[0]) + value[1]
        else:
            struct.pack_into("<i" if kind == "int" else "<q", out, table + place, value)
    return bytes(out)


def _codec(compression: int):
    """Functions that pack and unpack a packet. LZ4 needs the lz4 package."""
    if compression == 0:
        return bytes, bytes
    if compression in (1, 2):
        from lz4 import frame

        return frame.compress, frame.decompress
    if compression in (3, 4):
        import zstandard

        return zstandard.ZstdCompressor(level=10 if compression == 4 else 3).compress, lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)
    raise ValueError(f"unknown AEDAT 4 compression {compression}")


def aedat4(data: bytes):
    """Events of all EVTS packets and triggers of all TRIG packets (odd types rise, id 0); other packets are skipped."""
    at = len(_V4_VERSION)
    size = struct.unpack_from("<I", data, at)[0]
    base, at = at + 4, at + 4 + size
    if at > len(data):
        raise ValueError("truncated AEDAT 4 header")
    mode, table = _field(data, base, 0), _field(data, base, 1)
    unpack = _codec(struct.unpack_from("<i", data, mode)[0] if mode is not None else 0)[1]
    end = struct.unpack_from("<q", data, table)[0] if table is not None else -1
    end = end if 0 <= end <= len(data) else len(data)
    events, triggers = [np.empty(0, _V4_EVENT)], [np.empty(0, _V4_TRIGGER)]
    while at + 8 <= end:
        size = struct.unpack_from("<i", data, at + 4)[0]
        if size < 0 or at + 8 + size > end:
            break
        body = unpack(data[at + 8 : at + 8 + size])
        at += 8 + size
        if body[8:12] == b"EVTS":
            events.append(_structs(body, _V4_EVENT))
        elif body[8:12] == b"TRIG":
            triggers.append(_structs(body, _V4_TRIGGER))
    e, r = np.concatenate(events), np.concatenate(triggers)
    wide = lambda c, m: e[c].astype(np.int64) & m
    return e["t"].astype(np.int64), wide("x", 65535), wide("y", 65535), wide("p", 255), r["t"].astype(np.int64), r["kind"].astype(np.int64) & 1, np.zeros(len(r), np.int64)


def encode4(t, x, y, p, width: int, height: int, triggers=None, compression: str = "none", per_packet: int = 4096) -> bytes:
    """An AEDAT 4.0 recording. triggers: (t, p) columns, written after the events as a stream of its own."""
    mode = COMPRESSION[compression]
    pack = _codec(mode)[0]
    leaf = lambda k, v, kind: f'<attr key="{k}" type="{kind}">{v}</attr>'
    node = lambda name, path, inner: f'<node name="{name}" path="{path}">{inner}</node>'
    streams = node("0", "/outInfo/0/", leaf("typeIdentifier", "EVTS", "string") + node("info", "/outInfo/0/info/", leaf("sizeX", width, "int") + leaf("sizeY", height, "int")))
    if triggers is not None:
        streams += node("1", "/outInfo/1/", leaf("typeIdentifier", "TRIG", "string"))
    info = f'<dv version="2.0">{node("outInfo", "/outInfo/", streams)}</dv>'.encode()
    head = _flat([("int", mode), ("long", -1), ("vector", (len(info), info + b"\0"))])
    out = bytearray(_V4_VERSION + struct.pack("<I", len(head)) + head)

    def write(stream: int, ident: bytes, rows: np.ndarray) -> None:
        for k in range(0, len(rows), per_packet):
            part = rows[k : k + per_packet]
            body = _flat([("vector", (len(part), part.tobytes()))], ident)
            body = pack(struct.pack("<I", len(body)) + body)
            out.extend(struct.pack("<ii", stream, len(body)) + body)

    rows = np.zeros(len(t), _V4_EVENT)
    for c, v in zip("txyp", (t, x, y, p)):
        rows[c] = np.asarray(v, np.int64).astype(_V4_EVENT[c])
    write(0, b"EVTS", rows)
    if triggers is not None:
        marks = np.zeros(len(triggers[0]), _V4_TRIGGER)
        marks["t"], marks["kind"] = triggers[0], np.where(np.asarray(triggers[1]) == 1, 1, 2)
        write(1, b"TRIG", marks)
    return bytes(out)
