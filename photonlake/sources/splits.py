"""Splits of large recordings: an index of byte ranges with what a decoder must know at each, kept as a table.

With the index a recording is read by many tasks, and a time range reads only the splits that it meets.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import codecs

#: Bytes in a split.
SPLIT = 64 << 20
#: What the names of bookmark files end with.
SIDECAR = ".tmp_index"
FILES = "path string, modificationTime timestamp, length long, content binary"
BOOKMARKS = "recording_id string, ts long, first long, seq long"
INDEX = "recording_id string, fmt string, split int, first long, last long, seq long, trigger_seq long, t_min long, t_max long, state string"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a URI or a local path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def no_bookmarks() -> Column:
    return ~F.col("path").endswith(SIDECAR)


def recordings_in(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path as binaryFile gives them, without bookmark files."""
    return spark.read.format("binaryFile").load(path).where(no_bookmarks())


def bookmarks(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time, byte offset and events before of each bookmark in a bookmark file of a recording of ``size`` bytes; none if it was made for another size.

    After a header of ``% key value`` lines stand records of 20 bytes (time, offset, events up to the next), and one that ends the file.
    """
    none = (np.empty(0, np.int64),) * 3
    fields, at = codecs.header(data)
    fields = {k.lower(): v for k, v in fields.items()}
    if fields.get("size", "") != str(size):
        return none
    kind = np.dtype([("ts", "<i8"), ("first", "<u8"), ("n", "<u4")])
    rows = np.frombuffer(data, kind, (len(data) - at) // kind.itemsize, at)[:-1]
    rows = rows[rows["ts"] >= 0]  # those before the first time
    try:
        shift = int(fields.get("ts_shift_us", "0"))
    except ValueError:
        shift = 0
    n = rows["n"].astype(np.int64)
    return rows["ts"] + shift, rows["first"].astype(np.int64), np.cumsum(n) - n


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, ts, first (byte offset), seq (events before) of the bookmark files beside the recordings under a path; files of another size than their recording's have none."""
    marks = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SIDECAR}").load(path).select(F.expr(f"substring(path, 1, length(path) - {len(SIDECAR)})").alias("path"), "content")
    sizes = recordings_in(spark, path).select("path", F.col("_metadata.file_path").alias("recording_id"), "length")

    def of(batches):
        for b in batches:
            for name, size, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ts, first, seq = bookmarks(data.as_py(), size)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ts), pa.string()), pa.array(ts), pa.array(first), pa.array(seq)], ["recording_id", "ts", "first", "seq"])

    return sizes.join(marks, "path").select("recording_id", "length", "content").mapInArrow(of, BOOKMARKS)


def bookmark_at(marks: DataFrame, t: int) -> DataFrame:
    """The last bookmark of each recording at or before t, from which a reader reaches t; the first one if all are later."""
    near = F.struct((F.col("ts") <= t).alias("before"), F.when(F.col("ts") <= t, F.col("seq")).otherwise(-F.col("seq")).alias("place"))
    return marks.groupBy("recording_id").agg(F.max_by(F.struct("ts", "first", "seq"), near).alias("m")).select("recording_id", "m.*")


def entries(name: str, source, fmt: str, size: int = SPLIT, **options):
    """Index rows of a recording (bytes or an open file, of which a piece is in memory): byte range, rows before it, its least and
    greatest time (null without rows), and the decoder's state before it."""
    words, state, seq, trigger_seq = codecs.Words(source), {}, 0, 0
    for k, (a, z) in enumerate(codecs.spans(fmt, words, codecs.body_at(fmt, words.head()), words.end, size)):
        before = json.dumps(state)
        n, m, low, high = 0, 0, None, None
        for x, y in codecs.spans(fmt, words, a, z):
            part = getattr(codecs, fmt)(bytes(words.take(x, y - x)), state, **options)
            n, m = n + len(part[0]), m + len(part[4])
            times = np.concatenate((part[0], part[4]))
            if len(times):
                low, high = min(int(times.min()), low if low is not None else 2**63), max(int(times.max()), high if high is not None else -(2**63))
        yield name, fmt, k, a, z, seq, trigger_seq, low, high, before
        seq, trigger_seq = seq + n, trigger_seq + m


def build_index(spark: SparkSession, path: str, fmt: str | None = None, size: int = SPLIT) -> DataFrame:
    """Index of all uncompressed EVT and DAT recordings under a path, a task for each, which holds a piece of it in memory; write it as Parquet beside them. Others have no rows."""

    def of(batches):
        for b in batches:
            rows = []
            for (name,) in zip(b.column(0).to_pylist()):
                store, at = store_of(name)
                if name.endswith(codecs.COMPRESSED):
                    continue
                with store.open_input_file(at) as source:
                    kind = fmt or codecs.sniff(name, codecs.Words(source).head())
                    if kind in codecs.PIECEWISE:
                        rows += entries(name, source, kind, size)
            columns = list(zip(*rows)) if rows else [[]] * 10
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in INDEX.split(", ")])

    files = recordings_in(spark, path).select("_metadata.file_path")
    return files.mapInArrow(of, INDEX)


def decoded(rows, triggers: bool, **options):
    """Batches of the splits of index rows (recording_id, fmt, first, last, seq, trigger_seq, state)."""
    from .recordings import batch

    for name, fmt, first, last, seq, trigger_seq, state in rows:
        store, at = store_of(name)
        now, n = json.loads(state), trigger_seq if triggers else seq
        with store.open_input_file(at) as source:
            words = codecs.Words(source)
            for a, z in codecs.spans(fmt, words, first, last):
                part = batch(name, n, getattr(codecs, fmt)(bytes(words.take(a, z - a)), now, **options), triggers)
                n += part.num_rows
                yield part


def read_indexed(index: DataFrame, triggers: bool = False, since: int | None = None, until: int | None = None, **options) -> DataFrame:
    """Events or triggers of indexed recordings, of [since, until) if given; only the splits that may hold such times are read, a task for each of them in turn."""
    rows = index.where("t_min is not null")
    if since is not None:
        rows = rows.where(F.col("t_max") >= since)
    if until is not None:
        rows = rows.where(F.col("t_min") < until)
    rows = rows.select("recording_id", "fmt", "first", "last", "seq", "trigger_seq", "state")

    def of(batches):
        for b in batches:
            yield from decoded(zip(*(c.to_pylist() for c in b.columns)), triggers, **options)

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartition(n, "recording_id", "first").mapInArrow(of, schema.TRIGGERS if triggers else schema.EVENTS)
    if since is not None:
        out = out.where(F.col("t") >= since)
    return out if until is None else out.where(F.col("t") < until)
