"""Recordings as DataFrames, and back: one task reads or writes whole files, any number of files in parallel."""

from __future__ import annotations

import re
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..plans.dims import FEW
from . import codecs, splits


def parts(name: str, source, fmt: str | None, **options):
    """Columns of a recording (bytes or an open file), piece by piece where the format allows it; compressed ones and other formats are in memory whole."""
    if name.endswith(codecs.COMPRESSED):
        name, source = codecs.decompress(name, source if isinstance(source, bytes) else source.read())
    words = codecs.Words(source)
    fmt = fmt or codecs.sniff(name, words.head())
    if fmt in codecs.PIECEWISE:
        return codecs.pieces(fmt, source, **options)
    if fmt == "hdf5" and fmt not in codecs.EXTRA:
        return codecs.hdf5_pieces(source, **options)
    return [codecs.decode(name, bytes(words.take(0, words.end)), fmt, **options)]


def batch(name: str, seq: int, part, triggers: bool) -> pa.RecordBatch:
    """Rows of the events or triggers of decoded columns, numbered from seq."""
    t, x, y, p, tt, tp, ti = part
    rows = tt if triggers else t
    columns = [pa.repeat(pa.scalar(name, pa.string()), len(rows)), pa.array(np.arange(seq, seq + len(rows)))]
    if triggers:
        return pa.RecordBatch.from_arrays([*columns, pa.array(tt), pa.array(tp.astype(np.int16)), pa.array(ti.astype(np.int16))], ["recording_id", "seq", "t", "p", "id"])
    return pa.RecordBatch.from_arrays([*columns, pa.array(t.astype(np.int64)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(p.astype(np.int16))], ["recording_id", "seq", "t", "x", "y", "p"])


def _read(files: DataFrame, fmt: str | None, triggers: bool, options: dict) -> DataFrame:
    def of(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                seq = 0
                for part in parts(name, data.as_py(), fmt, **options):
                    whole = batch(name, seq, part, triggers)
                    seq += whole.num_rows
                    for k in range(0, whole.num_rows, 1 << 18):
                        yield whole.slice(k, 1 << 18)

    return files.select("_metadata.file_path", "content").mapInArrow(of, schema.TRIGGERS if triggers else schema.EVENTS)


def read_events(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Events of all files under a path (evt2, evt21, evt3, evt4, dat, aer, aedat1 to aedat4, csv, npz, hdf5; .gz .bz2 .xz .zst around them). recording_id is the file.

    For HDF5 start_ms and end_ms read [start_ms, end_ms) by the file's millisecond index; seq then counts the rows that were read.
    """
    return _read(splits.recordings_in(spark, path), fmt, False, options)


def read_triggers(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    return _read(splits.recordings_in(spark, path), fmt, True, options)


def stream_events(spark: SparkSession, path: str, fmt: str | None = None, triggers: bool = False, max_files: int = 64, **options) -> DataFrame:
    """Events, or triggers, of the files of a folder as a stream: each file once, those that appear later too, at most max_files in a micro-batch.

    What was read is in the query's checkpoint. Files must appear whole, as those of write_events do; bookmark files and
    names that start with a dot or an underscore are left out. A micro-batch takes the oldest files; a recording is in one of them, in order.
    """
    files = spark.readStream.format("binaryFile").schema(splits.FILES).option("maxFilesPerTrigger", max_files).load(path)
    return _read(files.where(splits.no_bookmarks()), fmt, triggers, options)


class Batch(NamedTuple):
    """Events and triggers of the same recordings."""

    events: DataFrame
    triggers: DataFrame


def read_both(spark: SparkSession, path: str, fmt: str | None = None, **options) -> Batch:
    """Events and triggers as a pair; formats without triggers have none."""
    return Batch(read_events(spark, path, fmt, **options), read_triggers(spark, path, fmt, **options))


def read_csv_events(spark: SparkSession, path: str, delimiter: str = ",", order: tuple[str, ...] = ("t", "x", "y", "p")) -> DataFrame:
    """Events of CSV files as the CSV codec gives them, for files of any size: splits of one file are read in parallel, in the JVM.

    seq is a row's place in its split after the rows of the splits before, which a first pass counts; both passes cut the files alike.
    Lines without a visible character and a header of t, x, y and p (in any order, others between) are left out; a header without
    one of the four is an error. Numbers end at the first other character; what is none, is missing or is beyond 64 bits is 0.
    gzip and bzip2 files are read as one split.
    """
    text = spark.read.text(path)
    lines = text.select(F.col("_metadata.file_path").alias("recording_id"), F.col("_metadata.file_block_start").alias("_split"), "value").where(F.col("value").rlike(r"\S")).withColumn("_id", F.monotonically_increasing_id())
    splits = lines.groupBy("recording_id", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.min_by("value", "_id").alias("_line"))
    ordered = Window.partitionBy("recording_id").orderBy("_split")
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = f"\\Q{delimiter[0]}\\E"
    head = F.transform(F.split(F.lower(F.first("_line").over(every)), cut), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    names = F.array(*map(F.lit, "txyp"))
    splits = splits.select("recording_id", "_split", "_first", before.alias("_before"), head.alias("_head")).withColumn("_known", F.size(F.array_intersect("_head", names)))
    ways = F.when(F.col("_known") == 4, F.col("_head")).when(F.col("_known") > 0, F.raise_error(F.lit("the header lacks a column"))).otherwise(F.array(*map(F.lit, order)))
    splits = splits.select("recording_id", "_split", (F.col("_before") - F.col("_first") - (F.col("_known") > 0).cast("long")).alias("_add"), ways.alias("_order"))
    # a file has one split, and one more for each partition that it fills
    few = len(text.inputFiles()) + text.rdd.getNumPartitions() <= FEW
    rows = lines.join(F.broadcast(splits) if few else splits, ["recording_id", "_split"]).withColumn("seq", F.col("_id") + F.col("_add")).where("seq >= 0").withColumn("_f", F.split("value", cut, -1))

    def number(name: str):
        digits = F.regexp_extract(F.get("_f", F.array_position("_order", F.lit(name)).cast("int") - 1), r"^[ \t]*([+-]?[0-9]+)", 1)
        return F.coalesce(digits.try_cast("long"), F.lit(0))

    narrow = lambda name, mask, kind: number(name).bitwiseAND(mask).cast(kind).alias(name)
    return rows.select("recording_id", "seq", number("t").alias("t"), narrow("x", 65535, "int"), narrow("y", 65535, "int"), narrow("p", 255, "short"))


def encoded(events: DataFrame, fmt: str, width: int = schema.WIDTH, height: int = schema.HEIGHT, triggers: DataFrame | None = None, **options) -> DataFrame:
    """recording_id, content: the bytes of each recording, with its triggers. A recording is encoded in one task, as formats are sequential."""
    columns = ["recording_id", "seq", "t", "x", "y", "p", "id"]
    rows = events.select(*columns[:6], F.lit(None).cast("short").alias("id"))
    marked = triggers is not None
    if marked:
        none = F.lit(0)
        rows = rows.unionByName(triggers.select("recording_id", "seq", "t", none.alias("x"), none.alias("y"), "p", "id"))

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        e, r = pdf[pdf["id"].isna()], pdf[pdf["id"].notna()]
        found = (r["t"], r["p"], r["id"].astype(np.int64)) if marked else None
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[:1], "content": [codecs.encode(fmt, e["t"], e["x"], e["y"], e["p"], width, height, found, **options)]})

    return rows.groupBy("recording_id").applyInPandas(of, "recording_id string, content binary")


def write_events(events: DataFrame, folder: str, fmt: str, compression: str = "", width: int = schema.WIDTH, height: int = schema.HEIGHT, triggers: DataFrame | None = None, **options) -> DataFrame:
    """Writes a file for each recording to a folder that all executors share (a path, or a URI that Arrow's file systems know).

    compression is "", gz, bz2, xz or zst. Gives recording_id, path, bytes. A file appears whole: it is written under another name and
    then moved, so a task that is run again replaces it. Names are the last part of recording_id, what is no letter, digit, ``.``, ``-`` or ``_`` as ``_``,
    and a hash of the whole id.
    """
    suffix = {"hdf5": "h5"}.get(fmt, fmt)

    def of(batches):
        store, base = splits.store_of(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            paths, sizes = [], []
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                end, data = codecs.compress(compression, content.as_py())
                short = re.sub(r"[^A-Za-z0-9._-]", "_", name.rsplit("/", 1)[-1])
                path = f"{base}/{short}-{zlib.crc32(name.encode()):08x}.{suffix}{end}"
                part = f"{base}/.{uuid.uuid4().hex}.part"  # no reader lists it
                with store.open_output_stream(part, compression=None) as out:
                    out.write(data)
                store.move(part, path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["recording_id", "path", "bytes"])

    rows = encoded(events, fmt, width, height, triggers, **options).mapInArrow(of, "recording_id string, path string, bytes long").collect()
    return events.sparkSession.createDataFrame(rows, "recording_id string, path string, bytes long")


def recordings(events: DataFrame, fmt: str, width: int = schema.WIDTH, height: int = schema.HEIGHT) -> DataFrame:
    """The recordings table of some events."""
    facts = events.groupBy("recording_id").agg(F.min_by("t", "seq").alias("first_t"), F.count("*").alias("n_events"))
    return facts.select("recording_id", F.col("recording_id").alias("path"), F.lit(fmt).alias("format"), F.lit(width).alias("width"), F.lit(height).alias("height"), "first_t", "n_events")
