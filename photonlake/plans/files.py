"""Named queries that write recordings to files and read them back, and their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..sources import recordings, splits
from ..sources.datasource import register

#: Format and compression of each query.
FORMS = (("evt2", ""), ("evt21", "gz"), ("evt3", "xz"), ("evt4", "zst"), ("dat", "bz2"), ("npz", ""), ("csv", "gz"), ("aedat4", ""))


def shared(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="photonlake-") if spark.sparkContext.master.startswith("local[") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/recordings-{uuid.uuid4().hex}"


def in_seconds(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows in time order, times in seconds from the first event's, as formats with a short clock need it."""
    least = events.groupBy("recording_id").agg(F.min("t").alias("lo"))
    order = Window.partitionBy("recording_id").orderBy("t", "seq")
    rows = rows.join(F.broadcast(least), "recording_id").withColumn("t", F.expr("(t - lo) div 1000000")).drop("lo")
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def _named(df: DataFrame, written: DataFrame) -> DataFrame:
    key = F.regexp_replace("recording_id", "^file:/+", "/")
    names = written.select(F.col("recording_id").alias("_name"), F.regexp_replace("path", "^file:/+", "/").alias("_path"))
    return df.withColumn("_path", key).join(F.broadcast(names), "_path").withColumn("recording_id", F.col("_name")).drop("_name", "_path")


def round_trip(spark: SparkSession, sf_dir: str, fmt: str, compression: str) -> DataFrame:
    events = schema.load(spark, sf_dir)
    folder = shared(spark)
    written = recordings.write_events(in_seconds(events, events), folder, fmt, compression, 64, 48)
    return _named(recordings.read_events(spark, folder), written)


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, DataFrame]:
    events, triggers = schema.load(spark, sf_dir), schema.load_triggers(spark, sf_dir)
    folder = shared(spark)
    written = recordings.write_events(in_seconds(events, events), folder, "evt3", "", 64, 48, in_seconds(triggers, events))
    splits.build_index(spark, folder, size=512).write.parquet(f"{folder}-index")
    return spark.read.parquet(f"{folder}-index"), folder, written


def split_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a time range, by splits of an index."""
    index, _, written = _indexed(spark, sf_dir)
    return _named(splits.read_indexed(index, since=432_000, until=1_728_000), written)


def trigger_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers that were written with the events, through the data source and its splits."""
    _, folder, written = _indexed(spark, sf_dir)
    register(spark)
    found = spark.read.format("event_recordings").option("triggers", "true").option("index", f"{folder}-index").load(folder)
    return _named(found, written)


_ROWS = """WITH ev AS (SELECT CAST(user_id % 4 AS VARCHAR) AS recording_id, event_id AS seq, epoch_us(ts) AS t, CAST(user_id % 64 AS INTEGER) AS x,
CAST((event_id // 7) % 48 AS INTEGER) AS y, CAST(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END AS SMALLINT) AS p, event_type, user_id FROM events),
lo AS (SELECT recording_id, min(t) AS lo FROM ev GROUP BY recording_id),
s AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY (t - lo) // 1000000, seq) - 1 AS seq, (t - lo) // 1000000 AS t, x, y, p FROM ev JOIN lo USING (recording_id)) """
_TRIGGERS = ", r AS (SELECT * FROM ev WHERE event_type = 'error') SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY (t - lo) // 1000000, seq) - 1 AS seq, (t - lo) // 1000000 AS t, CAST(seq % 2 AS SMALLINT) AS p, CAST(user_id % 8 AS SMALLINT) AS id FROM r JOIN lo USING (recording_id)"

QUERIES = {f"files_{fmt}": (lambda spark, d, fmt=fmt, c=c: round_trip(spark, d, fmt, c)) for fmt, c in FORMS} | {"files_split": split_reads, "files_triggers": trigger_files}
ORACLE = {f"files_{fmt}": _ROWS + "SELECT * FROM s" for fmt, _ in FORMS} | {"files_split": _ROWS + "SELECT * FROM s WHERE t >= 432000 AND t < 1728000", "files_triggers": _ROWS + _TRIGGERS}
