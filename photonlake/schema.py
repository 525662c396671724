"""Schemas of the canonical tables, and the adapter from the ``events`` test table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS = "recording_id string, seq long, t long, x int, y int, p short"
TRIGGERS = "recording_id string, seq long, t long, p short, id short"
RECORDINGS = "recording_id string, path string, format string, width int, height int, first_t long, n_events long"
#: Sensor size where nothing else tells it.
WIDTH, HEIGHT = 1280, 720

_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def adapt_events(raw: DataFrame) -> DataFrame:
    """Events of four recordings from event_id, ts, user_id, event_type; a 64 x 48 sensor."""
    return raw.selectExpr("cast(user_id % 4 as string) recording_id", "event_id seq", f"{_MICROS} t", "cast(user_id % 64 as int) x", "cast((event_id div 7) % 48 as int) y", "cast(case when event_type in ('click', 'purchase', 'signup') then 1 else 0 end as short) p")


def adapt_triggers(raw: DataFrame) -> DataFrame:
    """External triggers: the rows of type error."""
    return raw.where("event_type = 'error'").selectExpr("cast(user_id % 4 as string) recording_id", "event_id seq", f"{_MICROS} t", "cast(event_id % 2 as short) p", "cast(user_id % 8 as short) id")


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def load_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt_triggers(spark.read.parquet(f"{sf_dir}/events.parquet"))

