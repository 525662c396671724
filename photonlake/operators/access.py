"""Random access, checks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dims import attach, per_recording, with_origin
from .windows import BUCKET, numbered


def seek_time(events: DataFrame, t: int) -> DataFrame:
    """Events at or after t; on Parquet with a column t the bound reaches the scan."""
    return events.where(F.col("t") >= t)


def seek_index(events: DataFrame, n: int) -> DataFrame:
    """Events from position n of each recording; past the end none."""
    return numbered(events, "_n").where(F.col("_n") >= n).drop("_n")


def seek(events: DataFrame, t: int | None = None, n: int | None = None, relative: bool = False) -> DataFrame:
    """From a time or a position; relative: t counts from the first event of the recording."""
    if (t is None) == (n is None):
        raise ValueError("exactly one of t and n")
    if t is not None and relative:
        return with_origin(events).where(F.col("t") >= F.col("t0") + t).drop("t0")
    return seek_time(events, t) if t is not None else seek_index(events, n)


def ms_range(events: DataFrame, start: int, end: int = -1) -> DataFrame:
    """Events of [start, end) in milliseconds; -1 is open."""
    if start < 0 or (end != -1 and end < start):
        raise ValueError("bad range")
    rows = events.where(F.col("t") >= start * 1000)
    return rows if end == -1 else rows.where(F.col("t") < end * 1000)


def rows_at(events: DataFrame, start: int, stop: int) -> DataFrame:
    """The slice [start:stop] of each recording; negative positions count from the end."""
    rows = numbered(events, "_n")
    if min(start, stop) >= 0:
        return rows.where((F.col("_n") >= start) & (F.col("_n") < stop)).drop("_n")
    at = lambda k: F.lit(k) if k >= 0 else F.col("_k") + k
    return attach(rows, per_recording(events, _k=F.count("*"))).where((F.col("_n") >= at(start)) & (F.col("_n") < at(stop))).select(*events.columns)


def is_sorted(events: DataFrame) -> DataFrame:
    """Whether times never go down: inside buckets of seq, and from the last time of one to the first of the next."""
    rows = events.select("recording_id", "seq", "t", F.expr(f"seq div {BUCKET}").alias("_b"))
    inside = F.lag("t").over(Window.partitionBy("recording_id", "_b").orderBy("seq"))
    edges = rows.withColumn("_ok", F.coalesce(F.col("t") >= inside, F.lit(True))).groupBy("recording_id", "_b").agg(F.bool_and("_ok").alias("_ok"), F.min_by("t", "seq").alias("_a"), F.max_by("t", "seq").alias("_z"))
    before = F.lag("_z").over(Window.partitionBy("recording_id").orderBy("_b"))
    return edges.withColumn("_ok", F.col("_ok") & F.coalesce(F.col("_a") >= before, F.lit(True))).groupBy("recording_id").agg(F.bool_and("_ok").alias("is_sorted"))


def is_valid(events: DataFrame, width: int, height: int) -> DataFrame:
    """recording_id, is_valid: times in order, polarities 0 or 1 and pixels on the sensor."""
    return validity(events, width, height).join(is_sorted(events), "recording_id").select("recording_id", F.expr("valid_p and valid_x and valid_y and is_sorted").alias("is_valid"))


def validity(events: DataFrame, width: int, height: int) -> DataFrame:
    inside = lambda c, n: F.bool_and((F.col(c) >= 0) & (F.col(c) < n))
    return events.groupBy("recording_id").agg(F.bool_and(F.col("p").isin(0, 1)).alias("valid_p"), inside("x", width).alias("valid_x"), inside("y", height).alias("valid_y"))


def summary(events: DataFrame) -> DataFrame:
    one = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0))
    return events.groupBy("recording_id").agg(F.count("*").alias("n"), one("p = 1").alias("pos"), one("p <> 1").alias("neg"), F.min_by("t", "seq").alias("first_t"), F.max_by("t", "seq").alias("last_t"), F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), (F.max("t") - F.min("t")).alias("duration_us"))


def center_of_mass(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return events.groupBy("recording_id", *by).agg(F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def plot_points(events: DataFrame, most: int, scale: float = 3000.0) -> DataFrame:
    """Data for a 3-D scatter: an even choice of at most ``most`` rows a recording, time scaled to 0..scale."""
    span = events.groupBy("recording_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("k"))
    rows = numbered(events, "_n").join(span, "recording_id").withColumn("_s", F.greatest(F.lit(1), F.ceil(F.col("k") / most)))
    return rows.where("_n % _s = 0").select("recording_id", "seq", "x", "y", "p", F.when(F.col("hi") > F.col("lo"), (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * scale).otherwise(0.0).alias("z"))
