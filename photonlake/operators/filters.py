"""Filters of an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dims import attach, per_recording


def in_bounds(events: DataFrame, width: int, height: int) -> DataFrame:
    return events.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def mask_events(events: DataFrame, mask: DataFrame, width: int, height: int) -> DataFrame:
    """Events on pixels of the mask (x, y; at most width * height rows, so it is broadcast). A pixel outside the sensor raises an error at run time."""
    if width <= 0 or height <= 0:
        raise ValueError("mask must have two dimensions")
    bad = (F.col("x") < 0) | (F.col("x") >= width) | (F.col("y") < 0) | (F.col("y") >= height)
    checked = events.where(F.when(bad, F.raise_error(F.lit("event outside the mask")).cast("boolean")).otherwise(True))
    pixels = mask.select("x", "y").where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).distinct()
    return checked.join(F.broadcast(pixels) if width * height <= 1 << 22 else pixels, ["x", "y"], "left_semi").select(events.columns)


def refractory(events: DataFrame, delta: int) -> DataFrame:
    """First event of each pixel, and those more than delta after the pixel's previous one, kept or not."""
    before = F.lag("t").over(Window.partitionBy("recording_id", "x", "y").orderBy("seq"))
    return events.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("t") - F.col("_b") > delta)).drop("_b")


def drop_random(events: DataFrame, rate: float, u: Column) -> DataFrame:
    """Keep where the uniform number u is at least rate; the rate is in (0, 1)."""
    if not 0 < rate < 1:
        raise ValueError("rate must be between 0 and 1")
    return events.where(u >= rate)


def drop_event(events: DataFrame, p: float, u: Column) -> DataFrame:
    """As drop_random; p is in [0, 1), and 0 keeps all."""
    if not 0 <= p < 1:
        raise ValueError("p must be in [0, 1)")
    return events if p == 0 else events.where(u >= p)


def drop_by_time(events: DataFrame, ratio: float, u: float) -> DataFrame:
    """Drop the closed interval of ``ratio`` of a recording's span that starts the fraction u of the room it has."""
    if not 0 <= ratio < 1 or not 0 <= u < 1:
        raise ValueError("ratio and u must be in [0, 1)")
    rows = attach(events, per_recording(events, lo=F.min("t"), hi=F.max("t")))
    at, span = F.col("t") - F.col("lo"), F.col("hi") - F.col("lo")  # from the start, so that fractions keep their digits
    size = span * F.lit(float(ratio))
    start = (span - size) * F.lit(float(u))
    return rows.where((at < start) | (at > start + size)).drop("lo", "hi")


def prefix_dt(events: DataFrame, dt: int) -> DataFrame:
    """Events of [t0, t0 + dt)."""
    rows = attach(events, per_recording(events, t0=F.min_by("t", "seq")))
    return rows.where(F.col("t") < F.col("t0") + dt).drop("t0")


def skip_to_time(events: DataFrame, start: int) -> DataFrame:
    """Everything from the first event, in stream order, at or after start."""
    first = per_recording(events.where(F.col("t") >= start), s=F.min("seq"))
    return attach(events, first).where("seq >= s").drop("s")


def wedge(events: DataFrame, height: int, tl: float) -> DataFrame:
    """Events above the line that falls with time: (H - y) / H > (t - t0) / tl - 0.1."""
    rows = attach(events, per_recording(events, t0=F.min_by("t", "seq")))
    return rows.where((F.lit(float(height)) - F.col("y")) / F.lit(float(height)) > (F.col("t") - F.col("t0")) / F.lit(float(tl)) - 0.1).drop("t0")
