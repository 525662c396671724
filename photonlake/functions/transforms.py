"""Transforms: functions of a DataFrame, composed lazily; Catalyst fuses them."""

from __future__ import annotations

import inspect
import random
from collections.abc import Callable, Sequence
from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dims import attach, per_recording

Transform = Callable[[DataFrame], DataFrame]


def uniform(seed: int, *key: str) -> Column:
    """A number in [0, 1) that depends on the seed and the key columns alone, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(key or ("recording_id", "seq"))), 11) * F.lit(2.0**-53)


def lcg(seed: int, key: str = "seq") -> Column:
    """A weak but portable uniform number by a linear congruence of a key."""
    return F.pmod(F.pmod(key, F.lit(2147483648)) * 1103515245 + 12345 + seed, F.lit(2147483648)) / F.lit(2147483648.0)


def normal(u: Column, v: Column) -> Column:
    """A standard normal number by Box and Muller from two uniform ones."""
    return F.sqrt(-2 * F.log1p(-u)) * F.cos(v * 6.283185307179586)


def _two(u: tuple[Column, Column] | None, seed: int) -> Column:
    return normal(*(u or (uniform(seed), uniform(seed + 1))))


def draw(value: float | tuple[float, float], seed: int) -> float:
    """A parameter as it is, or one draw from its range."""
    return random.Random(seed).uniform(*value) if isinstance(value, tuple) else value


def flip_lr(events: DataFrame, width: int) -> DataFrame:
    return events.withColumn("x", (F.lit(width - 1) - F.col("x")).bitwiseAND(65535).cast("int"))


def random_flip_lr(events: DataFrame, width: int, p: float, seed: int = 0, u: Column | None = None) -> DataFrame:
    """One coin a recording: u, the same for its rows, or one of the seed."""
    if not 0 <= p <= 1:
        raise ValueError("p must be in [0, 1]")
    flipped = (F.lit(width - 1) - F.col("x")).bitwiseAND(65535).cast("int")
    return events.withColumn("x", F.when((uniform(seed, "recording_id") if u is None else u) <= p, flipped).otherwise(F.col("x")))


def spatial_jitter(events: DataFrame, width: int, height: int, var_x: float | tuple, var_y: float | tuple, sigma_xy: float | tuple, clip: bool, seed: int = 0, u: tuple[Column, ...] | None = None) -> DataFrame:
    """Correlated normal noise on x and y, from four uniform numbers; with clip rows that leave the sensor go. Coordinates are cut to whole numbers and wrap. A pair as a parameter is a range to draw from."""
    var_x, var_y, sigma_xy = draw(var_x, seed), draw(var_y, seed + 1), draw(sigma_xy, seed + 2)
    l11 = sqrt(var_x)
    l21 = sigma_xy / l11 if l11 else 0.0
    l22 = sqrt(max(var_y - l21 * l21, 0.0))
    a, b = _two(u[:2] if u else None, seed), _two(u[2:] if u else None, seed + 2)
    rows = events.withColumn("_x", F.col("x") + l11 * a).withColumn("_y", F.col("y") + l21 * a + l22 * b)
    if clip:
        rows = rows.where((F.col("_x") >= 0) & (F.col("_x") < width) & (F.col("_y") >= 0) & (F.col("_y") < height))
    return rows.withColumn("x", F.col("_x").cast("long").bitwiseAND(65535).cast("int")).withColumn("y", F.col("_y").cast("long").bitwiseAND(65535).cast("int")).drop("_x", "_y")


def time_skew(events: DataFrame, coefficient: float, offset: float = 0.0) -> DataFrame:
    """t c + o, cut towards zero."""
    return events.withColumn("t", (F.col("t") * F.lit(float(coefficient)) + F.lit(float(offset))).cast("long"))


def _ordered(rows: DataFrame, sort: bool, *by: str) -> DataFrame:
    return rows.orderBy("recording_id", *by) if sort else rows


def time_jitter(events: DataFrame, std: float | tuple, clip_negative: bool, seed: int = 0, u: tuple[Column, Column] | None = None, sort: bool = False) -> DataFrame:
    """Normal noise on t, cut towards zero; sort: by the new times."""
    rows = events.withColumn("t", (F.col("t") + draw(std, seed) * _two(u, seed)).cast("long"))
    return _ordered(rows.where("t >= 0") if clip_negative else rows, sort, "t", "seq")


def normalize_ts(events: DataFrame, start: int = 0) -> DataFrame:
    """Times less the recording's smallest, plus start."""
    return attach(events, per_recording(events, t0=F.min("t"))).withColumn("t", F.col("t") - F.col("t0") + start).drop("t0").select(events.columns)


def normalize_first(events: DataFrame) -> DataFrame:
    """Times less that of the first event in stream order."""
    return attach(events, per_recording(events, t0=F.min_by("t", "seq"))).withColumn("t", F.col("t") - F.col("t0")).drop("t0").select(events.columns)


def event_jitter(events: DataFrame, jitter: int, seed: int = 0, u: Column | None = None, sort: bool = False) -> DataFrame:
    """A whole number from -jitter to jitter on each time; sort: by t, x, y, p."""
    one = uniform(seed) if u is None else u
    return _ordered(events.withColumn("t", F.col("t") + F.floor(one * (2 * jitter + 1)).cast("long") - jitter), sort, "t", "x", "y", "p")


def event_jitter_n(events: DataFrame, mean: float, std: float, seed: int = 0, u: tuple[Column, Column] | None = None, sort: bool = False) -> DataFrame:
    return _ordered(events.withColumn("t", F.col("t") + F.rint(_two(u, seed) * std + mean).cast("long")), sort, "t", "x", "y", "p")


class Compose:
    """Transforms one after the other; one that takes a second argument gets and returns the target too."""

    def __init__(self, transforms: Sequence[Callable]):
        self.transforms = list(transforms)

    def __call__(self, events: DataFrame, target=None):
        takes = [sum(p.default is p.empty for p in inspect.signature(f).parameters.values()) > 1 for f in self.transforms]
        if target is None and not any(takes):
            return reduce(lambda df, f: df.transform(f), self.transforms, events)
        for f, two in zip(self.transforms, takes):
            if two:
                events, target = f(events, target)
            else:
                events = f(events)
        return events, target


def random_events(spark, n: int, width: int, height: int, start: int, end: int, seed: int = 0, slices: int = 1, u: Callable[[int], Column] | None = None) -> DataFrame:
    """n uniform events whose times are sorted; with slices, each equal part of the rows has an equal part of the time. u(i) is the i-th uniform number of a row (with seq)."""
    per = max(1, n // slices)
    rows = spark.range(n).select(F.lit("random").alias("recording_id"), F.col("id").alias("seq"))
    u = u or (lambda i: uniform(seed + i))
    part = F.least(F.expr(f"seq div {per}"), F.lit(slices - 1))
    size = (end - start) / slices
    rows = rows.select("recording_id", "seq", F.floor(F.lit(start) + (part + u(0)) * size).cast("long").alias("t"), F.floor(u(1) * width).cast("int").alias("x"), F.floor(u(2) * height).cast("int").alias("y"), F.floor(u(3) * 2).cast("short").alias("p"))
    # numbered by time through counts of parts of the span, so that no task sorts all rows
    part = F.expr(f"(t - {start}) div {max(1, (end - start) // 1024)}")
    rows = rows.withColumn("_b", part)
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("t", "x", "y", "p"))
    return rows.withColumn("_r", place).join(F.broadcast(counts), "_b").select("recording_id", (F.col("_o") + F.col("_r") - 1).alias("seq"), "t", "x", "y", "p").orderBy("t", "seq")
