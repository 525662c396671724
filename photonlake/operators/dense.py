"""Dense per-pixel representations as long tables: one row for each pixel, and channel, with events; ``densify`` fills the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dims import attach, per_recording
from .filters import in_bounds, wedge

KEY = ("recording_id", "y", "x")


def _saturated(flag: str, most: int, fill: bool):
    n = F.sum(F.when(F.expr(flag), 1).otherwise(0))
    return (F.when(n > 0, most).otherwise(0) if fill else F.least(n, F.lit(most))).cast("int")


def histogram(events: DataFrame, width: int, height: int, fill: bool = False, most: int = 255, by: tuple[str, ...] = ()) -> DataFrame:
    """on and off counts, saturating at ``most``; fill: ``most`` where there is any."""
    return in_bounds(events, width, height).groupBy("recording_id", *by, "y", "x").agg(_saturated("p = 1", most, fill).alias("on_cnt"), _saturated("p <> 1", most, fill).alias("off_cnt"))


def wedge_histogram(events: DataFrame, width: int, height: int, tl: float = 30e6) -> DataFrame:
    return histogram(wedge(events, height, tl), width, height, fill=True)


def voxel(events: DataFrame, n_bins: int, dt: int, width: int, height: int, strict: bool = True) -> DataFrame:
    """Histograms of bins of dt div n_bins; events behind the last bin are dropped. Recordings of two events or fewer have none; one that spans more than dt is an error if strict."""
    if n_bins <= 0 or dt // n_bins <= 0:
        raise ValueError("dt must hold n_bins bins")
    rows = attach(events, per_recording(events, t0=F.min_by("t", "seq"), t1=F.max_by("t", "seq"), k=F.count("*"))).where("k > 2")
    if strict:
        rows = rows.where(F.when(F.expr(f"t1 - t0 > {dt}"), F.raise_error(F.lit("events span more than dt")).cast("boolean")).otherwise(True))
    rows = rows.withColumn("bin", F.expr(f"(t - t0) div {dt // n_bins}")).where(F.col("bin") < n_bins)
    return histogram(rows, width, height, by=("bin",))


def timesurface(events: DataFrame, tau: float, width: int, height: int) -> DataFrame:
    """The decayed age of each pixel's last event, negative for p = 0; the reference time is that of the recording's last row."""
    last = attach(in_bounds(events, width, height).groupBy(*KEY).agg(F.max_by(F.struct("t", "p"), "seq").alias("e")), per_recording(events, t_ref=F.max_by("t", "seq")))
    value = F.exp(-F.greatest(F.lit(0), F.col("t_ref") - F.col("e.t")) / F.lit(float(tau)))
    return last.select(*KEY, F.when(F.col("e.p") == 0, -value).otherwise(value).alias("value"))


def tore(events: DataFrame, k: int, tau: float, width: int, height: int) -> DataFrame:
    """The decayed ages of the k most recent events of each pixel and polarity; slot k - 1 is the newest."""
    rank = F.row_number().over(Window.partitionBy("recording_id", "y", "x", "p").orderBy(F.desc("seq")))
    rows = attach(in_bounds(events, width, height).withColumn("rk", rank).where(F.col("rk") <= k), per_recording(events, t_ref=F.max_by("t", "seq")))
    return rows.select(*KEY, "p", (F.lit(k) - F.col("rk")).cast("int").alias("slot"), F.exp(-(F.col("t_ref") - F.col("t")) / F.lit(float(tau))).alias("value"))


def _last_p(events: DataFrame, width: int, height: int) -> DataFrame:
    return in_bounds(events, width, height).groupBy(*KEY).agg(F.max_by("p", "seq").alias("p"))


def frame_gray(events: DataFrame, width: int, height: int) -> DataFrame:
    """255 or 0 by the pixel's last polarity; the background is 128."""
    return _last_p(events, width, height).select(*KEY, F.when(F.col("p") == 1, 255).otherwise(0).cast("int").alias("value"))


def frame_rgb(events: DataFrame, width: int, height: int, pos=(255, 0, 0), neg=(0, 0, 255)) -> DataFrame:
    """The colour of the pixel's last polarity; the background is black."""
    pick = lambda i: F.when(F.col("p") == 1, pos[i]).otherwise(neg[i]).cast("int")
    return _last_p(events, width, height).select(*KEY, pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


def frame_diff(events: DataFrame, width: int, height: int, bits: int = 8) -> DataFrame:
    """On minus off events, wrapping in a signed integer of ``bits``."""
    half = 1 << (bits - 1)
    total = F.sum(F.when(F.col("p") == 1, 1).otherwise(-1))
    return in_bounds(events, width, height).groupBy(*KEY).agg((F.pmod(total + half, F.lit(2 * half)) - half).cast("int").alias("value"))


def densify(sparse: DataFrame, width: int, height: int, fill: dict[str, object]) -> DataFrame:
    """A row for every pixel of every recording in ``sparse`` (recording_id, y, x, values); the pixels are a generated sequence."""
    grid = sparse.select("recording_id").distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))).select("recording_id", F.expr(f"_i div {width}").cast("int").alias("y"), F.expr(f"_i % {width}").cast("int").alias("x"))
    return grid.join(sparse, list(KEY), "left").fillna(fill)
