"""Windows of a stream, anchored at a recording's first event; all are half open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.dims import attach, per_recording, with_origin

#: Consecutive stream positions that are numbered in one go.
BUCKET = 1 << 16
DEFAULT_DT, DEFAULT_N = 10_000, 1_000_000


def positive(name: str, value: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an integer")
    if value <= 0:
        raise ValueError(f"{name} must be positive")
    return value


def resolve_mode(mode: str = "auto", delta_t: int | None = None, n_events: int | None = None) -> tuple[str, int | None, int | None]:
    """The mode that reader parameters ask for: both cut-offs or none mean mixed, with defaults; one means that one."""
    if mode not in ("auto", "delta_t", "n_events", "mixed", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    for name, v in (("delta_t", delta_t), ("n_events", n_events)):
        if v is not None:
            positive(name, v)
    if mode == "auto":
        if (delta_t is None) == (n_events is None):
            return "mixed", delta_t or DEFAULT_DT, n_events or DEFAULT_N
        return ("delta_t", delta_t, None) if delta_t else ("n_events", None, n_events)
    if mode in ("delta_t", "mixed") and delta_t is None or mode in ("n_events", "mixed") and n_events is None:
        raise ValueError(f"mode {mode!r} needs its cut-off")
    return mode, delta_t, n_events


def tumbling(events: DataFrame, delta_t: int = DEFAULT_DT) -> DataFrame:
    """window_id = (t - t0) div delta_t. Rows before t0, in unsorted streams, are in negative windows."""
    positive("delta_t", delta_t)
    return with_origin(events).withColumn("window_id", F.expr(f"(t - t0) div {delta_t} - if((t - t0) % {delta_t} < 0, 1L, 0L)")).drop("t0")


def tumbling_grid(events: DataFrame, delta_t: int = DEFAULT_DT) -> DataFrame:
    """recording_id, window_id, start of all windows from the first event to the last, empty ones too."""
    positive("delta_t", delta_t)
    span = per_recording(events, t0=F.min_by("t", "seq"), t1=F.max("t"))
    # arrays stay short, however long the recording is
    part = span.select("recording_id", "t0", F.expr(f"(t1 - t0) div {delta_t}").alias("_z"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(t1 - t0) div {delta_t * BUCKET}"))).alias("_k"))
    grid = part.select("recording_id", "t0", F.explode(F.expr(f"sequence(_k * {BUCKET}, least(_z, _k * {BUCKET} + {BUCKET - 1}))")).alias("window_id"))
    return grid.select("recording_id", "window_id", (F.col("t0") + F.col("window_id") * delta_t).alias("start"))


def sliding(events: DataFrame, hop: int = DEFAULT_DT, size: int = 2 * DEFAULT_DT, full: bool = False) -> DataFrame:
    """A row for each window [t0 + k hop, + size) that an event is in; ``full`` leaves out windows that the last event does not reach the end of."""
    positive("delta_t", hop), positive("window_size", size)
    rows = attach(events, per_recording(events, t0=F.min_by("t", "seq"), t1=F.max_by("t", "seq")))
    low = F.expr(f"if(t - t0 < {size}, 0L, (t - t0 - {size}) div {hop} + 1)")
    high = F.expr(f"(t - t0) div {hop}")
    if full:
        high = F.least(high, F.expr(f"if(t1 - t0 >= {size}, (t1 - t0 - {size}) div {hop}, -1L)"))
    rows = rows.withColumn("_lo", low).withColumn("_hi", high).where("t >= t0 and _lo <= _hi")
    return rows.withColumn("window_id", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi", "t0", "t1")


def numbered(events: DataFrame, name: str = "n") -> DataFrame:
    """events with their dense position in the recording: counts of buckets of seq are summed, rows are numbered inside buckets only."""
    bucket = events.withColumn("_b", F.expr(f"seq div {BUCKET}"))
    counts = bucket.groupBy("recording_id", "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("recording_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("recording_id", "_b", F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("recording_id", "_b").orderBy("seq"))
    return bucket.withColumn("_r", inside).join(counts, ["recording_id", "_b"]).withColumn(name, F.col("_o") + F.col("_r") - 1).drop("_b", "_r", "_o")


def by_count(events: DataFrame, n_events: int) -> DataFrame:
    """window_id = position div n_events."""
    positive("n_events", n_events)
    return numbered(events, "_n").withColumn("window_id", F.expr(f"_n div {n_events}")).drop("_n")


def mixed_cuts(t: list[int], delta_t: int, n_events: int) -> list[int]:
    """Window number of each time of one recording: whichever cut comes first, time on a tie. After a count cut the next window starts
    at the first excluded event; after a time cut, one delta_t on, so windows without events take a number too."""
    import bisect

    out, i, k = [0] * len(t), 0, 0
    start = t[0] if t else 0
    while i < len(t):
        j = bisect.bisect_left(t, start + delta_t, i)
        if j - i > n_events:
            j = i + n_events
            start = t[j]
        else:
            start += delta_t
            if j == i:
                more = (t[i] - start) // delta_t if t[i] >= start else 0
                start, k = start + more * delta_t, k + 1 + more
                continue
        out[i:j] = [k] * (j - i)
        i, k = j, k + 1
    return out


class MixedState:
    """Mixed cuts of one recording whose times come in pieces; start, size and number of the open window. With keep_grid a count cut
    leaves the time grid as it is."""

    def __init__(self, delta_t: int, n_events: int, start: int | None = None, size: int = 0, k: int = 0, keep_grid: bool = False):
        self.delta_t, self.n_events, self.start, self.size, self.k, self.keep_grid = delta_t, n_events, start, size, k, keep_grid

    def take(self, t: np.ndarray) -> np.ndarray:
        """Window numbers of the next times."""
        out, i = np.empty(len(t), np.int64), 0
        while i < len(t):
            if self.start is None:
                self.start = int(t[0])
            room = self.n_events - self.size
            late = t[i : i + room + 1] >= self.start + self.delta_t
            j = int(np.argmax(late)) if late.any() else len(late)
            if j == 0:  # time is up
                steps = (int(t[i]) - self.start) // self.delta_t
                self.start, self.k, self.size = self.start + steps * self.delta_t, self.k + steps, 0
                continue
            if j > room:  # one event too many
                out[i : i + room] = self.k
                i, self.k, self.size = i + room, self.k + 1, 0
                self.start = self.start if self.keep_grid else int(t[i])
                continue
            out[i : i + j] = self.k
            i, self.size = i + j, self.size + j
        return out


def mixed(events: DataFrame, delta_t: int = DEFAULT_DT, n_events: int = DEFAULT_N, keep_grid: bool = False) -> DataFrame:
    """window_id by mixed cuts. Each cut depends on the one before, so a recording is in one task, which reads it in order as a stream."""
    positive("delta_t", delta_t), positive("n_events", n_events)
    names = events.columns
    which, when = names.index("recording_id"), names.index("t")

    def cut(batches):
        name, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(which))
            found, a = [], 0
            t = b.column(when).to_numpy()
            for value, z in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if state is None or value != name:
                    name, state = value, MixedState(delta_t, n_events, keep_grid=keep_grid)
                found.append(state.take(t[a:z]))
                a = z
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(found))], [*names, "window_id"])

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.repartition(n, "recording_id").sortWithinPartitions("recording_id", "seq")
    return rows.mapInArrow(cut, StructType([*events.schema.fields, StructField("window_id", LongType())]))


def capped(events: DataFrame, delta_t: int, max_events: int = 10_000_000, keep_grid: bool = False) -> DataFrame:
    """Time windows of at most max_events: a fuller one is cut, and the next starts at the first event that is left out, or
    with keep_grid goes on to the end of the same interval."""
    return mixed(events, delta_t, max_events, keep_grid)


def overridden(events: DataFrame, mode: str = "auto", delta_t: int | None = None, n_events: int | None = None, max_events: int = 10_000_000, max_time: int = 1_000_000_000_000) -> DataFrame:
    """window_id in the mode that reader parameters ask for; a mode's missing cut-off is its safety cap. Mode all has window 0 alone."""
    mode, delta_t, n_events = resolve_mode(mode, delta_t, n_events)
    if mode == "all":
        return events.withColumn("window_id", F.lit(0).cast("long"))
    return mixed(events, min(delta_t or max_time, max_time), min(n_events or max_events, max_events))


def sort_events(events: DataFrame) -> DataFrame:
    """Order by time, ties by x, y, p."""
    return events.orderBy("recording_id", "t", "x", "y", "p")


def triggers_by_time(events: DataFrame, triggers: DataFrame, delta_t: int) -> DataFrame:
    """Triggers with the tumbling window whose time they fall in: earlier ones in the first, later ones in the last."""
    positive("delta_t", delta_t)
    rows = attach(triggers, per_recording(events, t0=F.min_by("t", "seq"), t1=F.max("t")))
    last = F.expr(f"(t1 - t0) div {delta_t}")
    return rows.withColumn("window_id", F.least(F.greatest(F.lit(0).cast("long"), F.expr(f"(t - t0) div {delta_t}")), last)).drop("t0", "t1")


def triggers_by_count(events: DataFrame, triggers: DataFrame, n_events: int) -> DataFrame:
    """Triggers with the count window they ride with: the first whose successor starts after them, or the last. An as-of join as a running maximum."""
    return triggers_by_start(by_count(events, n_events), triggers)


def triggers_by_start(windowed: DataFrame, triggers: DataFrame) -> DataFrame:
    """Triggers with the last window of events (with window_id, of any kind) that starts at or before them, or the first window."""
    first = windowed.groupBy("recording_id", "window_id").agg(F.min("t").alias("t"))
    marks = first.where("window_id > 0").select("recording_id", "t", F.lit(0).alias("k"), F.col("window_id").alias("w"), *[F.lit(None).cast(k).alias(c) for c, k in (("seq", "long"), ("p", "short"), ("id", "short"))])
    both = marks.unionByName(triggers.select("recording_id", "t", F.lit(1).alias("k"), F.lit(None).cast("long").alias("w"), "seq", "p", "id"))
    order = Window.partitionBy("recording_id").orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("window_id", F.coalesce(F.max("w").over(order), F.lit(0).cast("long"))).where("k = 1").select("recording_id", "seq", "t", "p", "id", "window_id")
