"""Structured Streaming forms of the stateful operators; state is kept for each recording or pixel."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.windows import MixedState, positive


def refractory(stream: DataFrame, delta: int) -> DataFrame:
    """As the batch filter; the state of a pixel is its last time. Rows of a micro-batch are taken in seq order."""

    def of(key, parts, state):
        last = state.get[0] if state.exists else None
        for pdf in parts:
            pdf = pdf.sort_values("seq")
            t = pdf["t"].to_numpy()
            since = np.diff(t, prepend=t[0] if last is None else last)
            keep = since > delta
            if last is None:
                keep[0] = True
            last = int(t[-1])
            yield pdf[keep]
        if last is not None:
            state.update((int(last),))

    return stream.groupBy("recording_id", "x", "y").applyInPandasWithState(of, stream.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, delta_t: int) -> DataFrame:
    """Events with window_id, anchored at the recording's first event; the state is that event's time."""
    positive("delta_t", delta_t)
    names = stream.columns
    schema = ", ".join(f"{n} {k}" for n, k in stream.dtypes) + ", window_id long"

    def of(key, parts, state):
        t0 = state.get[0] if state.exists else None
        for pdf in parts:
            pdf = pdf.sort_values("seq")
            if t0 is None:
                t0 = int(pdf["t"].iloc[0])
                state.update((t0,))
            yield pdf[names].assign(window_id=(pdf["t"] - t0) // delta_t)

    return stream.groupBy("recording_id").applyInPandasWithState(of, schema, "t0 long", "append", GroupStateTimeout.NoTimeout)


def _together(stream: DataFrame, triggers: DataFrame) -> DataFrame:
    """Events, whose id is null, and triggers, whose x and y are null."""
    none = F.lit(None)
    rows = stream.select("recording_id", "seq", "t", "x", "y", "p", none.cast("short").alias("id"))
    return rows.unionByName(triggers.select("recording_id", "seq", "t", none.cast("int").alias("x"), none.cast("int").alias("y"), "p", "id"))


def tumbling_both(stream: DataFrame, triggers: DataFrame, delta_t: int) -> DataFrame:
    """Events (id is null) and triggers (x and y are null) with the window_id that they share. The anchor is the first event of the first
    micro-batch with rows of the recording, or its first trigger if that has no events; what is earlier is in window 0."""
    positive("delta_t", delta_t)
    rows = _together(stream, triggers)
    schema = ", ".join(f"{n} {k}" for n, k in rows.dtypes) + ", window_id long"

    def of(key, parts, state):
        pdf = pd.concat(list(parts)).sort_values("seq", kind="stable")
        if not state.exists:
            events = pdf[pdf["id"].isna()]
            state.update((int((events if len(events) else pdf)["t"].iloc[0]),))
        whole = {c: pdf[c].astype("Int64") for c in ("x", "y", "id")}
        yield pdf.assign(**whole, window_id=((pdf["t"] - state.get[0]) // delta_t).clip(lower=0))

    return rows.groupBy("recording_id").applyInPandasWithState(of, schema, "t0 long", "append", GroupStateTimeout.NoTimeout)


def by_count(stream: DataFrame, n_events: int) -> DataFrame:
    """Events with window_id = position div n_events; the state is how many events the recording has had. Rows of a micro-batch are taken in seq order."""
    positive("n_events", n_events)
    names = stream.columns
    schema = ", ".join(f"{n} {k}" for n, k in stream.dtypes) + ", window_id long"

    def of(key, parts, state):
        pdf = pd.concat(list(parts)).sort_values("seq")
        seen = state.get[0] if state.exists else 0
        state.update((seen + len(pdf),))
        yield pdf[names].assign(window_id=(seen + np.arange(len(pdf))) // n_events)

    return stream.groupBy("recording_id").applyInPandasWithState(of, schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def mixed(stream: DataFrame, delta_t: int, n_events: int) -> DataFrame:
    """Events with window_id as the batch form's, for recordings in time order; the state is the open window's start, size and number."""
    positive("delta_t", delta_t), positive("n_events", n_events)
    names = stream.columns
    schema = ", ".join(f"{n} {k}" for n, k in stream.dtypes) + ", window_id long"

    def of(key, parts, state):
        pdf = pd.concat(list(parts)).sort_values("seq")
        now = MixedState(delta_t, n_events, *(state.get if state.exists else ()))
        found = now.take(pdf["t"].to_numpy())
        state.update((int(now.start), int(now.size), int(now.k)))
        yield pdf[names].assign(window_id=found)

    return stream.groupBy("recording_id").applyInPandasWithState(of, schema, "start long, size long, k long", "append", GroupStateTimeout.NoTimeout)


def _riding(stream: DataFrame, triggers: DataFrame, kept: str, cut) -> DataFrame:
    """Events and triggers with window_id; a trigger has the last window whose first event is not after it, of those up to its
    micro-batch, or window 0. cut(t, state or None) gives the windows of the next events, the window that was open before them (0 if none), and the new state."""
    rows = _together(stream, triggers)
    schema = ", ".join(f"{n} {k}" for n, k in rows.dtypes) + ", window_id long"

    def of(key, parts, state):
        pdf = pd.concat(list(parts)).sort_values("seq", kind="stable")
        event = pdf["id"].isna().to_numpy()
        t, ids = pdf["t"].to_numpy(), np.zeros(len(pdf), np.int64)
        found, before, now = cut(t[event], state.get if state.exists else None)
        if now is not None:
            state.update(now)
        new = np.flatnonzero(np.diff(found, prepend=before))  # window 0, and one that is open, need no start
        at = np.searchsorted(np.maximum.accumulate(t[event][new]), t[~event], "right")
        ids[event], ids[~event] = found, np.concatenate(([before], found[new]))[at]
        whole = {c: pdf[c].astype("Int64") for c in ("x", "y", "id")}
        yield pdf.assign(**whole, window_id=ids)

    return rows.groupBy("recording_id").applyInPandasWithState(of, schema, kept, "append", GroupStateTimeout.NoTimeout)


def by_count_both(stream: DataFrame, triggers: DataFrame, n_events: int) -> DataFrame:
    """Events (id is null) and triggers (x and y are null) with count windows, for recordings in time order whose triggers come with the events of their time."""
    positive("n_events", n_events)

    def cut(t, state):
        seen = state[0] if state else 0
        return (seen + np.arange(len(t))) // n_events, max(seen - 1, 0) // n_events, (seen + len(t),)

    return _riding(stream, triggers, "seen long", cut)


def mixed_both(stream: DataFrame, triggers: DataFrame, delta_t: int, n_events: int) -> DataFrame:
    """As by_count_both, with mixed windows."""
    positive("delta_t", delta_t), positive("n_events", n_events)

    def cut(t, state):
        now = MixedState(delta_t, n_events, *(state or ()))
        before = now.k
        found = now.take(t)
        return found, before, None if now.start is None else (int(now.start), int(now.size), int(now.k))

    return _riding(stream, triggers, "start long, size long, k long", cut)


class Pace:
    """How long to wait before rows are handed on, so that their times pass at ``speed`` times real time from the first ones on.

    The anchor is absolute: a late consumer is not delayed further. A wait of more than ``max_gap`` seconds is skipped and
    the anchor moves; None never skips.
    """

    def __init__(self, speed: float = 1.0, max_gap: float | None = None, clock=time.monotonic):
        if speed <= 0:
            raise ValueError("speed must be positive")
        self.speed, self.max_gap, self.clock, self.anchor = speed, max_gap, clock, None

    def delay(self, first: int, last: int) -> float:
        """Seconds to wait for rows whose times are first to last (µs)."""
        now = self.clock()
        if self.anchor is None:
            self.anchor = now, first
        wait = self.anchor[0] + (last - self.anchor[1]) / (1e6 * self.speed) - now
        if self.max_gap is not None and wait > self.max_gap:
            self.anchor = now, last
            return 0.0
        return max(wait, 0.0)


def paced(handle: Callable[[DataFrame, int], None], speed: float = 1.0, max_gap: float | None = None, sleep=time.sleep, clock=time.monotonic) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that hands each micro-batch to ``handle`` when its last event is due. Only its time bounds come to the driver."""
    pace = Pace(speed, max_gap, clock)

    def of(batch: DataFrame, number: int) -> None:
        bounds = batch.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
        if bounds.a is not None:
            sleep(pace.delay(bounds.a, bounds.b))
        handle(batch, number)

    return of
