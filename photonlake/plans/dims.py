"""Per-recording facts, broadcast when they are counted to be few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Recordings up to which a table with one row for each is broadcast.
FEW = 200_000


def per_recording(events: DataFrame, **facts: Column) -> DataFrame:
    return events.groupBy("recording_id").agg(*[c.alias(k) for k, c in facts.items()])


def attach(events: DataFrame, dim: DataFrame) -> DataFrame:
    """events with the columns of a table keyed by recording_id. A small table is worked out once, here, and broadcast as rows; a large one
    is joined by shuffle, where AQE splits a hot recording."""
    rows = dim.limit(FEW + 1).toArrow()
    if rows.num_rows <= FEW:
        dim = F.broadcast(events.sparkSession.createDataFrame(rows, dim.schema))
    return events.join(dim, "recording_id")


def with_origin(events: DataFrame) -> DataFrame:
    """events with t0, the time of the first event of the recording in stream order."""
    return attach(events, per_recording(events, t0=F.min_by("t", "seq")))
