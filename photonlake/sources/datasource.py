"""``spark.read.format("event_recordings")``: recordings as a data source, with time filters that prune splits.

Call register(spark) once. Options: fmt (else by suffix or content), triggers (true for those),
index (a Parquet folder that build_index gave, for splits), and strict, layout, delimiter, t_start, t_step, start_ms, end_ms for the codecs.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .. import schema
from . import recordings, splits

CODEC = {"strict": lambda v: v.lower() == "true", "layout": str, "delimiter": str, "t_start": int, "t_step": int, "start_ms": int, "end_ms": int}


class Part(InputPartition):
    def __init__(self, name: str, row: tuple | None = None):
        self.name, self.row = name, row


class EventRecordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_recordings"

    def _triggers(self) -> bool:
        return self.options.get("triggers", "false").lower() == "true"

    def schema(self) -> str:
        return schema.TRIGGERS if self._triggers() else schema.EVENTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), self._triggers())


class _Reader(DataSourceReader):
    def __init__(self, options: dict, triggers: bool):
        self.options, self.triggers = options, triggers
        self.codec = {k: f(options[k]) for k, f in CODEC.items() if k in options}
        self.since, self.until = -(2**63), 2**63 - 1  # both included

    def pushFilters(self, filters):
        """Bounds of t choose splits; Spark still filters rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("t",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.since = max(self.since, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.until = min(self.until, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self):
        from pyarrow import fs

        store, base = splits.store_of(self.options["path"])
        info = store.get_file_info(base)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        names = sorted(f.path for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and not f.base_name.endswith(splits.SIDECAR))
        if "index" not in self.options:
            return [Part(n) for n in names]
        import pyarrow.dataset as ds

        where, at = splits.store_of(self.options["index"])
        rows = ds.dataset(at, filesystem=where, format="parquet").to_table().to_pylist()
        known = {splits.store_of(r["recording_id"])[1] for r in rows}
        live = [r for r in rows if splits.store_of(r["recording_id"])[1] in set(names) and r["t_min"] is not None and r["t_max"] >= self.since and r["t_min"] <= self.until]
        return [Part(r["recording_id"], tuple(r[c] for c in ("recording_id", "fmt", "first", "last", "seq", "trigger_seq", "state"))) for r in live] + [Part(n) for n in names if n not in known]

    def read(self, partition):
        if partition.row:
            yield from splits.decoded([partition.row], self.triggers, **self.codec)
            return
        store, at = splits.store_of(partition.name)
        with store.open_input_file(at) as source:
            seq = 0
            for part in recordings.parts(partition.name, source, self.options.get("fmt"), **self.codec):
                whole = recordings.batch(partition.name, seq, part, self.triggers)
                seq += whole.num_rows
                yield whole


def register(spark) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventRecordings)
