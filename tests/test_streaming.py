"""Streaming forms give what the batch forms give, over several micro-batches."""

import numpy as np
import pytest

from photonlake import schema
from photonlake.operators import filters, windows
from photonlake.streaming import stateful


@pytest.fixture(scope="module")
def recordings():
    r = np.random.default_rng(7)
    t = np.sort(r.integers(0, 4000, 300))
    t[200:] += 20_000
    return [("ab"[i % 2], i, int(v), int(r.integers(0, 3)), 0, i % 2) for i, v in enumerate(t)]


@pytest.mark.parametrize("name", ["refractory", "tumbling", "by_count", "mixed"])
def test_as_batch(spark, recordings, tmp_path, name):
    for k in range(3):
        spark.createDataFrame(recordings[k * 100 : k * 100 + 100], schema.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    asked = {"refractory": (300,), "tumbling": (500,), "by_count": (40,), "mixed": (500, 7)}[name]
    batch = getattr(filters if name == "refractory" else windows, name)(spark.createDataFrame(recordings, schema.EVENTS), *asked)
    query = getattr(stateful, name)(source, *asked).writeStream.format("memory").queryName(f"got_{name}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table(f"got_{name}").select(*batch.columns)
    assert sorted(got.collect()) == sorted(batch.collect())


def test_pace(spark):
    now, slept, seen = [0.0], [], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    rows = lambda *t: spark.createDataFrame([("a", i, v, 0, 0, 0) for i, v in enumerate(t)], schema.EVENTS)
    step = stateful.paced(lambda df, k: seen.append(k), 2.0, 5.0, sleep, lambda: now[0])
    for k, df in enumerate([rows(1_000_000, 3_000_000), rows(5_000_000), rows(90_000_000), rows(92_000_000), rows()]):
        step(df, k)
    assert slept == [1.0, 1.0, 0.0, 1.0] and seen == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        stateful.Pace(0)


def test_tumbling_both(spark, recordings, tmp_path):
    marks = [("a", 0, 5, 1, 2), ("b", 1, 3000, 0, 2), ("b", 2, 10**6, 1, 0), ("c", 3, 40, 1, 1), ("c", 4, 700, 1, 1)]
    spark.createDataFrame(recordings, schema.EVENTS).coalesce(1).write.parquet(str(tmp_path / "ev"))
    spark.createDataFrame(marks, schema.TRIGGERS).coalesce(1).write.parquet(str(tmp_path / "tr"))
    read = lambda name, kind: spark.readStream.schema(kind).parquet(str(tmp_path / name))
    query = stateful.tumbling_both(read("ev", schema.EVENTS), read("tr", schema.TRIGGERS), 500).writeStream.format("memory").queryName("got_both").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("got_both").collect()
    first = {"a": recordings[0][2], "b": recordings[1][2], "c": 40}
    want = [(*r, None, (r[2] - first[r[0]]) // 500) for r in recordings]
    want += [(n, s, t, None, None, p, i, max(0, (t - first[n]) // 500)) for n, s, t, p, i in marks]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_stream_of_files(spark, tmp_path):
    """Each file of a folder once, those that come later too; unfinished and bookmark files are not read."""
    from photonlake.sources.recordings import read_events, stream_events, write_events

    r = np.random.default_rng(3)
    folder = str(tmp_path / "in")

    def put(*names):
        rows = [(n, i, int(t), int(r.integers(0, 60)), 5, i % 2) for n in names for i, t in enumerate(np.sort(r.integers(0, 10**6, 200)))]
        marks = [(n, 0, 70, 1, 3) for n in names]
        write_events(spark.createDataFrame(rows, schema.EVENTS), folder, "evt3", "gz", triggers=spark.createDataFrame(marks, schema.TRIGGERS))

    def run(name, **options):
        query = stream_events(spark, folder, max_files=2, **options).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / name)).collect()

    put("a", "b", "c")
    (tmp_path / "in/x.evt3.tmp_index").write_bytes(b"none")
    (tmp_path / "in/.y.part").write_bytes(b"none")
    assert sorted(run("ev")) == sorted(read_events(spark, folder).collect()) and len(run("ev")) == 600
    put("d")
    assert sorted(run("ev")) == sorted(read_events(spark, folder).collect()) and len(run("ev")) == 800
    assert [(x.t, x.p, x.id) for x in run("tr", triggers=True)] == [(70, 1, 3)] * 4


@pytest.mark.parametrize("name", ["by_count", "mixed"])
def test_triggers_ride_along(spark, recordings, tmp_path, name):
    asked = {"by_count": (40,), "mixed": (500, 7)}[name]
    marks = [(n, i, t, i % 2, 1) for n in "ab" for i, t in enumerate([0, 700, 1500, recordings[150][2], 3999, 21_000, 23_000, 90_000])]
    ends = [recordings[99][2], recordings[199][2], 10**6]
    for k in range(3):  # triggers come with the events of their time
        now = [m for m in marks if m[2] <= ends[k] and (not k or m[2] > ends[k - 1])]
        spark.createDataFrame(recordings[k * 100 : k * 100 + 100], schema.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"ev/{k}"))
        spark.createDataFrame(now, schema.TRIGGERS).coalesce(1).write.parquet(str(tmp_path / f"tr/{k}"))
    read = lambda folder, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{folder}/*"))
    both = getattr(stateful, f"{name}_both")(read("ev", schema.EVENTS), read("tr", schema.TRIGGERS), *asked)
    both.writeStream.format("memory").queryName(f"rode_{name}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.table(f"rode_{name}")
    batch = getattr(windows, name)(spark.createDataFrame(recordings, schema.EVENTS), *asked)
    assert sorted(got.where("id is null").select(*batch.columns).collect()) == sorted(batch.collect())
    want = windows.triggers_by_start(batch, spark.createDataFrame(marks, schema.TRIGGERS))
    assert sorted(got.where("id is not null").select(*want.columns).collect()) == sorted(want.collect())
