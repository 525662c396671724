import pickle
import sys
import types

import numpy as np
import pytest

from photonlake.operators.windows import mixed_cuts, resolve_mode
from photonlake.sources import aedat, codecs
from photonlake.sources.recordings import encoded, read_csv_events, read_events


def events(n=5000, side=512, span=100_000, seed=42):
    r = np.random.default_rng(seed)
    return np.sort(r.integers(0, span, n)), r.integers(0, side, n), r.integers(0, side, n), r.integers(0, 2, n)


@pytest.mark.parametrize("fmt", ["evt2", "evt21", "evt3", "evt4", "dat", "csv", "npz", "aer", "aedat4"])
def test_round_trip(fmt):
    t, x, y, p = events()
    got = codecs.decode(f"a.{fmt}", codecs.encode(fmt, t, x, y, p))
    for a, b in zip((np.zeros_like(t) if fmt == "aer" else t, x, y, p), got):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("fmt", ["evt2", "evt21", "evt4"])
def test_wrap_34_bits(fmt):
    t = 2**34 - 50 + np.arange(10) * 10
    got = codecs.decode(f"a.{fmt}", codecs.encode(fmt, t, t % 7, t % 5, t % 2))
    assert np.array_equal(np.diff(got[0]), np.diff(t))


def test_evt3_wraps_and_vectors():
    t = np.arange(90) * 1_000_000
    assert np.array_equal(codecs.decode("a.evt3", codecs.encode("evt3", t, t % 7, t % 5, t % 2))[0], t)
    words = np.array([0x8000, 0x6000, 0x0000, 0x3000, 0x4FFF, 0x2000 | 200], "<u2").tobytes()
    assert codecs.evt3(words)[1].tolist() == [*range(12), 200]
    block = np.array([0x8000, 0x6000, 0x0000, 0x3000, 0x4FFF, 0x4FFF, 0x50FF], "<u2").tobytes()
    assert codecs.evt3(block)[1].tolist() == list(range(32))
    with pytest.raises(ValueError):
        codecs.evt3(np.array([0x8000, 0x5001], "<u2").tobytes(), strict=True)


def test_dirty_csv():
    got = codecs.csv(b"\r\n 10,1,2,1,9\r\nx,5\n12ab,70000,3.9,1")
    assert got[0].tolist() == [10, 0, 12] and got[1].tolist() == [1, 5, 4464] and got[2].tolist() == [2, 0, 3]
    with pytest.raises(ValueError):
        codecs.csv(b"t,x,y\n1,2,3")
    with pytest.raises(NotImplementedError):
        codecs.sniff("a.bin", b"")


def test_garbage_does_not_crash():
    noise = np.random.default_rng(1).bytes(100_000)
    for fmt in ("evt2", "evt21", "evt3", "evt4", "dat", "aer"):
        codecs.decode(f"a.{fmt}", codecs.encode(fmt, *events(10)) + noise, fmt)


def test_mixed_and_modes():
    t = [*range(50), *(1_000_000 + k * 1000 for k in range(50))]
    cuts = mixed_cuts(t, 10_000, 30)
    assert cuts.count(0) == 30 and len(cuts) == 100 and max(map(cuts.count, set(cuts))) <= 30
    assert resolve_mode() == ("mixed", 10_000, 1_000_000)
    with pytest.raises(ValueError):
        resolve_mode("delta_t")
    with pytest.raises(TypeError):
        resolve_mode("auto", 1.5)


def test_files_of_recordings(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"r{k}.evt3").write_bytes(codecs.encode("evt3", *events(200, seed=k)))
    df = read_events(spark, str(tmp_path))
    assert df.count() == 600 and df.select("recording_id").distinct().count() == 3
    again = encoded(df, "dat").collect()
    assert len(again) == 3 and len(codecs.decode("a.dat", bytes(again[0].content))[0]) == 200


def packet(kind, data, t, overflow=0):
    head = np.array([(kind, 0, 8, 4, overflow, len(t), len(t), len(t))], aedat._V3_HEAD)
    return head.tobytes() + np.stack((data, t), 1).astype("<u4").tobytes()


def test_aedat3():
    t, x, y, p = events(1000, side=300)
    valid = np.arange(1000) % 9 != 0
    words = x << 17 | y << 2 | p << 1 | valid
    head = b"#!AER-DAT3.1\r\n#Format: RAW\r\n#!END-HEADER\r\n"
    marks = np.array([2 << 1 | 1, 3 << 1 | 1, 1 << 1 | 1, 2 << 1])
    body = packet(3, words[:5], t[:5]) + packet(1, words[:600], t[:600]) + packet(0, marks, np.arange(4)) + packet(1, words[600:], t[600:], 2)
    got = codecs.decode("a.aedat", head + body + b"cut")
    later = t + np.where(np.arange(1000) >= 600, 2 << 31, 0)
    for a, b in zip((later, x, y, p), got):
        assert np.array_equal(a[valid], b)
    assert got[4].tolist() == [0, 1] and got[5].tolist() == [1, 0] and got[6].tolist() == [0, 0]
    assert len(codecs.decode("a.aedat", head)[0]) == 0


@pytest.mark.parametrize("compression", ["none", "zstd", "zstd_high"])
def test_aedat4_triggers(compression):
    t, x, y, p = events(300)
    data = aedat.encode4(t, x, y, p, 512, 512, ([5, 9], [1, 0]), compression, per_packet=70)
    got = codecs.decode("a.aedat4", data + b"cut")
    assert all(np.array_equal(a, b) for a, b in zip((t, x, y, p), got))
    assert got[4].tolist() == [5, 9] and got[5].tolist() == [1, 0]
    assert codecs.sniff("a.aedat", data) == "aedat4"
    with pytest.raises(ValueError):
        aedat.aedat4(data[:20])


def test_hdf5_trees():
    table = np.array([(1, 2, 1, 10), (3, 4, -1, 20)], [("x", "u2"), ("y", "u2"), ("p", "i2"), ("t", "i8")])
    for tree in ({"CD": {"events": table}}, {"events": table}, {"events": {c: table[c] for c in "txyp"}}):
        got = codecs.hdf5_columns(tree | {"t_offset": np.array(5)})
        assert [c.tolist() for c in got[:4]] == [[15, 25], [1, 3], [2, 4], [1, 0 if "CD" in tree or isinstance(tree["events"], np.ndarray) else -1]]
    with pytest.raises(ValueError):
        codecs.hdf5_columns({"other": 1})


class Tree(dict):
    """Stands in for an HDF5 file, as that package may be absent: what is created is kept, and pickled when the file is closed."""

    def __init__(self, file, mode):
        super().__init__(pickle.load(file) if mode == "r" else {})
        self.file, self.mode, self.attrs = file, mode, {}

    def create_group(self, name):
        self[name] = group = Tree(None, "g")
        return group

    def create_dataset(self, name, data, **kw):
        self[name] = np.asarray(data)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.mode == "w":
            pickle.dump({k: dict(v) if isinstance(v, Tree) else v for k, v in self.items()}, self.file)


@pytest.mark.parametrize("start", [0, 5_000_300])
def test_hdf5_index(monkeypatch, start):
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=Tree))
    t, x, y, p = events(3000, span=40_000)
    t = t + start
    data = codecs.encode("hdf5", t, x, y, p)
    assert all((a == b).all() for a, b in zip(codecs.decode("a.h5", data), (t, x, y, p)))
    many = list(codecs.hdf5_pieces(data, rows=700))
    assert len(many) == 5 and (np.concatenate([m[0] for m in many]) == t).all()
    index, base = codecs.ms_index(t), int(t[0]) // 1000
    assert index.tolist() == [int((t < (base + k) * 1000).sum()) for k in range(int(t[-1]) // 1000 - base + 1)] + [len(t)]
    for a, z in ((0, -1), (base + 3, base + 9), (base + 3, -1), (0, base + 2), (0, 0), (base + 7, base + 7), (base + 10**6, -1), (base, base + 10**6)):
        want = t[(t >= a * 1000) & ((t < z * 1000) | (z == -1))]
        assert codecs.hdf5(data, start_ms=a, end_ms=z)[0].tolist() == want.tolist()
    for bad in ({"start_ms": -1}, {"start_ms": 5, "end_ms": 4}):
        with pytest.raises(ValueError):
            codecs.hdf5(data, **bad)
    with pytest.raises(ValueError):
        codecs.ms_rows({"events": {}})
    none = codecs.encode("hdf5", *(np.empty(0, np.int64),) * 4)
    assert codecs.ms_index(np.empty(0, np.int64)).tolist() == [0] and not len(codecs.decode("a.h5", none)[0])


def test_csv_in_splits(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"r{k}.csv").write_bytes(codecs.encode("csv", *events(3000, seed=k)))
    (tmp_path / "dirty.csv").write_bytes(b"\r\n 10,1,2,1,9\r\nx,5\n \n12ab,70000,3.9,1")
    (tmp_path / "turned.csv").write_bytes(b"p, X ,note,t,y\n1,2,n,3,4\n,,,,\n-1,-1,,-7,9")
    (tmp_path / "empty.csv").write_bytes(b"")
    want = read_events(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = read_csv_events(spark, str(tmp_path))
        assert got.schema.simpleString() == want.schema.simpleString() and got.rdd.getNumPartitions() > 10
        assert sorted(got.collect()) == sorted(want.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "bad.csv").write_bytes(b"t,x,y\n1,2,3")
    with pytest.raises(Exception, match="lacks a column"):
        read_csv_events(spark, str(tmp_path / "bad.csv")).collect()


def scalar_evt3(words):
    """One word after the other."""
    out, warned = [], 0
    high = wraps = t = y = base = p = i = 0
    while i < len(words) and words[i] >> 12 != 8 and any(w >> 12 == 8 for w in words):
        i += 1
    while i < len(words):
        kind, data = words[i] >> 12, words[i] & 0xFFF
        if kind == 8:
            wraps += data < high
            high = data
        elif kind == 6:
            t = (wraps << 24) + (high << 12) + data
        elif kind == 0:
            y = data & 2047
        elif kind == 3:
            base, p = data & 2047, data >> 11
        elif kind == 2:
            out.append((t, data & 2047, y, data >> 11))
        elif kind == 5:
            warned += 1
        elif kind == 4:
            bits = data
            if i + 1 < len(words) and words[i + 1] >> 12 == 4:
                i += 1
                bits |= (words[i] & 0xFFF) << 12
                if i + 1 < len(words) and words[i + 1] >> 12 == 5:
                    i += 1
                    bits |= (words[i] & 0xFF) << 24
            out += [(t, base + k & 65535, y, p) for k in range(32) if bits >> k & 1]
            base = base + 32 & 65535
        i += 1
    return out, warned


def evt3_of(words, **options):
    return list(zip(*(c.tolist() for c in codecs.evt3(np.array(words, "<u2").tobytes(), **options)[:4])))


@pytest.mark.filterwarnings("ignore:.*vector words")
def test_evt3_word_by_word():
    xs = lambda *w: [e[1] for e in evt3_of([0x8000, 0x6000, *w])]
    assert xs(0x3000, 0x4001, 0x6001, 0x4001) == [0, 32]
    assert xs(0x3000, *[0x4001] * 4) == [0, 12, 32, 44]
    with pytest.warns(UserWarning):
        assert xs(0x3000, 0x5001, 0x2007) == [7]
    with pytest.raises(ValueError):
        evt3_of([0x8000, 0x6000, 0x3000, 0x5001], strict=True)
    assert [e[0] for e in evt3_of([0x8000, 0x6005, 0x2001, 0x8001, 0x2001, 0x6000, 0x2001])] == [5, 5, 4096]
    r = np.random.default_rng(3)
    for n in (1, 5, 2000):
        for _ in range(20):
            kinds = r.choice([0, 2, 3, 4, 4, 4, 5, 6, 8, 10, 14], n)
            words = (kinds << 12 | r.integers(0, 4096, n)).tolist()
            assert evt3_of(words) == scalar_evt3(words)[0]


@pytest.mark.filterwarnings("ignore:.*vector words")
@pytest.mark.parametrize("fmt", ["evt2", "evt21", "evt3", "evt4", "dat"])
def test_pieces_equal_the_whole(fmt):
    r = np.random.default_rng(5)
    wide, shift, kind = codecs.PIECEWISE[fmt]
    data = codecs.encode(fmt, *events(4000, span=2**26 if fmt != "evt3" else 2**27), triggers=None) + (r.integers(0, 2**16, 8000).astype("<u2").tobytes() if fmt != "dat" else b"")
    whole = getattr(codecs, fmt)(data[codecs.body_at(fmt, data) :])
    for size in (64, 1000, 7777):
        parts = list(codecs.pieces(fmt, data, size))
        assert len(parts) > 3 and all(np.array_equal(np.concatenate(c), w) for c, w in zip(zip(*parts), whole))


@pytest.mark.parametrize("fmt", ["evt2", "evt21", "evt3", "evt4", "aedat4"])
def test_triggers_round_trip(fmt):
    t, x, y, p = events(100)
    marks = np.array([10_000, 10_064, 20_000]), np.array([1, 0, 1]), np.array([3, 3, 7])
    got = codecs.decode(f"a.{fmt}", codecs.encode(fmt, t, x, y, p, triggers=marks))
    assert all(np.array_equal(a, b) for a, b in zip((t, x, y, p, *marks[:2]), got))
    assert fmt == "aedat4" or got[6].tolist() == [3, 3, 7]
    with pytest.warns(UserWarning):
        codecs.encode("csv", t, x, y, p, triggers=marks)


def test_options_of_codecs():
    t, x, y, p = events(50)
    data = codecs.encode("csv", t, x, y, p, sep=";", order="pxyt", header=False)
    assert all(np.array_equal(a, b) for a, b in zip((t, x, y, p), codecs.csv(data, ";", tuple("pxyt"))))
    assert codecs.csv(b"99999999999999999999,1,2,1")[0].tolist() == [0]
    flat = np.zeros(5000, int)
    assert len(codecs.encode("npz", flat, flat, flat, flat, compressed=True)) < len(codecs.encode("npz", flat, flat, flat, flat)) / 10
    aer = codecs.encode("aer", t, x, y, p)
    assert np.array_equal(codecs.decode("a.aer", aer, timestamps=t)[0], t)
    with pytest.raises(ValueError):
        codecs.decode("a.aer", aer, timestamps=t[:10])
    assert codecs.sniff("plain", codecs.encode("dat", t, x, y, p)) == "dat" and codecs.sniff("plain", codecs.encode("evt2", t, x, y, p)) == "evt2"
    head = b"% evt 2.1\n% endianness little\n% end\n"
    with pytest.raises(NotImplementedError):
        codecs.decode("a.raw", head + bytes(16))
    for name in ("gz", "bz2", "xz", "zst"):
        end, packed = codecs.compress(name, aer)
        assert codecs.decompress(f"a.aer{end}", packed) == ("a.aer", aer)
    codecs.EXTRA["own"] = lambda data: (np.arange(len(data)),) * 7
    try:
        assert len(codecs.decode("a.own", b"abc")[0]) == 3
    finally:
        del codecs.EXTRA["own"]


@pytest.mark.parametrize("fmt", ["evt2", "evt21", "evt3", "evt4", "dat"])
def test_splits(spark, tmp_path, fmt):
    from photonlake import schema
    from photonlake.sources import datasource, recordings, splits

    t, x, y, p = events(6000, side=300, span=2**26)
    rows = [(name, i, *map(int, e)) for name in "ab" for i, e in enumerate(zip(t, x, y, p))]
    marks = [("a", i, int(v), i % 2, i % 8) for i, v in enumerate(t[::500])]
    df = spark.createDataFrame(rows, schema.EVENTS)
    triggers = spark.createDataFrame(marks, schema.TRIGGERS) if fmt != "dat" else None
    folder, key = str(tmp_path / "in"), lambda d: sorted(tuple(r)[1:] for r in d.collect())
    written = recordings.write_events(df, folder, fmt, triggers=triggers)
    assert written.count() == 2
    index = splits.build_index(spark, folder, size=4000)
    index.write.parquet(str(tmp_path / "index"))
    assert index.count() > 8
    want = sorted(r[1:] for r in rows)
    assert key(recordings.read_events(spark, folder)) == want == key(splits.read_indexed(index))
    a, z = int(t[2000]), int(t[2500])
    assert key(splits.read_indexed(index, since=a, until=z)) == [r for r in want if a <= r[1] < z]
    datasource.register(spark)
    source = spark.read.format("event_recordings")
    assert key(source.load(folder)) == want == key(source.option("index", str(tmp_path / "index")).load(folder))
    if triggers is not None:
        assert key(splits.read_indexed(index, triggers=True)) == sorted(m[1:] for m in marks)
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    reader = datasource._Reader({"path": folder, "index": str(tmp_path / "index")}, False)
    every = len(reader.partitions())
    assert len(list(reader.pushFilters([GreaterThanOrEqual(("t",), a), LessThan(("t",), z)]))) == 2 and 0 < len(reader.partitions()) < every / 2


@pytest.mark.parametrize("fmt", ["evt2", "evt21", "evt3", "evt4", "dat"])
def test_open_files(tmp_path, monkeypatch, fmt):
    """An open file is decoded and indexed in pieces; no read is larger than a piece and some way to the next clock word."""
    import pyarrow as pa

    from photonlake.sources import recordings, splits

    columns = events(20_000, side=300, span=2**26)
    data = codecs.encode(fmt, *columns)
    (tmp_path / "a").write_bytes(data)
    monkeypatch.setattr(codecs, "LOOK", 256)

    class Counted:
        def __init__(self, file):
            self.file, self.size, self.most = file, file.size, 0

        def read_at(self, n, at):
            got = self.file.read_at(n, at)
            self.most = max(self.most, len(got) if at else 0)
            return got

    with pa.OSFile(str(tmp_path / "a")) as file:
        source = Counted(file)
        got = [np.concatenate(c) for c in zip(*(p[:4] for p in codecs.pieces(fmt, source, 4096)))]
        assert source.most < len(data) / 3
        assert all((a == b).all() for a, b in zip(got, columns))
        assert list(splits.entries("a", source, fmt, 4096)) == list(splits.entries("a", data, fmt, 4096))
        whole = [np.concatenate(c) for c in zip(*(p[:4] for p in recordings.parts("a." + fmt, file, None)))]
        assert all((a == b).all() for a, b in zip(whole, columns))
    long = b"% note " + b"x" * 200_000 + b"\n" + data
    assert sum(len(p[0]) for p in codecs.pieces(fmt, long)) == len(columns[0])


def test_windows_of_readers(spark):
    from photonlake import schema
    from photonlake.operators import access, windows

    t = [0, 1, 2, 3, 50, 51, 52, 53, 54, 300]
    df = spark.createDataFrame([("a", i, v, 0, 0, 1) for i, v in enumerate(t)], schema.EVENTS)
    ids = lambda d: [r.window_id for r in d.orderBy("seq").collect()]
    assert ids(windows.mixed(df, 100, 3)) == mixed_cuts(t, 100, 3) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 4]
    assert ids(windows.capped(df, 100, 3, keep_grid=True)) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 5]
    assert ids(windows.overridden(df, "n_events", n_events=4)) == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert ids(windows.overridden(df, "delta_t", delta_t=100)) == [0] * 9 + [3] and set(ids(windows.overridden(df, "all"))) == {0}
    assert [r.seq for r in access.seek(df.withColumn("t", df.t + 1000), t=52, relative=True).orderBy("seq").collect()] == [6, 7, 8, 9]
    marks = spark.createDataFrame([("a", 0, 2, 1, 0), ("a", 1, 52, 0, 0), ("a", 2, 999, 1, 0)], schema.TRIGGERS)
    assert sorted((r.seq, r.window_id) for r in windows.triggers_by_start(windows.mixed(df, 100, 3), marks).collect()) == [(0, 0), (1, 2), (2, 4)]


def test_jitter_leaves_the_sensor(spark):
    from photonlake import schema
    from photonlake.functions import transforms

    df = spark.createDataFrame([("a", i, i, 0, 5, 1) for i in range(2000)], schema.EVENTS)
    kept = transforms.spatial_jitter(df, 64, 48, 1.0, 0.0, 0.0, True, 5).count()
    assert 850 < kept < 1150
    assert transforms.spatial_jitter(df, 64, 48, 1.0, 0.0, 0.0, False, 5).count() == 2000
    assert transforms.time_jitter(df, (10.0, 20.0), False, 5, sort=True).select("t").collect() == sorted(transforms.time_jitter(df, (10.0, 20.0), False, 5).select("t").collect())


def test_bookmarks(spark, tmp_path):
    from photonlake.sources.recordings import read_both
    from photonlake.sources.splits import bookmark_at, bookmarks, build_index, read_bookmarks

    t, x, y, p = events(2000)
    data = codecs.encode("evt2", t, x, y, p, triggers=([50, 900], [1, 0], [3, 3]))
    (tmp_path / "a.raw").write_bytes(data)
    (tmp_path / "b.raw").write_bytes(data)
    kind = np.dtype([("ts", "<i8"), ("first", "<u8"), ("n", "<u4")])
    marks = np.array([(-1, 0, 0), (100, 200, 40), (600, 900, 60), (1500, 2000, 7), (123, 456, 789)], kind).tobytes()
    head = lambda size: f"% ts_shift_us 1000\n% size {size}\n% end\n".encode()
    (tmp_path / "a.raw.tmp_index").write_bytes(head(len(data)) + marks)
    (tmp_path / "b.raw.tmp_index").write_bytes(head(len(data) + 1) + marks)  # of another state of the file
    assert [c.tolist() for c in bookmarks(head(5) + marks, 5)] == [[1100, 1600, 2500], [200, 900, 2000], [0, 40, 100]]
    assert not len(bookmarks(b"", 5)[0]) and not len(bookmarks(head(5), 5)[0])
    got = read_bookmarks(spark, str(tmp_path))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(1100, 200, 0), (1600, 900, 40), (2500, 2000, 100)]
    assert all(r.recording_id.endswith("/a.raw") for r in got.collect())
    for at, want in ((0, 1100), (1100, 1100), (2000, 1600), (10**9, 2500)):
        assert [r.ts for r in bookmark_at(got, at).collect()] == [want]
    both = read_both(spark, str(tmp_path), "evt2")  # bookmark files are no recordings
    assert both.events.count() == 2 * len(t) and sorted(r.t for r in both.triggers.collect()) == [50, 50, 900, 900]
    assert build_index(spark, str(tmp_path), "evt2").select("recording_id").distinct().count() == 2
