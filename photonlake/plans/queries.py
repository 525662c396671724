"""Named queries over the events table and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import transforms as T
from ..operators import access as A
from ..operators import dense as D
from ..operators import filters as L
from ..operators import windows as W

W_, H_ = 64, 48
HOUR, DAY = 3_600_000_000, 86_400_000_000
TAU = 1_000_000_000
T0 = 1_704_067_200_000_000  # 2024-01-01

EV = """WITH ev AS (SELECT CAST(user_id % 4 AS VARCHAR) AS recording_id, event_id AS seq, epoch_us(ts) AS t, CAST(user_id % 64 AS INTEGER) AS x,
CAST((event_id // 7) % 48 AS INTEGER) AS y, CAST(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END AS SMALLINT) AS p FROM events),
tr AS (SELECT CAST(user_id % 4 AS VARCHAR) AS recording_id, event_id AS seq, epoch_us(ts) AS t, CAST(event_id % 2 AS SMALLINT) AS p, CAST(user_id % 8 AS SMALLINT) AS id FROM events WHERE event_type = 'error'),
a AS (SELECT recording_id, arg_min(t, seq) AS t0, arg_max(t, seq) AS t1, min(t) AS lo, max(t) AS hi FROM ev GROUP BY recording_id),
e AS (SELECT ev.*, t0, t1, lo, hi, row_number() OVER (PARTITION BY recording_id ORDER BY seq) - 1 AS n FROM ev JOIN a USING (recording_id)) """
COLS = "recording_id, seq, t, x, y, p"
ONOFF = "CAST(least(count(*) FILTER (p = 1), 255) AS INTEGER) AS on_cnt, CAST(least(count(*) FILTER (p <> 1), 255) AS INTEGER) AS off_cnt"
LCG = "((seq % 2147483648) * 1103515245 + 12345 + 7) % 2147483648 / 2147483648.0"


def _u(seed: int, key: str = "seq") -> str:
    return f"(((({key}) % 2147483648) * 1103515245 + 12345 + {seed}) % 2147483648 / 2147483648.0::DOUBLE)"


def _n(u: str, v: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u})) * cos({v} * 6.283185307179586::DOUBLE))"


#: Keys of the portable uniform numbers of one row.
KEYS = [f"seq * {k} + {k}" for k in (7919, 104729, 1299709, 15485863)]
U = [_u(5, k) for k in KEYS]
SQRT2 = 2.0**0.5
REST = (1.0 - (0.5 / SQRT2) ** 2) ** 0.5


def _value(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def _per_window(df: DataFrame) -> DataFrame:
    return df.groupBy("recording_id", "window_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("p").alias("on_cnt"))


PER = "SELECT recording_id, window_id, count(*) AS n, min(t) AS first_t, max(t) AS last_t, CAST(sum(p) AS BIGINT) AS on_cnt FROM w GROUP BY ALL"


def flagship(ev: DataFrame) -> DataFrame:
    """Hourly ON/OFF histogram of each pixel of each recording."""
    return D.histogram(W.tumbling(ev, HOUR), W_, H_, by=("window_id",))


def _empties(ev):
    grid = W.tumbling_grid(ev, HOUR)
    n = W.tumbling(ev, HOUR).groupBy("recording_id", "window_id").agg(F.count("*").alias("n"))
    return grid.join(n, ["recording_id", "window_id"], "left").fillna({"n": 0})


def _mask(ev):
    pixels = ev.sparkSession.range(W_ * H_).select((F.col("id") % W_).cast("int").alias("x"), F.expr(f"id div {W_}").cast("int").alias("y")).where("(x + y) % 2 = 0")
    return L.mask_events(ev, pixels, W_, H_)


def _small(ev, w, h):
    return ev.withColumn("x", F.col("x") % w).withColumn("y", F.col("y") % h)


def _composed(ev):
    chain = T.Compose([lambda d: T.flip_lr(d, W_), lambda d: L.refractory(d, DAY), lambda d: T.normalize_ts(d)])
    return chain(ev)


#: One row a mixed window: where it ends, how many events it has, its number.
MIXED = f""", s AS (SELECT recording_id, list(t ORDER BY seq) AS ts, list(p ORDER BY seq) AS ps, count(*) AS size FROM ev GROUP BY recording_id),
c AS (SELECT recording_id, CAST(0 AS BIGINT) AS i, ts[1] AS anchor, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS w FROM s
UNION ALL SELECT recording_id, i + k2, CASE WHEN bycount THEN ts[i + k2 + 1] ELSE anchor + {6 * HOUR} END, k2, w + 1 FROM (
SELECT c.recording_id, c.w, c.i, c.anchor, s.ts, s.size, least(len(list_filter(s.ts[c.i + 1:c.i + 21], lambda v: v < c.anchor + {6 * HOUR})), 20) AS k2, len(list_filter(s.ts[c.i + 1:c.i + 21], lambda v: v < c.anchor + {6 * HOUR})) > 20 AS bycount FROM c JOIN s USING (recording_id) WHERE c.i < s.size))
"""

# name: (query over events, SQL after the common part)
_EVENTS = {
    "hourly_histogram": (flagship, f"SELECT recording_id, (t - t0) // {HOUR} AS window_id, y, x, {ONOFF} FROM e GROUP BY ALL"),
    "tumbling_counts": (lambda ev: _per_window(W.tumbling(ev, HOUR)), f", w AS (SELECT *, (t - t0) // {HOUR} AS window_id FROM e) {PER}"),
    "tumbling_with_empties": (_empties, f", g AS (SELECT recording_id, t0, unnest(range(0, (hi - t0) // {HOUR} + 1)) AS window_id FROM a) SELECT g.recording_id, g.window_id, g.t0 + g.window_id * {HOUR} AS start, count(e.seq) AS n FROM g LEFT JOIN e ON e.recording_id = g.recording_id AND (e.t - e.t0) // {HOUR} = g.window_id GROUP BY ALL"),
    "sliding_counts": (lambda ev: _per_window(W.sliding(ev, HOUR, 5 * HOUR // 2)), f", w AS (SELECT e.*, unnest(range(greatest(0, CAST(ceil((t - t0 - {5 * HOUR // 2} + 1) / {HOUR}.0) AS BIGINT)), (t - t0) // {HOUR} + 1)) AS window_id FROM e) {PER}"),
    "sliding_full": (lambda ev: _per_window(W.sliding(ev, HOUR, 2 * HOUR, True)), f", w AS (SELECT * FROM (SELECT e.*, unnest(range(greatest(0, CAST(ceil((t - t0 - {2 * HOUR} + 1) / {HOUR}.0) AS BIGINT)), (t - t0) // {HOUR} + 1)) AS window_id FROM e) WHERE t0 + window_id * {HOUR} + {2 * HOUR} <= t1) {PER}"),
    "sliding_gaps": (lambda ev: _per_window(W.sliding(ev, 3 * HOUR, HOUR)), f", w AS (SELECT *, (t - t0) // {3 * HOUR} AS window_id FROM e WHERE (t - t0) % {3 * HOUR} < {HOUR}) {PER}"),
    "count_windows": (lambda ev: _per_window(W.by_count(ev, 70)), f", w AS (SELECT *, n // 70 AS window_id FROM e) {PER}"),
    "mixed_windows": (
        lambda ev: _per_window(W.mixed(ev, 6 * HOUR, 20)),
        MIXED + """SELECT c.recording_id, c.w AS window_id, c.k AS n, list_min(s.ts[c.i - c.k + 1:c.i]) AS first_t, list_max(s.ts[c.i - c.k + 1:c.i]) AS last_t, CAST(list_sum(s.ps[c.i - c.k + 1:c.i]) AS BIGINT) AS on_cnt FROM c JOIN s USING (recording_id) WHERE c.k > 0""",
    ),
    "prefix_dt": (lambda ev: L.prefix_dt(ev, DAY), f"SELECT {COLS} FROM e WHERE t < t0 + {DAY}"),
    "skip_to_time": (lambda ev: L.skip_to_time(ev, T0 + 9 * DAY), f"SELECT {COLS} FROM e WHERE seq >= (SELECT min(seq) FROM ev v WHERE v.recording_id = e.recording_id AND v.t >= {T0 + 9 * DAY})"),
    "skip_to_event": (lambda ev: A.seek_index(ev, 100), f"SELECT {COLS} FROM e WHERE n >= 100"),
    "seek_time": (lambda ev: A.seek(ev, t=T0 + 20 * DAY), f"SELECT {COLS} FROM e WHERE t >= {T0 + 20 * DAY}"),
    "seek_index": (lambda ev: A.seek(ev, n=150), f"SELECT {COLS} FROM e WHERE n >= 150"),
    "rows_slice": (lambda ev: A.rows_at(ev, -40, -3), f"SELECT {COLS} FROM (SELECT *, count(*) OVER (PARTITION BY recording_id) AS k FROM e) WHERE n >= k - 40 AND n < k - 3"),
    "ms_range": (lambda ev: A.ms_range(ev, (T0 + 5 * DAY) // 1000, (T0 + 8 * DAY) // 1000), f"SELECT {COLS} FROM e WHERE t >= {T0 + 5 * DAY} AND t < {T0 + 8 * DAY}"),
    "sort_ties": (lambda ev: W.sort_events(ev.withColumn("t", F.expr(f"t div {DAY}"))), f"SELECT recording_id, seq, t // {DAY} AS t, x, y, p FROM e ORDER BY recording_id, t, x, y, p"),
    "mask_semi": (_mask, f"SELECT {COLS} FROM e WHERE (x + y) % 2 = 0"),
    "refractory": (lambda ev: L.refractory(ev, DAY), f"SELECT {COLS} FROM e QUALIFY coalesce(t - lag(t) OVER (PARTITION BY recording_id, x, y ORDER BY seq) > {DAY}, true)"),
    "drop_bernoulli": (lambda ev: L.drop_random(ev, 0.3, T.lcg(7)), f"SELECT {COLS} FROM e WHERE {LCG} >= 0.3"),
    "drop_event": (lambda ev: L.drop_event(ev, 0.6, T.lcg(7)), f"SELECT {COLS} FROM e WHERE {LCG} >= 0.6"),
    "drop_by_time": (lambda ev: L.drop_by_time(ev, 0.25, 0.5), f", s AS (SELECT *, (hi - lo) * CAST(0.25 AS DOUBLE) AS d FROM e), z AS (SELECT *, ((hi - lo) - d) * CAST(0.5 AS DOUBLE) AS s FROM s) SELECT {COLS} FROM z WHERE t - lo < s OR t - lo > s + d"),
    "flip_lr": (lambda ev: T.flip_lr(ev, 50), "SELECT recording_id, seq, t, CAST((49 - x) & 65535 AS INTEGER) AS x, y, p FROM e"),
    "time_skew": (lambda ev: T.time_skew(ev, -1.7, 0.5), "SELECT recording_id, seq, CAST(trunc(t * CAST(-1.7 AS DOUBLE) + 0.5) AS BIGINT) AS t, x, y, p FROM e"),
    "normalize_ts": (lambda ev: T.normalize_ts(ev, 50), "SELECT recording_id, seq, t - lo + 50 AS t, x, y, p FROM e"),
    "normalize_first": (T.normalize_first, "SELECT recording_id, seq, t - t0 AS t, x, y, p FROM e"),
    "composed": (_composed, f"SELECT recording_id, seq, t - min(t) OVER (PARTITION BY recording_id) AS t, CAST(63 - x AS INTEGER) AS x, y, p FROM (SELECT * FROM e QUALIFY coalesce(t - lag(t) OVER (PARTITION BY recording_id, x, y ORDER BY seq) > {DAY}, true))"),
    "histogram": (lambda ev: D.histogram(ev, W_, H_), f"SELECT recording_id, y, x, {ONOFF} FROM e GROUP BY ALL"),
    "histogram_saturated": (lambda ev: D.histogram(_small(ev, 2, 2), 2, 2), f"SELECT recording_id, y % 2 AS y, x % 2 AS x, {ONOFF} FROM e GROUP BY ALL"),
    "histogram_fill": (lambda ev: D.histogram(ev, W_, H_, fill=True), "SELECT recording_id, y, x, CAST(CASE WHEN count(*) FILTER (p = 1) > 0 THEN 255 ELSE 0 END AS INTEGER) AS on_cnt, CAST(CASE WHEN count(*) FILTER (p <> 1) > 0 THEN 255 ELSE 0 END AS INTEGER) AS off_cnt FROM e GROUP BY recording_id, y, x"),
    "histogram_dense": (lambda ev: D.densify(D.histogram(ev, W_, H_), W_, H_, {"on_cnt": 0, "off_cnt": 0}), f", h AS (SELECT recording_id, y, x, {ONOFF} FROM e GROUP BY ALL), g AS (SELECT recording_id, CAST(i // 64 AS INTEGER) AS y, CAST(i % 64 AS INTEGER) AS x FROM a, range(3072) r(i)) SELECT g.*, coalesce(on_cnt, 0) AS on_cnt, coalesce(off_cnt, 0) AS off_cnt FROM g LEFT JOIN h USING (recording_id, y, x)"),
    "wedge": (lambda ev: D.wedge_histogram(ev, W_, H_, 30.0 * DAY), f"SELECT recording_id, y, x, CAST(CASE WHEN count(*) FILTER (p = 1) > 0 THEN 255 ELSE 0 END AS INTEGER) AS on_cnt, CAST(CASE WHEN count(*) FILTER (p <> 1) > 0 THEN 255 ELSE 0 END AS INTEGER) AS off_cnt FROM e WHERE (CAST(48 AS DOUBLE) - y) / CAST(48 AS DOUBLE) > (t - t0) / CAST({30 * DAY} AS DOUBLE) - CAST(0.1 AS DOUBLE) GROUP BY recording_id, y, x"),
    "voxel": (lambda ev: D.voxel(ev, 10, 40 * DAY, W_, H_), f"SELECT recording_id, (t - t0) // {4 * DAY} AS bin, y, x, {ONOFF} FROM e WHERE (t - t0) // {4 * DAY} < 10 GROUP BY ALL"),
    "timesurface": (lambda ev: _value(D.timesurface(ev, TAU * 100, W_, H_)), f", z AS (SELECT recording_id, y, x, t1, arg_max(t, seq) AS t, arg_max(p, seq) AS p FROM e GROUP BY recording_id, y, x, t1) SELECT recording_id, y, x, round((CASE WHEN p = 0 THEN -1 ELSE 1 END) * exp(-greatest(0, t1 - t) / CAST({TAU * 100} AS DOUBLE)), 6) + 0.0 AS value FROM z"),
    "tore": (lambda ev: _value(D.tore(ev, 3, TAU * 100, W_, H_)), f"SELECT recording_id, y, x, p, CAST(3 - rk AS INTEGER) AS slot, round(exp(-(t1 - t) / CAST({TAU * 100} AS DOUBLE)), 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, y, x, p ORDER BY seq DESC) AS rk FROM e) WHERE rk <= 3"),
    "pixel_topk": (lambda ev: D.tore(ev, 1, TAU, W_, H_).select("recording_id", "y", "x", "p", "slot"), "SELECT DISTINCT recording_id, y, x, p, CAST(0 AS INTEGER) AS slot FROM e"),
    "frame_gray": (lambda ev: D.frame_gray(ev, W_, H_), "SELECT recording_id, y, x, CAST(CASE WHEN arg_max(p, seq) = 1 THEN 255 ELSE 0 END AS INTEGER) AS value FROM e GROUP BY recording_id, y, x"),
    "frame_rgb": (lambda ev: D.frame_rgb(ev, W_, H_), "SELECT recording_id, y, x, CAST(CASE WHEN arg_max(p, seq) = 1 THEN 255 ELSE 0 END AS INTEGER) AS r, CAST(0 AS INTEGER) AS g, CAST(CASE WHEN arg_max(p, seq) = 1 THEN 0 ELSE 255 END AS INTEGER) AS b FROM e GROUP BY recording_id, y, x"),
    "frame_diff": (lambda ev: D.frame_diff(ev, W_, H_), "SELECT recording_id, y, x, CAST((((sum(CASE WHEN p = 1 THEN 1 ELSE -1 END) + 128) % 256) + 256) % 256 - 128 AS INTEGER) AS value FROM e GROUP BY recording_id, y, x"),
    "frame_diff_wrap": (lambda ev: D.frame_diff(_small(ev, 2, 2), 2, 2), "SELECT recording_id, y % 2 AS y, x % 2 AS x, CAST((((sum(CASE WHEN p = 1 THEN 1 ELSE -1 END) + 128) % 256) + 256) % 256 - 128 AS INTEGER) AS value FROM e GROUP BY ALL"),
    "check_sorted": (A.is_sorted, "SELECT recording_id, bool_and(ok) AS is_sorted FROM (SELECT recording_id, coalesce(t >= lag(t) OVER (PARTITION BY recording_id ORDER BY seq), true) AS ok FROM e) GROUP BY recording_id"),
    "check_valid": (lambda ev: A.validity(ev, 60, H_), "SELECT recording_id, bool_and(p IN (0, 1)) AS valid_p, bool_and(x >= 0 AND x < 60) AS valid_x, bool_and(y >= 0 AND y < 48) AS valid_y FROM e GROUP BY recording_id"),
    "metadata_summary": (A.summary, "SELECT recording_id, count(*) AS n, count(*) FILTER (p = 1) AS pos, count(*) FILTER (p <> 1) AS neg, arg_min(t, seq) AS first_t, arg_max(t, seq) AS last_t, min(t) AS min_t, max(t) AS max_t, max(x) AS max_x, max(y) AS max_y, max(t) - min(t) AS duration_us FROM e GROUP BY recording_id"),
    "center_of_mass": (lambda ev: A.center_of_mass(ev).withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6)), "SELECT recording_id, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM e GROUP BY recording_id"),
    "concat_recordings": (lambda ev: ev.where("recording_id in ('0', '1')").unionByName(ev.where("recording_id not in ('0', '1')")), f"SELECT {COLS} FROM e"),
    "capped_windows": (lambda ev: _per_window(W.capped(ev, DAY, 10, keep_grid=True)).drop("window_id"), f", r AS (SELECT *, (t - t0) // {DAY} AS d, (row_number() OVER (PARTITION BY recording_id, (t - t0) // {DAY} ORDER BY seq) - 1) // 10 AS piece FROM e) SELECT recording_id, count(*) AS n, min(t) AS first_t, max(t) AS last_t, CAST(sum(p) AS BIGINT) AS on_cnt FROM r GROUP BY recording_id, d, piece"),
    "reader_time_mode": (lambda ev: _per_window(W.overridden(ev, delta_t=HOUR)), f", w AS (SELECT *, (t - t0) // {HOUR} AS window_id FROM e) {PER}"),
    "reader_count_mode": (lambda ev: _per_window(W.overridden(ev, "n_events", n_events=70, max_time=10**15)), f", w AS (SELECT *, n // 70 AS window_id FROM e) {PER}"),
    "seek_relative": (lambda ev: A.seek(ev, t=3 * DAY, relative=True), f"SELECT {COLS} FROM e WHERE t >= t0 + {3 * DAY}"),
    "check_all": (lambda ev: A.is_valid(ev, W_, H_), "SELECT recording_id, bool_and(ok AND p IN (0, 1) AND x >= 0 AND x < 64 AND y >= 0 AND y < 48) AS is_valid FROM (SELECT *, coalesce(t >= lag(t) OVER (PARTITION BY recording_id ORDER BY seq), true) AS ok FROM e) GROUP BY recording_id"),
    "random_flip": (lambda ev: T.random_flip_lr(ev, W_, 0.5, u=T.lcg(3, F.col("recording_id").cast("long") * 7919 + 7919)), f"SELECT recording_id, seq, t, CAST(CASE WHEN {_u(3, 'CAST(recording_id AS BIGINT) * 7919 + 7919')} <= 0.5 THEN 63 - x ELSE x END AS INTEGER) AS x, y, p FROM e"),
    "spatial_jitter": (lambda ev: T.spatial_jitter(ev, W_, H_, 2.0, 1.0, 0.5, True, u=tuple(T.lcg(5, F.expr(k)) for k in KEYS)), f", j AS (SELECT recording_id, seq, t, p, x + {SQRT2} * {_n(U[0], U[1])} AS fx, y + {0.5 / SQRT2} * {_n(U[0], U[1])} + {REST} * {_n(U[2], U[3])} AS fy FROM e) SELECT recording_id, seq, t, CAST(floor(fx) AS INTEGER) AS x, CAST(floor(fy) AS INTEGER) AS y, p FROM j WHERE fx >= 0 AND fx < 64 AND fy >= 0 AND fy < 48"),
    "time_jitter": (lambda ev: T.time_jitter(ev, 1000.0, True, u=tuple(T.lcg(5, F.expr(k)) for k in KEYS[:2])), f"SELECT recording_id, seq, CAST(trunc(t + 1000.0::DOUBLE * {_n(U[0], U[1])}) AS BIGINT) AS t, x, y, p FROM e"),
    "event_jitter": (lambda ev: T.event_jitter(ev, 500, u=T.lcg(5, F.expr(KEYS[0])), sort=True), f"SELECT recording_id, seq, t + CAST(floor({U[0]} * 1001) AS BIGINT) - 500 AS t, x, y, p FROM e"),
    "event_jitter_n": (lambda ev: T.event_jitter_n(ev, 10.0, 100.0, u=tuple(T.lcg(5, F.expr(k)) for k in KEYS[:2])), f"SELECT recording_id, seq, t + CAST(round_even({_n(U[0], U[1])} * 100.0::DOUBLE + 10.0::DOUBLE, 0) AS BIGINT) AS t, x, y, p FROM e"),
    "random_events": (lambda ev: T.random_events(ev.sparkSession, 1000, W_, H_, 0, 10_000, slices=3, u=lambda i: T.lcg(5, F.expr(KEYS[i]))), f", g AS (SELECT CAST(floor((least(seq // 333, 2) + {U[0]}) * (10000::DOUBLE / 3)) AS BIGINT) AS t, CAST(floor({U[1]} * 64) AS INTEGER) AS x, CAST(floor({U[2]} * 48) AS INTEGER) AS y, CAST(floor({U[3]} * 2) AS SMALLINT) AS p FROM range(1000) r(seq)) SELECT 'random' AS recording_id, row_number() OVER (ORDER BY t, x, y, p) - 1 AS seq, t, x, y, p FROM g"),
    "plot_points": (lambda ev: A.plot_points(ev, 200).withColumn("z", F.round("z", 6)), ", k AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS c FROM e) SELECT recording_id, seq, x, y, p, round(CASE WHEN hi > lo THEN (t - lo) / CAST(hi - lo AS DOUBLE) * 3000 ELSE 0.0 END, 6) AS z FROM k WHERE n % greatest(1, CAST(ceil(c / 200.0) AS BIGINT)) = 0"),
}
# name: (query over events and triggers, SQL after the common part)
_BOTH = {
    "triggers_by_window": (lambda ev, tr: W.triggers_by_time(ev, tr, DAY), f"SELECT tr.recording_id, seq, t, p, id, least(greatest(0, (t - t0) // {DAY}), (hi - t0) // {DAY}) AS window_id FROM tr JOIN a USING (recording_id)"),
    "triggers_by_count": (lambda ev, tr: W.triggers_by_count(ev, tr, 70), ", f AS (SELECT recording_id, n // 70 AS w, min(t) AS t FROM e WHERE n >= 70 GROUP BY ALL) SELECT tr.recording_id, tr.seq, tr.t, tr.p, tr.id, coalesce(max(f.w), 0) AS window_id FROM tr LEFT JOIN f ON f.recording_id = tr.recording_id AND f.t <= tr.t GROUP BY ALL"),
    "triggers_by_mixed": (lambda ev, tr: W.triggers_by_start(W.mixed(ev, 6 * HOUR, 20), tr), MIXED + ", f AS (SELECT c.recording_id, c.w, list_min(s.ts[c.i - c.k + 1:c.i]) AS t FROM c JOIN s USING (recording_id) WHERE c.k > 0 AND c.w > 0) SELECT tr.recording_id, tr.seq, tr.t, tr.p, tr.id, coalesce(max(f.w), 0) AS window_id FROM tr LEFT JOIN f ON f.recording_id = tr.recording_id AND f.t <= tr.t GROUP BY ALL"),
}


def _recursive(sql: str) -> str:
    return sql.replace("WITH ev", "WITH RECURSIVE ev", 1)


QUERIES = {k: (lambda spark, d, f=f: f(schema.load(spark, d))) for k, (f, _) in _EVENTS.items()} | {k: (lambda spark, d, f=f: f(schema.load(spark, d), schema.load_triggers(spark, d))) for k, (f, _) in _BOTH.items()}
ORACLE = {k: (_recursive(EV + sql) if sql.startswith(MIXED) else EV + sql) for k, (_, sql) in (_EVENTS | _BOTH).items() if sql}
