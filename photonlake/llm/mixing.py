"""Mixing sources to target weights by Sainte-Laguë apportionment; DataFrame operations only.

A source's documents are dealt to shards and lined up in each in the order of a seeded hash, which makes their words one
line of equal blocks. The mix has as many blocks as all words fill. Quotients ``target / (2 k - 1)`` give each block
to a source, and by the same rule each block of a source to a shard; a shard gives its blocks in line order, and again at its end when a source is taken more than once. Shards stand in bands, which get their source's blocks first, so that no task ranks
all shards of a source. Rows without words need no place in a line, and equal rows have one place between them until they are given out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small, staged

BLOCK = 16
#: Words in a shard of a source, on average.
SHARD = 1 << 20
#: Shards in a band.
BAND = 4096
#: Copies of a row that are written out at once.
COPIES = 1 << 16
MOST = 3.0
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(units: DataFrame, group: list[str], order: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """units with the seats (column ``seats``, one number a group) that each gets in its group; ties to the first in ``order``.

    Only quotients that can be near the last seat are ranked: with n units a unit of share s lies within s n / 2 + 1
    seats of its rounded quota, so these are 2 n and a few in all, however many seats there are. Units without weight get none.
    """
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    work = units.withColumn("_w", F.sum(weight).over(every)).withColumn("_n", F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(every))
    share = F.when(F.col("_w") > 0, F.col(weight) / F.when(F.col("_w") > 0, F.col("_w"))).otherwise(0.0)
    work = work.withColumn("_base", F.floor(share * F.col(seats) + 0.5)).withColumn("_m", F.ceil(share * F.col("_n") / 2) + 1)
    work = work.withColumn("_lo", F.when(F.col(weight) > 0, F.greatest(F.lit(0), F.col("_base") - F.col("_m"))).otherwise(0).cast("long"))
    work = work.withColumn("_rest", F.col(seats) - F.sum("_lo").over(every))
    k = F.when(F.col(weight) > 0, F.sequence(F.col("_lo") + 1, (F.col("_base") + F.col("_m")).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    tries = work.withColumn("_k", F.explode(k)).withColumn("_q", F.when(F.col("_k") > 0, F.col(weight) / (2 * F.col("_k") - 1)).otherwise(0.0))
    rank = F.row_number().over(every.orderBy(F.desc("_q"), *order))
    tries = tries.withColumn("_won", F.when((F.col("_k") > 0) & (rank <= F.col("_rest")), 1).otherwise(0))
    return tries.groupBy(*units.columns).agg((F.first("_lo") + F.sum("_won")).alias(out))


def targets(sources: DataFrame, weights: Sequence[float], most: float = MOST) -> DataFrame:
    """Columns source, source_size in; rank, weight and target added. Sources stand in code point order, null last, and take the weights in turn.

    A target is the weight's share of all sizes but at most ``most`` source sizes, the excess going to the others by weight:
    sources are filled in the order of the level at which each is full. One row a source, so one task.
    """
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    work = sources.withColumn("_rank", F.row_number().over(by_name)).withColumn("_weight", w).withColumn("_cap", most * F.col("source_size"))
    full = one.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(one) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    work = work.withColumn("_level", level)
    final = F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), F.struct(F.col("_cap") / F.col("_weight"), "_rank", F.col("_level").alias("level")))).over(one)["level"]
    return work.withColumn("target", F.coalesce(F.least(F.col("_cap"), final * F.col("_weight")), F.col("_cap")).cast("double")).drop("_level", "_cap", "_weight")


def mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), block: int = BLOCK, shard: int = SHARD, most: float = MOST, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs (doc_id, text, source).

    A size is the number of words; null and empty texts have 0 and give none. taken is the number of words that the mix takes
    of a row, repeats counted, at most ``most`` times its size. Null is a source of its own, last. Repeated rows are rows of their own.
    The same rows, weights and seed give the same result. An empty table gives an empty one; more columns are ignored.
    """
    place = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text"))), 1, 16)
    sized = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place.alias("_h")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = staged(targets(sums, weights, most))
    blocks = per.withColumn("_blocks", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    per = sainte_lague(blocks, [], ["_rank"], "target", "_blocks", "_seats")
    per = staged(per.select(F.col("source").alias("_s"), "source_size", "target", "_seats", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long").alias("_shards")))
    few = small(per, per.count())
    alike = sized.where("size > 0").groupBy("source", "doc_id", "size", "_h").agg(F.count("*").alias("_copies"))
    number = F.conv(F.substring("_h", 9, 8), 16, 10).cast("long") % F.col("_shards")
    rows = staged(alike.join(few.select("_s", "_shards"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("_shard", number).drop("_s", "_shards"))
    shards = rows.groupBy("source", "_shard").agg(F.sum(F.col("size") * F.col("_copies")).alias("_words")).withColumn("_band", F.expr(f"_shard div {BAND}"))
    bands = shards.groupBy("source", "_band").agg(F.sum("_words").alias("_band_words")).join(few.select("_s", "_seats"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    bands = sainte_lague(bands, ["source"], ["_band"], "_band_words", "_seats", "_band_seats").select(F.col("source").alias("_s"), F.col("_band").alias("_b"), "_band_seats")
    shards = shards.join(bands, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_band") == F.col("_b"))).drop("_s", "_b")
    quotas = sainte_lague(shards, ["source", "_band"], ["_shard"], "_words", "_band_seats", "_quota")
    quotas = staged(quotas.select(F.col("source").alias("_q"), F.col("_shard").alias("_qs"), "_words", F.least(F.col("_quota") * block, F.floor(F.col("_words") * most)).cast("long").alias("_take")))
    rows = rows.join(small(quotas, quotas.count()), F.col("source").eqNullSafe(F.col("_q")) & (F.col("_shard") == F.col("_qs")))
    line = Window.partitionBy("source", "_shard").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.col("size") * F.col("_copies")).over(line), F.lit(0)))
    rounds, over = F.expr("_take div _words"), F.expr("_take % _words")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {COPIES}")))
    rows = rows.withColumn("_from", copies).withColumn("_i", F.explode(F.expr(f"sequence(_from * {COPIES}, least(_copies, (_from + 1) * {COPIES}) - 1)")))
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), over - F.col("_at") - F.col("_i") * F.col("size")))
    rows = rows.select("doc_id", "source", "size", taken.cast("long").alias("taken"))
    rows = rows.unionByName(sized.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
    return rows.join(few.select("_s", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def op1_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows, one seat after the other: all quotients of a source, then of a shard, are ranked.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, left(md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), text)), 16) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
f AS (SELECT *, CAST([1, 2, 3][(r - 1) % 3 + 1] AS DOUBLE) AS w, {MOST} * source_size AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, source_size, r, least(cap, coalesce((SELECT arg_min(level, cap / w + 0.0) FROM v x WHERE x.cap > x.level * x.w) * w, cap)) AS target FROM v),
q AS (SELECT source, target / (2 * k - 1) AS q, r FROM t, range(1, (SELECT CAST(sum(source_size) // {BLOCK} + 2 AS BIGINT) FROM s)) x(k) WHERE target > 0),
won AS (SELECT source, count(*) AS seats FROM (SELECT source FROM q ORDER BY q DESC, r LIMIT (SELECT CAST(round(sum(target) / {BLOCK}) AS BIGINT) FROM t)) GROUP BY source),
p AS (SELECT t.*, coalesce(seats, 0) AS seats, greatest(1, CAST(ceil(source_size / {SHARD}.0) AS BIGINT)) AS shards FROM t LEFT JOIN won ON won.source IS NOT DISTINCT FROM t.source),
g AS (SELECT d.*, source_size, target, seats, CAST('0x' || substr(h, 9, 8) AS BIGINT) % shards AS shard FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source),
m AS (SELECT source, shard, seats, CAST(sum(size) AS BIGINT) AS words FROM g GROUP BY ALL HAVING sum(size) > 0),
n AS (SELECT source, shard, words, count(z) AS quota FROM (SELECT m.source, m.shard, words, CASE WHEN row_number() OVER (PARTITION BY m.source ORDER BY words / (2 * k - 1) DESC, shard) <= seats THEN 1 END AS z FROM m, range(1, (SELECT CAST(max(seats) + 2 AS BIGINT) FROM m)) x(k)) GROUP BY ALL),
a AS (SELECT g.*, words, least(quota * {BLOCK}, CAST(floor(words * {MOST}) AS BIGINT)) AS take, sum(size) OVER (PARTITION BY g.source, g.shard ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before_ FROM g LEFT JOIN n ON n.source IS NOT DISTINCT FROM g.source AND n.shard = g.shard)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE take // words * size + greatest(0, least(size, take % words - before_)) END AS BIGINT) AS taken FROM a"""
