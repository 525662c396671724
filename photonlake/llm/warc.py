"""WARC record layout and Merkle fixity audit; DataFrame operations only.

Records stand one after the other in files; a leaf is a range of offsets of a file and hashes the digests of the records that begin in it,
in order. Each level above hashes FANOUT nodes of the one below, up to one root a file. Two replicas are compared from the
roots, and only below nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

FANOUT = 16
RANGE = 1 << 16
#: A band of page ids is dealt to FILES files of about RECORDS_A_FILE records.
RECORDS_A_FILE, FILES = 4096, 256
#: Equal records that one task places at once.
COPIES = 4096


def header(url: Column, date: Column, length: Column) -> Column:
    """Header block of a response record."""
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: "), date, F.lit("\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))


def layout(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """file, record, offset, length, digest of the record of every row of pages (page_id, url, html).

    Each RECORDS_A_FILE * FILES consecutive page ids are dealt to FILES files by their header blocks, that is by url and length, so rows that
    share a page_id are in many; those without page_id go to files -1 to -FILES in the same way, beside negative ids if there are any. A file is in order of page_id, null first, then digest.
    Null url and html count as empty. Digests are made before rows move. Repeated rows are records of their own; they are counted
    before they move, and placed one after the other.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = header(F.coalesce(F.col("url").cast("string"), F.lit("")), F.lit(date), F.octet_length(html))
    deal = F.conv(F.left(F.md5(head), F.lit(2)), 16, 10).cast("long") % FILES
    file = F.coalesce(F.floor(F.col("page_id") / float(RECORDS_A_FILE * FILES)).cast("long") * FILES + deal, -1 - deal)
    rows = pages.select(file.alias("file"), F.col("page_id").alias("record"), (F.octet_length(head) + F.octet_length(html) + 4).cast("long").alias("length"), F.sha2(F.concat(head, html), 256).alias("digest"))
    line = Window.partitionBy("file").orderBy("record", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.groupBy("file", "record", "length", "digest").agg(F.count("*").alias("n")).withColumn("at", F.coalesce(F.sum(F.col("length") * F.col("n")).over(line), F.lit(0)))
    few = placed.where(F.col("n") <= COPIES).withColumn("copy", F.explode(F.expr("sequence(0L, n - 1)")))
    blocks = placed.where(F.col("n") > COPIES).withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition("file", "record", "digest", "block")
    many = blocks.withColumn("copy", F.explode(F.expr(f"sequence(block * {COPIES}, least(n, (block + 1) * {COPIES}) - 1)"))).drop("block")
    return few.unionByName(many).select("file", "record", (F.col("at") + F.col("copy") * F.col("length")).cast("long").alias("offset"), "length", "digest")


def leaves(records: DataFrame, size: int = RANGE) -> DataFrame:
    """file, node, hash of each range of offsets that a record begins in."""
    listed = F.array_sort(F.collect_list(F.struct("offset", "record", "digest")))
    return records.groupBy("file", F.expr(f"offset div {size}").alias("node")).agg(F.sha2(F.concat_ws("", F.transform(listed, lambda x: x["digest"])), 256).alias("hash"))


def above(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return nodes.groupBy("file", F.expr(f"node div {fanout}").alias("node")).agg(F.sha2(F.concat_ws("", F.transform(listed, lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["hash"], F.lit(";")))), 256).alias("hash"))


def tree(records: DataFrame, depth: int, size: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the tree, leaves first, of which the last has a node a file."""
    levels = [leaves(records, size)]
    for _ in range(depth):
        levels.append(above(levels[-1], fanout))
    return [staged(x) for x in levels]


def depth_of(records: DataFrame, size: int = RANGE, fanout: int = FANOUT) -> int:
    nodes, depth = ((records.agg(F.max("offset").alias("m")).first().m or 0) // size) + 1, 0
    while nodes > 1:
        nodes, depth = -(-nodes // fanout), depth + 1
    return depth


def audit(original: DataFrame, replica: DataFrame, size: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """file, leaf, record, offset, status, digest, replica_digest of every record in which two replicas differ.

    Both have file, record, offset, length, digest; offsets are those of the original's index. status is altered, missing (from the replica) or
    extra (in it). Null files and records are compared like any other. Records that one replica repeats are compared in the order of
    their digests. Equal replicas, and empty ones, give an empty table. Each level joins only the children of nodes that differ.
    """
    original, replica = staged(original), staged(replica)
    depth = max(depth_of(original, size, fanout), depth_of(replica, size, fanout))
    ours, theirs = tree(original, depth, size, fanout), tree(replica, depth, size, fanout)
    bad = None
    for k in range(depth, -1, -1):
        a, b = ours[k], theirs[k].select(F.col("file").alias("_f"), F.col("node").alias("_n"), F.col("hash").alias("_h"))
        if bad is not None:
            own = lambda f, n: F.col(f).eqNullSafe(F.col("_bf")) & (F.expr(f"{n} div {fanout}") == F.col("_bn"))
            a, b = a.join(bad, own("file", "node"), "left_semi"), b.join(bad, own("_f", "_n"), "left_semi")
        both = a.join(b, F.col("file").eqNullSafe(F.col("_f")) & (F.col("node") == F.col("_n")), "full").where("not hash <=> _h")
        bad = staged(both.select(F.when(F.col("node").isNull(), F.col("_f")).otherwise(F.col("file")).alias("_bf"), F.coalesce("node", "_n").alias("_bn")))
    turn = Window.partitionBy("file", "leaf", "record", "offset").orderBy("digest")
    rows = lambda df: df.withColumn("leaf", F.expr(f"offset div {size}")).join(bad, F.col("file").eqNullSafe(F.col("_bf")) & (F.col("leaf") == F.col("_bn")), "left_semi").withColumn("turn", F.row_number().over(turn))
    a = rows(original)
    b = rows(replica).select(*[F.col(c).alias(f"_{c}") for c in ("file", "leaf", "record", "offset", "turn", "digest")])
    same = (F.col("leaf") == F.col("_leaf")) & (F.col("offset") == F.col("_offset")) & (F.col("turn") == F.col("_turn")) & F.col("file").eqNullSafe(F.col("_file")) & F.col("record").eqNullSafe(F.col("_record"))
    both = a.join(b, same, "full").where("not digest <=> _digest")
    pick = lambda c: F.when(F.col("leaf").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    status = F.when(F.col("_leaf").isNull(), "missing").when(F.col("leaf").isNull(), "extra").otherwise("altered")
    return both.select(pick("file"), pick("leaf"), pick("record"), pick("offset"), status.alias("status"), "digest", F.col("_digest").alias("replica_digest"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of layout(pages): where crc32(page_id) mod 97 is 0 a final ``>`` of the html has become ``#``, where it is 1 the record is lost."""
    crc = F.coalesce(F.crc32(F.col("page_id").cast("string")) % 97, F.lit(-1))
    html = F.when((crc == 0) & F.col("html").endswith(">"), F.concat(F.expr("left(html, length(html) - 1)"), F.lit("#"))).otherwise(F.col("html"))
    lost = F.coalesce(F.crc32(F.col("record").cast("string")) % 97, F.lit(-1)) == 1
    return layout(pages.withColumn("html", html)).where(~lost)


def op4_merkle_audit(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return audit(layout(pages), damaged(pages))


#: The same rows by comparing all records of both replicas; CRC-32 is spelt out bit by bit.
ORACLE_SQL = """
WITH c AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(page_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda crc, d: list_reduce(list_prepend(xor(crc, d), range(8)), lambda x, _: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 97, -1) AS crc FROM pages),
v AS (
  SELECT page_id, crc, 0 AS side, url, html FROM c
  UNION ALL SELECT page_id, crc, 1, url, CASE WHEN crc = 0 AND ends_with(html, '>') THEN left(html, length(html) - 1) || '#' ELSE html END FROM c),
h AS (
  SELECT *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) AS head FROM v),
r AS (SELECT side, crc, coalesce(CAST(floor(page_id / 1048576.0) AS BIGINT) * 256 + CAST('0x' || left(md5(head), 2) AS BIGINT), -1 - CAST('0x' || left(md5(head), 2) AS BIGINT)) AS file, page_id AS record, strlen(head) + strlen(html) + 4 AS length, sha256(head || html) AS digest FROM h),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY side, file ORDER BY record NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r),
a AS (SELECT * FROM o WHERE side = 0),
b AS (SELECT * FROM o WHERE side = 1 AND crc <> 1)
SELECT coalesce(a.file, b.file) AS file, coalesce(a."offset", b."offset") // 65536 AS leaf, coalesce(a.record, b.record) AS record, coalesce(a."offset", b."offset") AS "offset",
  CASE WHEN b.side IS NULL THEN 'missing' WHEN a.side IS NULL THEN 'extra' ELSE 'altered' END AS status, a.digest AS digest, b.digest AS replica_digest
FROM a FULL JOIN b ON a.record = b.record AND a.file = b.file AND a."offset" = b."offset" WHERE a.digest IS DISTINCT FROM b.digest"""
