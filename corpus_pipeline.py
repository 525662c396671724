"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, source mix.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm import decontaminate, jaccard, mixing, quality, substring
from photonlake.llm.scratch import small, staged, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fit on the labels of this corpus, does not reject (score 0.3 or more).

    All columns stay. Null and empty texts are scored as empty ones, repeated rows alike; an empty table gives an empty one.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out(0)))
    out = unused(docs, "_p")
    kept = quality.score(docs, model, docs.columns, text="text", out=out)
    return kept.where(F.col(out) >= quality.THRESHOLD).drop(out)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest doc_id, then row hash; rows without doc_id come last.

    Rows are told apart by a 64-bit hash of doc_id and text. Of equal rows that stay one stays. Null, empty and blank texts are in
    no group, and all their rows stay. All columns stay; an empty table gives an empty one.
    """
    found = staged(jaccard.row_components(docs).where("component is not null").groupBy("component", F.col("doc_id").isNull().alias("none"), "doc_id", "row").agg(F.count("*").alias("n")))
    kept = found.groupBy("component").agg(F.min(F.struct("none", "doc_id", "row")).alias("least")).select(F.col("least.row").alias("kept")).distinct()
    key, equal = unused(docs, "_row"), unused(docs, "_equal")
    rows = found.groupBy(F.col("row").alias(key)).agg(F.sum("n").alias(equal)).join(kept, F.col(key) == F.col("kept"), "left")
    # a row that goes has -1, one that stays the number of rows that equal it; who stays alone needs no entry
    act = staged(rows.select(key, F.when(F.col("kept").isNull(), F.lit(-1)).otherwise(F.col(equal)).alias(equal)).where(F.col(equal) != 1))
    marked = docs.withColumn(key, jaccard.row_key()).join(small(act, act.count()), key, "left")
    once = marked.where(F.col(equal).isNull())
    again = marked.where(F.col(equal) > 1).dropDuplicates([key])
    return once.unionByName(again).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat another's; see substring_dedup for null, empty and repeated rows. All columns stay."""
    return substring.substring_dedup(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; see decontaminated for null, empty and repeated rows. All columns stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document left; see mix for null, empty and repeated rows."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
