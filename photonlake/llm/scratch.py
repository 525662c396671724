"""Shared intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most three numbers that may be broadcast once they are counted (64 MB or so); beyond it joins shuffle.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where unset, a temporary one on a local master and one in the warehouse elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = f"file://{tempfile.mkdtemp(prefix='photonlake-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(df) if rows <= most else df


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one, that is no column of df in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
