"""Block-range scans and resumption."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframes.operators.tables import left_of

#: Blocks per partition directory of the chain tables and output tables.
BUCKET_BLOCKS = 100_000


def working_dir(spark: SparkSession) -> str:
    """A fresh folder under the one that the cluster shares
    (``spark.checkpoint.dir``).  Only a session on one machine may have none; it
    gets a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def bucket(block: Column) -> Column:
    return F.floor(block / BUCKET_BLOCKS).cast("bigint")


def block_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of blocks ``start``..``end``, both included.  Where the table is laid
    out by ``block_bucket``, the directories outside the range are not read."""
    rows = df.where(F.col("block_number").between(start, end))
    if "block_bucket" in df.columns:
        rows = rows.where(F.col("block_bucket").between(start // BUCKET_BLOCKS, end // BUCKET_BLOCKS))
    return rows


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    return block_range(spark.read.parquet(path), start, end)


def resume_range(progress: DataFrame, start: int, end: int, rollbacks: DataFrame | None = None) -> DataFrame:
    """One row ``from_block, to_block``: what is left of a run after the largest
    block in ``progress(epoch, max_block)`` that no later rollback ``(epoch,
    ancestor)`` has undone.  No row if nothing is left; a checkpoint of 0 (or
    none) means nothing was done yet."""
    done = F.coalesce(F.max("max_block"), F.lit(0))
    return (
        left_of(progress, rollbacks)
        .agg(done.alias("done"))
        .select(F.when(F.col("done") >= start, F.col("done") + 1).otherwise(F.lit(start)).cast("bigint").alias("from_block"), F.lit(end).cast("bigint").alias("to_block"))
        .where("from_block <= to_block")
    )


def meta_block(progress: DataFrame, rollbacks: DataFrame | None = None) -> DataFrame:
    """The current checkpoint as text."""
    return left_of(progress, rollbacks).agg(F.max("max_block").cast("string").alias("block"))
