"""Chain tables laid out so that logs, transactions and blocks meet where they lie."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframes.sources.scan import BUCKET_BLOCKS, bucket

_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def write_chain_table(df: DataFrame, name: str, buckets: int) -> None:
    """Saves blocks, transactions or logs as a table of directories by block bucket
    and of ``buckets`` files by block in each.  Tables of one number of buckets are
    joined by block, or by block and position, without a shuffle; a range scan skips
    directories."""
    order = [c for c in ("block_number", "tx_index", "log_index") if c in df.columns]
    rows = df.withColumn("block_bucket", bucket(F.col("block_number"))).repartition(buckets, "block_number")
    writer = rows.write.mode("overwrite").format("parquet").partitionBy("block_bucket").bucketBy(buckets, "block_number")
    writer.sortBy(*order).saveAsTable(name)


def chain_range(spark: SparkSession, name: str, start: int, end: int) -> DataFrame:
    """Rows of blocks ``start`` to ``end`` of a table so written."""
    rows = spark.table(name).where(F.col("block_number").between(start, end))
    return rows.where(F.col("block_bucket").between(start // BUCKET_BLOCKS, end // BUCKET_BLOCKS)).drop("block_bucket")


@contextmanager
def meeting_by_block(spark: SparkSession) -> Iterator[None]:
    """Plans made inside may join on more columns than tables are laid out by."""
    before = spark.conf.get(_KEYS)
    spark.conf.set(_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_KEYS, before)
