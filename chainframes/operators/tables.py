"""Append-only output tables that survive replays and reorganisations.

Progress rows ``(epoch, max_block)`` say what is done; a rollback is a row
``(epoch, ancestor)`` that hides older rows above the ancestor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainframes.operators.flatten import first_per_key
from chainframes.operators.match import small


def new_rows(new: DataFrame, existing: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The rows that an append with "on conflict do nothing" would add: first of
    each key in the batch, of keys the table does not hold."""
    return first_per_key(new, list(key), list(order_by)).join(existing.select(*key), list(key), "left_anti")


def visible(rows: DataFrame, rollbacks: DataFrame, epochs: DataFrame | None = None) -> DataFrame:
    """Rows not hidden by a later rollback below their block.

    What hides an epoch is the lowest ancestor of all later rollbacks.  It is
    found once per epoch (a window over epochs, never over rows) and joined by
    epoch.  ``epochs`` names the epochs there can be, else they are read off the
    rows."""
    known = (rows if epochs is None else epochs).select(F.col("epoch").cast("bigint").alias("epoch")).distinct()
    marks = known.select("epoch", F.lit(None).cast("bigint").alias("ancestor")).unionByName(rollbacks.select(F.col("epoch").cast("bigint").alias("epoch"), "ancestor"))
    later = Window.orderBy(F.desc("epoch")).rangeBetween(Window.unboundedPreceding, -1)
    limits = marks.select("epoch", F.min("ancestor").over(later).alias("__limit")).where("__limit is not null").distinct()
    shown = F.col("__limit").isNull() | (F.col("block_number") <= F.col("__limit"))
    return rows.join(limits, "epoch", "left").where(shown).select(*rows.columns)


def rolled_back(rows: DataFrame, ancestor: int) -> DataFrame:
    """What stays after a rollback to ``ancestor``."""
    return rows.where(F.col("block_number") <= ancestor)


def current_hashes(hashes: DataFrame) -> DataFrame:
    """Last written hash per block: ``(epoch, block_number, block_hash)``."""
    return hashes.groupBy("block_number").agg(F.max_by("block_hash", "epoch").alias("block_hash"))


def left_of(progress: DataFrame, rollbacks: DataFrame | None) -> DataFrame:
    """Progress rows with ``max_block`` lowered to what later rollbacks have left;
    one row per epoch, so that a window over them is small."""
    if rollbacks is None:
        return progress
    marks = progress.select("epoch", "max_block", F.lit(None).cast("bigint").alias("ancestor")).unionByName(
        rollbacks.select(F.col("epoch").cast("bigint").alias("epoch"), F.lit(None).cast("bigint").alias("max_block"), "ancestor")
    )
    later = Window.orderBy(F.desc("epoch")).rangeBetween(Window.unboundedPreceding, -1)
    limited = marks.withColumn("limit", F.min("ancestor").over(later)).where("max_block is not null")
    return limited.select("epoch", F.least("max_block", "limit").alias("max_block"))


def checkpoint(progress: DataFrame, rollbacks: DataFrame | None = None) -> DataFrame:
    """The largest block of any progress row; after a rollback, of what it left."""
    return left_of(progress, rollbacks).agg(F.max("max_block").alias("checkpoint"))


def fan_out(rows: DataFrame, routing: DataFrame, routes: int | None = None) -> DataFrame:
    """Every row once per output table of its (contract, event); ``routes`` is
    the number of rows of ``routing``, where it is known."""
    return rows.join(small(routing, routes), ["contract", "event"])


def create_table(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """An empty output table, partitioned by block bucket and epoch."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, epoch BIGINT, block_bucket BIGINT) USING parquet PARTITIONED BY (block_bucket, epoch)")


def recreate_table(spark: SparkSession, name: str, schema: T.StructType) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    create_table(spark, name, schema)
