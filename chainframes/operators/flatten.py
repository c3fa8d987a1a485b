"""From nested blocks to flat logs, and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flatten_logs(nested: DataFrame) -> DataFrame:
    """``block_number, transactions array<struct<tx_hash>>, receipts
    array<struct<.., logs array<struct<..>>>>`` -> one row per log.

    ``tx_index`` and ``log_index`` are list positions; the latter starts anew in
    every receipt.  Blocks with as many receipts as transactions only."""
    receipts = nested.where(F.size("transactions") == F.size("receipts")).select(
        "block_number", "transactions", F.posexplode("receipts").alias("tx_index", "receipt")
    )
    return receipts.select(
        "block_number",
        F.get("transactions", F.col("tx_index"))["tx_hash"].alias("tx_hash"),
        "tx_index",
        F.posexplode("receipt.logs").alias("log_index", "log"),
    ).select("block_number", "tx_hash", "tx_index", "log_index", "log.*")


def drop_mismatched(rows: DataFrame, txs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Rows of blocks whose numbers of receipts and transactions agree."""
    n_txs = txs.groupBy("block_number").agg(F.count("*").alias("n"))
    n_receipts = receipts.groupBy("block_number").agg(F.count("*").alias("n"))
    return rows.join(n_txs.join(n_receipts, ["block_number", "n"]).select("block_number"), "block_number", "left_semi")


def drop_anonymous(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("topic0").isNotNull())


def with_positions(txs: DataFrame, order_by: str) -> DataFrame:
    """0-based ``tx_index`` inside each block; windows are per block."""
    return txs.withColumn("tx_index", (F.row_number().over(Window.partitionBy("block_number").orderBy(order_by)) - 1).cast("int"))


def with_gas_used(txs: DataFrame) -> DataFrame:
    """Gas of each transaction from the block's running total, never below 0."""
    before = F.lag("cumulative_gas_used", 1, 0).over(Window.partitionBy("block_number").orderBy("tx_index"))
    return txs.withColumn("gas_used", F.greatest(F.lit(0), F.col("cumulative_gas_used") - before).cast("bigint"))


def with_row_id(rows: DataFrame) -> DataFrame:
    """A unique increasing ``id`` from the row's position in the chain, so that
    no global numbering is needed: block, 16 bits of tx, 16 bits of log."""
    log = F.col("log_index") if "log_index" in rows.columns else F.lit(0)
    packed = F.col("block_number") * (1 << 32) + F.col("tx_index").cast("bigint") * (1 << 16) + log.cast("bigint")
    return rows.withColumn("id", packed.cast("bigint"))


def first_per_key(rows: DataFrame, key: list[str], order_by: list[str]) -> DataFrame:
    """Of the rows of each key, the first by ``order_by``.  One aggregation with
    map-side minima, where a window would sort every key's rows."""
    rest = [c for c in rows.columns if c not in key and c not in order_by]
    least = F.min(F.struct(*order_by, *rest)).alias("__row")
    return rows.groupBy(*key).agg(least).select(*key, "__row.*").select(*rows.columns)
