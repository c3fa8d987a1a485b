"""Block and transaction attributes of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_gas_price() -> Column:
    """Paid price of gas: type 2 pays the base fee and a tip up to its maximum."""
    return F.when(F.col("tx_type") == 2, F.least(F.col("max_fee"), F.col("base_fee") + F.col("tip"))).otherwise(F.col("max_fee"))


def context(blocks: DataFrame, txs: DataFrame) -> DataFrame:
    """All context fields per ``(block_number, tx_index)``."""
    of_block = blocks.select("block_number", "block_timestamp", "block_hash", "base_fee")
    return txs.join(of_block, "block_number").select(
        "block_number",
        "tx_index",
        "block_timestamp",
        "block_hash",
        "tx_from",
        "tx_to",
        F.col("value").cast("string").alias("tx_value"),
        effective_gas_price().cast("bigint").alias("tx_gas_price"),
        F.col("gas_used").alias("tx_gas_used"),
        F.col("nonce").alias("tx_nonce"),
        "cumulative_gas_used",
        F.col("success").alias("tx_status"),
    )


def with_context(rows: DataFrame, attributes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds the chosen context fields.  Joined on block and position; tables laid
    out by block bucket are shuffled on the block alone."""
    return rows.join(attributes.select("block_number", "tx_index", *fields), ["block_number", "tx_index"])
