"""Chain tables laid over an order book, for tests and benchmarks.

Orders are transactions, a day is a block, line items are logs.  The rules are
in FIXTURES.md, section 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframes.functions.keccak import bloom_positions

TRANSFER = "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
APPROVAL = "8c" * 32
CREATED = "fc" * 32
FACTORY = "f00d".rjust(40, "0")
CALL = "a9059cbb"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        """
        SELECT b AS block_number, 1700000000 + 12 * (b - 21000000) AS block_timestamp,
               sha2(CAST(b AS STRING), 256) AS block_hash, sha2(CAST(b - 1 AS STRING), 256) AS parent_hash,
               1000 + b % 100 AS base_fee
        FROM (SELECT DISTINCT CAST(21000000 + datediff(o_orderdate, DATE'1995-01-01') AS BIGINT) AS b FROM {orders})
        """,
        orders=table(spark, sf_dir, "orders"),
    )


def txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        """
        SELECT *, CAST(row_number() OVER (PARTITION BY block_number ORDER BY o_orderkey) - 1 AS INT) AS tx_index,
               CAST(sum(gas) OVER (PARTITION BY block_number ORDER BY o_orderkey) AS BIGINT) AS cumulative_gas_used,
               CAST(row_number() OVER (PARTITION BY tx_from ORDER BY block_number, o_orderkey) - 1 AS BIGINT) AS nonce
        FROM (SELECT CAST(21000000 + datediff(o_orderdate, DATE'1995-01-01') AS BIGINT) AS block_number, o_orderkey,
               lpad(lower(hex(o_orderkey)), 64, '0') AS tx_hash, lpad(lower(hex(o_custkey)), 40, '0') AS tx_from,
               CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
                    ELSE lpad(lower(hex(8192 + o_orderkey % 12)), 40, '0') END AS tx_to,
               CASE WHEN o_orderpriority = '5-LOW' THEN CAST(0 AS BIGINT)
                    ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS value,
               o_orderstatus <> 'F' AS success, 21000 + o_orderkey % 50000 AS gas,
               2 * (o_orderkey % 2) AS tx_type, 1050 + o_custkey % 100 AS max_fee, o_custkey % 7 AS tip,
               CASE o_orderkey % 3
                 WHEN 0 THEN concat('a9059cbb', lpad(lower(hex(o_custkey)), 64, '0'),
                             lpad(lower(hex(CAST(round(o_totalprice * 100) AS BIGINT))), 64, '0'))
                 WHEN 1 THEN concat('deadbeef', repeat('00', 32)) ELSE '' END AS input
              FROM {orders})
        """,
        orders=table(spark, sf_dir, "orders"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with their source columns (l_orderkey .. cents) for oracles."""
    li = table(spark, sf_dir, "lineitem")
    t = txs(spark, sf_dir).select("o_orderkey", "block_number", "tx_hash", "tx_index")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")

    def word(column, width=64):
        return F.lpad(F.lower(F.hex(column)), width, "0")

    child = word(F.lit(65536) + F.col("l_partkey"), 40)
    first = (flag == "N") & (line == 1)
    return li.join(t, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "block_number",
        "tx_hash",
        "tx_index",
        (line - 1).cast("int").alias("log_index"),
        F.when(first, FACTORY).when((flag == "A") & (F.col("l_suppkey") % 10 >= 8), child).otherwise(word(8192 + F.col("l_suppkey") % 10, 40)).alias("address"),
        F.when(flag == "A", TRANSFER)
        .when(flag == "R", APPROVAL)
        .when(line == 1, CREATED)
        .when(line == 7, None)
        .otherwise("00" * 32)
        .alias("topic0"),
        F.when(first, word(F.lit(65536) + F.col("l_partkey"))).otherwise(word(F.col("l_partkey"))).alias("topic1"),
        word(F.col("l_suppkey")).alias("topic2"),
        word(cents).alias("data"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_returnflag",
        cents.alias("cents"),
    )


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bits = [bloom_positions(a) for a in batch["address"]]
        yield pd.DataFrame({"address": batch["address"], "bits": [list(b) for b in bits]})


def with_bloom(of: DataFrame, of_logs: DataFrame) -> DataFrame:
    """Blocks with the 2048-bit bloom of the addresses of their logs, as a chain
    would deliver it."""
    pairs = of_logs.select("block_number", "address").distinct()
    hashed = pairs.select("address").distinct().mapInPandas(_positions, "address string, bits array<int>")
    bits = pairs.join(hashed, "address").select("block_number", F.explode("bits").alias("bit"))
    byte = (255 - F.floor(F.col("bit") / 8)).cast("int").alias("byte")
    masks = bits.groupBy("block_number", byte).agg(F.bit_or(F.pow(F.lit(2), F.col("bit") % 8).cast("int")).alias("mask"))
    rows = masks.groupBy("block_number").agg(F.map_from_entries(F.collect_list(F.struct("byte", "mask"))).alias("m"))
    bloom = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0))), 2, "0")), ""))
    return of.join(rows, "block_number", "left").withColumn("logs_bloom", bloom).drop("m")


def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their transactions and receipts as nested lists."""
    entry = F.struct("log_index", "l_partkey", "l_suppkey", "cents", "l_returnflag")
    per_tx = logs(spark, sf_dir).groupBy("tx_hash").agg(F.sort_array(F.collect_list(entry)).alias("logs"))
    t = txs(spark, sf_dir).select("block_number", "tx_index", "tx_hash", "success", "cumulative_gas_used").join(per_tx, "tx_hash", "left")
    body = F.transform(
        F.coalesce("logs", F.array().cast("array<struct<log_index:int,l_partkey:bigint,l_suppkey:bigint,cents:bigint,l_returnflag:string>>")),
        lambda x: F.struct(x["l_partkey"].alias("l_partkey"), x["l_suppkey"].alias("l_suppkey"), x["cents"].alias("cents")),
    )
    t = t.withColumn("receipt", F.struct("success", "cumulative_gas_used", body.alias("logs")))
    by_block = t.groupBy("block_number").agg(F.sort_array(F.collect_list(F.struct("tx_index", "tx_hash", "receipt"))).alias("all"))
    return by_block.select(
        "block_number",
        F.transform("all", lambda x: F.struct(x["tx_hash"].alias("tx_hash"))).alias("transactions"),
        F.transform("all", lambda x: x["receipt"]).alias("receipts"),
    )
