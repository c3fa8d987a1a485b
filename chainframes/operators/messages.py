"""What is told to the outside: counts per block and one message per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO_ADDRESS = "0" * 40
#: Context fields that messages of flagged tables carry, and their names there
#: (fixed values).
RECEIPT_PAYLOAD = {
    "tx_value": "tx_value", "tx_gas_price": "tx_gas_price", "tx_gas_used": "gas_used", "tx_nonce": "nonce",
    "cumulative_gas_used": "cumulative_gas_used", "tx_status": "status",
}


def table_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block_number", "table", "event").agg(F.count("*").alias("n"))


def block_notifications(counts: DataFrame, blocks: DataFrame) -> DataFrame:
    """One JSON body per block with rows; blocks without rows say nothing."""
    entry = F.struct(F.col("table").alias("name"), "event", F.col("n").alias("count"))
    grouped = counts.groupBy("block_number").agg(F.sort_array(F.collect_list(entry)).alias("tables"))
    body = F.to_json(F.struct("block_number", "block_timestamp", "tables"))
    return grouped.join(blocks.select("block_number", "block_timestamp"), "block_number").select("block_number", body.alias("body"))


def run_totals(**frames: DataFrame) -> DataFrame:
    """One row with the number of rows of each given frame."""
    total = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        total = one if total is None else total.unionByName(one)
    return total


def json_value(column: Column, kind: str) -> Column:
    """How a value stands in a message: numbers as text, bools as they are,
    bytes as hex text, others as text."""
    if kind == "boolean":
        return column
    if kind == "binary":
        return F.concat(F.lit("0x"), F.lower(F.hex(column)))
    return column.cast("string")


def data_struct(df: DataFrame, names: Sequence[tuple[str, str]]) -> Column:
    """``(column, name in the message)`` pairs as one struct."""
    kinds = dict(df.dtypes)
    return F.struct(*[json_value(F.col(c), kinds[c]).alias(n) for c, n in names])


def payload(df: DataFrame, data: Column, *, log_index: bool, receipts_for: Sequence[str] = ()) -> DataFrame:
    """Adds ``body``: the message of each row as JSON.  ``contract`` is the name
    and ``contract_address`` the address; hashes and addresses have no prefix in
    the rows and have one in the message.  Absent fields are left out; receipt
    fields are sent for the named tables only."""
    with_prefix = lambda c: F.concat(F.lit("0x"), F.col(c))
    fields = [F.col("table"), F.col("event"), F.col("contract").alias("contract_name"), with_prefix("contract_address").alias("contract")]
    fields += [F.col("block_number"), F.col("block_timestamp"), with_prefix("tx_hash").alias("tx_hash")]
    if log_index:
        fields.append(F.col("log_index"))
    fields += [F.col("tx_index"), with_prefix("tx_from").alias("tx_from")]
    flagged = F.col("table").isin(list(receipts_for)) if receipts_for else F.lit(False)
    fields += [F.when(flagged, F.col(c)).alias(name) for c, name in RECEIPT_PAYLOAD.items() if c in df.columns]
    return df.withColumn("body", F.to_json(F.struct(*fields, data.alias("data"))))


def transfer_payload(transfers: DataFrame, receipts_for: Sequence[str] = ()) -> DataFrame:
    """Messages of native transfers: no contract, zero address, no log index."""
    data = F.struct(
        F.concat(F.lit("0x"), F.col("tx_from")).alias("from_address"), F.concat(F.lit("0x"), F.col("tx_to")).alias("to_address"), F.col("value").cast("string").alias("value")
    )
    named = transfers.withColumns({"event": F.lit("transfer"), "contract": F.lit(""), "contract_address": F.lit(ZERO_ADDRESS)})
    return payload(named, data, log_index=False, receipts_for=receipts_for)


def routing_key(pattern: str) -> Column:
    """A routing key from ``{table}`` and ``{event}`` in a pattern."""
    return F.replace(F.replace(F.lit(pattern), F.lit("{table}"), F.col("table")), F.lit("{event}"), F.col("event"))


def message_rows(messages: DataFrame, pattern: str) -> DataFrame:
    """``(topic, value)`` rows as message brokers' sinks take them."""
    return messages.select(routing_key(pattern).alias("topic"), F.col("body").alias("value"))


def unified(events: DataFrame, transfers: DataFrame, calls: DataFrame) -> DataFrame:
    """One stream; inside a block events stand first, then transfers, calls."""
    kinds = ((events, "event", 0), (transfers, "transfer", 1), (calls, "call", 2))
    parts = [df.withColumn("kind", F.lit(kind)).withColumn("kind_order", F.lit(order)) for df, kind, order in kinds]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def backfill_gate(messages: DataFrame, *, wants_backfill: bool) -> DataFrame:
    """What a sink gets: without backfill, live rows only."""
    return messages if wants_backfill else messages.where(~F.col("is_backfill"))
