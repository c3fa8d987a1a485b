"""Which logs, transactions and transfers are wanted.

Registries are as large as the configuration and are broadcast below a size
check; discovered children grow with the chain and never are by force.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainframes.functions import words as W
from chainframes.plans.specs import CallSpec, EventSpec, FactorySpec, TransferSpec, bare

#: Spec tables up to so many rows are sent to every executor.
BROADCAST_ROWS = 50_000
#: Longer address lists become a join.
LONG_LIST = 200


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """Hints a broadcast for a spec table that is known to have few rows; of one
    of unknown size Spark decides."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def log_contracts(logs: DataFrame, registry: DataFrame, rows: int | None = None) -> DataFrame:
    """Logs of known addresses, with their ``contract``."""
    return logs.join(small(registry, rows), "address")


def log_events(logs: DataFrame, events: DataFrame, rows: int | None = None) -> DataFrame:
    """Logs with a contract, matched to its events by ``topic0``."""
    return logs.join(small(events, rows), ["contract", "topic0"])


def address_in(column: str, addresses: Iterable[str]) -> Column:
    return F.col(column).isin([bare(a) for a in addresses])


def topic_filter(spec: EventSpec) -> Column:
    """AND over positions, OR within values; a missing topic fails."""
    wanted = F.lit(True)
    for position, values in spec.topic_filters:
        wanted = wanted & F.coalesce(F.col(f"topic{position}").isin(list(values)), F.lit(False))
    return wanted


def event_logs(logs: DataFrame, registry: DataFrame, spec: EventSpec, rows: int | None = None) -> DataFrame:
    """Logs of one entry: selector and topics first (they reach the scan), then
    the address."""
    found = logs.where((F.col("topic0") == spec.selector) & topic_filter(spec))
    return log_contracts(found, registry.where(F.col("contract") == spec.contract), rows)


def entry_logs(logs: DataFrame, registry: DataFrame, entries: Sequence[EventSpec]) -> DataFrame:
    """Logs of all entries in one pass, once per ``table`` that wants them.

    ``registry`` (``address, contract, created_block``) may have as many children
    as the chain; entries are few.  A child's logs count from its creation on.
    Topic filters are each entry's own."""
    spark = logs.sparkSession
    selectors = sorted({e.selector for e in entries})
    wanted = logs.where(F.col("topic0").isin(selectors)) if len(selectors) <= LONG_LIST else logs.where(F.col("topic0").isNotNull())
    routing = spark.createDataFrame([(e.contract, e.selector, e.table) for e in entries], "contract string, topic0 string, table string")
    own = wanted.join(registry, "address").where(F.col("block_number") >= F.col("created_block"))
    rows = own.join(small(routing, len(entries)), ["contract", "topic0"])
    for e in entries:
        if e.topic_filters:
            rows = rows.where((F.col("table") != e.table) | topic_filter(e))
    return rows


def entry_calls(txs: DataFrame, registry: DataFrame, entries: Sequence[CallSpec]) -> DataFrame:
    """As ``entry_logs``, for successful calls."""
    spark = txs.sparkSession
    routing = spark.createDataFrame([(e.contract, e.selector, e.table) for e in entries], "contract string, selector string, table string")
    wanted = txs.where((F.length("input") >= 8) & F.col("tx_to").isNotNull() & F.col("success")).withColumn("selector", F.substring("input", 1, 8))
    selectors = sorted({e.selector for e in entries})
    wanted = wanted.where(F.col("selector").isin(selectors)) if len(selectors) <= LONG_LIST else wanted
    own = wanted.join(registry.withColumnRenamed("address", "tx_to"), "tx_to").where(F.col("block_number") >= F.col("created_block"))
    return own.join(small(routing, len(entries)), ["contract", "selector"]).withColumn("address", F.col("tx_to"))


# -- blooms ------------------------------------------------------------------


def bloom_masks(bits: Iterable[int]) -> list[tuple[int, int]]:
    """(byte number from 1, mask) of bit positions in a 2048-bit block bloom,
    whose last byte holds the lowest bits."""
    return [(256 - bit // 8, 1 << bit % 8) for bit in bits]


def bloom_may_hold(bloom: str, bits: Iterable[int]) -> Column:
    """Whether all bits of one address are set in a binary bloom column."""
    tests = [
        F.conv(F.hex(F.substring(F.col(bloom), byte, 1)), 16, 10).cast("int").bitwiseAND(mask) == mask for byte, mask in bloom_masks(bits)
    ]
    return F.coalesce(tests[0] & tests[1] & tests[2], F.lit(False))


def bloom_blocks(blocks: DataFrame, addresses: Iterable[tuple[int, int, int]], bloom: str = "logs_bloom") -> DataFrame:
    """Blocks that may hold a log of any of the addresses, given as their three
    bit positions.  No wanted block is ever lost."""
    keep = F.lit(False)
    for bits in addresses:
        keep = keep | bloom_may_hold(bloom, bits)
    return blocks.where(keep)


def prune_logs(logs: DataFrame, kept_blocks: DataFrame) -> DataFrame:
    return logs.join(kept_blocks.select("block_number"), "block_number", "left_semi")


# -- factories ----------------------------------------------------------------


def factory_children(logs: DataFrame, specs: Iterable[FactorySpec]) -> DataFrame:
    """Announced children, first announcement per address:
    ``contract, address, created_block``.  All factories are met in one join."""
    specs = list(specs)
    for spec in specs:
        spec.word()  # an address
    rows = [(bare(s.address), s.selector, s.child, *s.place()) for s in specs]
    factories = logs.sparkSession.createDataFrame(rows, "address string, topic0 string, __child string, __topic int, __word int")
    made = logs.where(F.col("topic0").isin([*{s.selector for s in specs}])).join(small(factories, len(rows)), ["address", "topic0"])
    places = sorted({s.place() for s in specs})
    word = F.lit(None).cast("string")
    for topic, at in places:
        own = F.col(f"topic{topic}") if topic else W.word_at(F.col("data"), at)
        word = F.when((F.col("__topic") == topic) & (F.col("__word") == at), own).otherwise(word)
    found = made.select(F.col("__child").alias("contract"), F.right(word, F.lit(40)).alias("address"), "block_number", "tx_index", "log_index")
    first = F.min(F.struct("block_number", "tx_index", "log_index", "contract")).alias("first")
    return found.where(F.length("address") == 40).groupBy("address").agg(first).select("first.contract", "address", F.col("first.block_number").alias("created_block"))


def registry_union(static: DataFrame, children: DataFrame) -> DataFrame:
    """Configured addresses and children; a configured address wins.  Columns
    ``address, contract, created_block`` (0 for configured ones)."""
    own = static.select("address", "contract", F.lit(0).cast("bigint").alias("created_block"))
    new = children.join(static.select("address"), "address", "left_anti").select("address", "contract", "created_block")
    return own.unionByName(new)


def child_logs(logs: DataFrame, children: DataFrame) -> DataFrame:
    """Logs of children from their creation block on.  Children can be many, so
    Spark chooses the join by their size."""
    return logs.join(children, "address").where(F.col("block_number") >= F.col("created_block"))


def orphan_children(children: DataFrame, contracts: DataFrame) -> DataFrame:
    """Stored children whose contract is configured no more."""
    return children.join(contracts.select("contract").distinct(), "contract", "left_anti")


# -- calls and transfers --------------------------------------------------------


def call_rows(txs: DataFrame, functions: DataFrame, rows: int | None = None) -> DataFrame:
    """Successful calls of configured functions.  ``functions`` has ``tx_to,
    selector`` and more; cheap tests stand first."""
    wanted = txs.where((F.length("input") >= 8) & F.col("tx_to").isNotNull() & F.col("success"))
    return wanted.withColumn("selector", F.substring("input", 1, 8)).join(small(functions, rows), ["tx_to", "selector"])


def call_spec_rows(txs: DataFrame, spec: CallSpec, addresses: Iterable[str]) -> DataFrame:
    return txs.where(
        (F.length("input") >= 8) & address_in("tx_to", addresses) & (F.substring("input", 1, 8) == spec.selector) & F.col("success")
    )


def native_transfers(txs: DataFrame) -> DataFrame:
    """Value moved by successful transactions that are not creations."""
    return txs.where((F.col("value") > 0) & F.col("success") & F.col("tx_to").isNotNull())


def transfer_filter(transfers: DataFrame, spec: TransferSpec) -> DataFrame:
    """Both sides must be accepted; an empty list accepts all.  Long lists are
    joined instead of written into the plan."""
    for column, addresses in (("tx_from", spec.from_addresses), ("tx_to", spec.to_addresses)):
        if len(addresses) > LONG_LIST:
            listed = transfers.sparkSession.createDataFrame([(bare(a),) for a in set(addresses)], f"{column} string")
            transfers = transfers.join(small(listed, len(addresses)), column, "left_semi")
        elif addresses:
            transfers = transfers.where(address_in(column, addresses))
    return transfers
