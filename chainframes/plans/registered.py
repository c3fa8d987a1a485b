"""Registered queries over the overlay, each with its SQL.

A query applies one operator to whole tables; its SQL is written over the source
columns and does not decode anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainframes.functions import words as W
from chainframes.operators import context as C
from chainframes.operators import decode as D
from chainframes.operators import flatten as FL
from chainframes.operators import match as M
from chainframes.operators import messages as MS
from chainframes.operators import reorg as R
from chainframes.operators import tables as T
from chainframes.plans import query as Q
from chainframes.plans import specs as S
from chainframes.sources import overlay as O
from chainframes.sources import scan as SC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OVERLAY_SQL = """
WITH blocks AS (
  SELECT b AS block_number, 1700000000 + 12 * (b - 21000000) AS block_timestamp,
         sha256(CAST(b AS VARCHAR)) AS block_hash, sha256(CAST(b - 1 AS VARCHAR)) AS parent_hash, 1000 + b % 100 AS base_fee
  FROM (SELECT DISTINCT CAST(21000000 + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS b FROM orders)),
txs AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY block_number ORDER BY o_orderkey) - 1 AS INT) AS tx_index,
         CAST(sum(gas) OVER (PARTITION BY block_number ORDER BY o_orderkey) AS BIGINT) AS cumulative_gas_used,
         row_number() OVER (PARTITION BY tx_from ORDER BY block_number, o_orderkey) - 1 AS nonce
  FROM (SELECT CAST(21000000 + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS block_number, o_orderkey, o_custkey,
               lpad(lower(hex(o_orderkey)), 64, '0') AS tx_hash, lpad(lower(hex(o_custkey)), 40, '0') AS tx_from,
               CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE lpad(lower(hex(8192 + o_orderkey % 12)), 40, '0') END AS tx_to,
               CASE WHEN o_orderpriority = '5-LOW' THEN CAST(0 AS BIGINT) ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS value,
               CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
               o_orderstatus <> 'F' AS success, 21000 + o_orderkey % 50000 AS gas,
               2 * (o_orderkey % 2) AS tx_type, 1050 + o_custkey % 100 AS max_fee, o_custkey % 7 AS tip
        FROM orders)),
logs AS (
  SELECT t.block_number, t.tx_hash, t.tx_index, CAST(l_linenumber - 1 AS INT) AS log_index, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CASE WHEN l_returnflag = 'A' THEN 'Transfer' WHEN l_returnflag = 'R' THEN 'Approval' END AS event,
         CASE WHEN NOT (l_returnflag = 'N' AND l_linenumber = 1) AND NOT (l_returnflag = 'A' AND l_suppkey % 10 >= 8)
              THEN 'c' || CAST(l_suppkey % 10 AS VARCHAR) END AS contract
  FROM lineitem JOIN txs t ON l_orderkey = t.o_orderkey),
made AS (
  SELECT 65536 + l_partkey AS child, min(block_number) AS created_block FROM logs
  WHERE l_returnflag = 'N' AND l_linenumber = 1 GROUP BY 1),
tbl AS (
  SELECT block_number * 4294967296 + tx_index * 65536 + log_index AS id, block_number, tx_index, log_index, l_partkey AS part, l_suppkey AS supp,
         cents AS value, l_returnflag AS flag, cents % 2 = 0 AS active, CASE WHEN cents % 10 = 0 THEN NULL ELSE l_suppkey END AS ref
  FROM logs QUALIFY row_number() OVER (PARTITION BY block_number, tx_index, log_index ORDER BY l_partkey, l_suppkey, cents, l_returnflag) = 1)
"""

CONTRACTS = tuple(S.ContractSpec(f"c{i}", f"{8192 + i:040x}", 21_000_000) for i in range(10))
PARAMS = (S.Param("from", "address", True), S.Param("to", "address", True), S.Param("value", "uint256"))
EVENTS = tuple(
    S.EventSpec(c.name, event, selector, PARAMS, f"{c.name}_{event.lower()}s")
    for c in CONTRACTS
    for event, selector in (("Transfer", O.TRANSFER), ("Approval", O.APPROVAL))
)
CALL = S.CallSpec("c0", "transfer", O.CALL, (S.Param("to", "address"), S.Param("amount", "uint256")), "c0_calls")
FACTORY = S.FactorySpec(O.FACTORY, O.CREATED, "child", (S.Param("pool", "address", True),), "pool")
SPEC = S.IndexSpec(CONTRACTS, EVENTS, (CALL,), (), (FACTORY,))


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = OVERLAY_SQL + sql
        return fn

    return add


def hex40(n):
    return F.lpad(F.lower(F.hex(n)), 40, "0")


def functions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.address, O.CALL, c.name, "transfer") for c in CONTRACTS], "tx_to string, selector string, contract string, function string")


def matched(spark: SparkSession, d: str) -> DataFrame:
    """Logs of configured contracts and events."""
    rows = M.log_contracts(FL.drop_anonymous(O.logs(spark, d)), SPEC.registry(spark), len(CONTRACTS))
    return M.log_events(rows, SPEC.routing(spark), len(EVENTS))


def events_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per log position, as an indexed table."""
    rows = FL.first_per_key(
        O.logs(spark, d).select("block_number", "tx_index", "log_index", "l_partkey", "l_suppkey", "cents", "l_returnflag"),
        ["block_number", "tx_index", "log_index"],
        ["l_partkey", "l_suppkey", "cents", "l_returnflag"],
    )
    cents = F.col("cents")
    return FL.with_row_id(rows).select(
        "id", "block_number", "tx_index", "log_index", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), cents.alias("value"),
        F.col("l_returnflag").alias("flag"), (cents % 2 == 0).alias("active"), F.when(cents % 10 == 0, None).otherwise(F.col("l_suppkey")).alias("ref"),
    )


def progress(spark: SparkSession, d: str) -> DataFrame:
    """Epochs of 100 blocks, every third one missing."""
    epochs = O.blocks(spark, d).groupBy(F.floor(F.col("block_number") / 100).alias("epoch")).agg(F.max("block_number").alias("max_block"))
    return epochs.where("epoch % 3 <> 0")


PROGRESS_SQL = "(SELECT block_number // 100 AS epoch, max(block_number) AS max_block FROM blocks WHERE block_number // 100 % 3 <> 0 GROUP BY 1)"

# -- scans, checkpoints ---------------------------------------------------------


@query("SELECT block_number, block_timestamp, block_hash FROM blocks WHERE block_number BETWEEN 21000300 AND 21001800")
def block_range_scan(spark, d):
    return SC.block_range(O.blocks(spark, d), 21_000_300, 21_001_800).select("block_number", "block_timestamp", "block_hash")


@query("SELECT min(block_number) AS effective_start FROM txs WHERE tx_to IN (SELECT lpad(lower(hex(8192 + i)), 40, '0') FROM range(10) r(i))")
def effective_start(spark, d):
    """The contracts' start blocks are those of the first transactions to them."""
    first = O.txs(spark, d).where(M.address_in("tx_to", [c.address for c in CONTRACTS])).groupBy("tx_to").agg(F.min("block_number").alias("start_block"))
    starts = {r["tx_to"]: r["start_block"] for r in first.collect()}  # a row per contract of the spec
    spec = S.IndexSpec(tuple(S.ContractSpec(c.name, c.address, starts[c.address]) for c in CONTRACTS if c.address in starts))
    return spark.createDataFrame([(spec.effective_start(),)], "effective_start bigint")


@query(f"SELECT max(max_block) + 1 AS from_block, CAST(21003000 AS BIGINT) AS to_block FROM {PROGRESS_SQL} HAVING max(max_block) + 1 <= 21003000")
def resume_range(spark, d):
    return SC.resume_range(progress(spark, d), 21_000_000, 21_003_000)


@query(f"SELECT max(max_block) AS checkpoint FROM {PROGRESS_SQL}")
def checkpoint_max(spark, d):
    return T.checkpoint(progress(spark, d))


@query(f"SELECT CAST(max(max_block) AS VARCHAR) AS block FROM {PROGRESS_SQL}")
def meta_block(spark, d):
    return SC.meta_block(progress(spark, d))


#: After the epoch of block 21001000 the chain went back to 21000450, after that of 21001600 to 21000910.
BACK = [(210010, 21_000_450), (210016, 21_000_910)]
BACK_SQL = f"""(SELECT max(CASE WHEN epoch < 210010 THEN least(max_block, 21000450) WHEN epoch < 210016 THEN least(max_block, 21000910) ELSE max_block END) AS done
  FROM {PROGRESS_SQL} WHERE epoch < 210017)"""


def undone(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Progress up to the second rollback, and the rollbacks."""
    return progress(spark, d).where("epoch < 210017"), spark.createDataFrame(BACK, "epoch bigint, ancestor bigint")


@query(f"SELECT done + 1 AS from_block, CAST(21003000 AS BIGINT) AS to_block FROM {BACK_SQL}")
def resume_after_rollback(spark, d):
    rows, back = undone(spark, d)
    return SC.resume_range(rows, 21_000_000, 21_003_000, back)


@query(f"SELECT CAST(done AS VARCHAR) AS block FROM {BACK_SQL}")
def meta_after_rollback(spark, d):
    return SC.meta_block(*undone(spark, d))


@query(f"SELECT done AS checkpoint FROM {BACK_SQL}")
def checkpoint_after_rollback(spark, d):
    return T.checkpoint(*undone(spark, d))


@query("SELECT max(block_number) AS block_number, max(block_timestamp) AS block_timestamp FROM blocks")
def latest_block(spark, d):
    return O.blocks(spark, d).agg(F.max("block_number").alias("block_number"), F.max_by("block_timestamp", "block_number").alias("block_timestamp"))


@query(f"""SELECT h AS head, n AS next_block, greatest(0, h - n + 1) AS gap, h - n + 1 <= 2 AS ready
FROM (SELECT (SELECT max(block_number) FROM blocks) AS h, (SELECT max(max_block) + 1 FROM {PROGRESS_SQL}) AS n)""")
def head_gap(spark, d):
    return R.head_gap(O.blocks(spark, d), progress(spark, d))


@query("""SELECT block_number + 1 AS first_missing, nxt - 1 AS last_missing
FROM (SELECT block_number, lead(block_number) OVER (ORDER BY block_number) AS nxt FROM blocks WHERE block_number % 7 <> 3) WHERE nxt > block_number + 1""")
def block_gaps(spark, d):
    return R.block_gaps(O.blocks(spark, d).where("block_number % 7 <> 3"))


@query("""SELECT b.block_number, b.parent_hash, 'x' AS expected FROM blocks b JOIN blocks p ON p.block_number = b.block_number - 1
WHERE p.block_number % 50 = 0""")
def chain_breaks(spark, d):
    forked = F.when(F.col("block_number") % 50 == 0, "x").otherwise(F.col("block_hash"))
    return R.chain_breaks(O.blocks(spark, d).withColumn("block_hash", forked))


@query("SELECT block_number, CASE WHEN block_number % 10 = 0 THEN 'y' || block_hash ELSE block_hash END AS block_hash FROM blocks")
def block_hash_current(spark, d):
    b = O.blocks(spark, d).select("block_number", "block_hash")
    again = b.where("block_number % 10 = 0").select(F.lit(2).alias("epoch"), "block_number", F.concat(F.lit("y"), "block_hash").alias("block_hash"))
    return T.current_hashes(b.select(F.lit(1).alias("epoch"), "block_number", "block_hash").unionByName(again))


@query("""SELECT max(b.block_number) AS ancestor FROM blocks b
WHERE b.block_number NOT IN (SELECT block_number FROM blocks ORDER BY block_number DESC LIMIT 3)
  AND b.block_number >= (SELECT max(block_number) - 64 FROM blocks)""")
def reorg_ancestor(spark, d):
    stored = O.blocks(spark, d)
    last = stored.agg(F.max("block_number").alias("b")).first()["b"]
    top = stored.orderBy(F.desc("block_number")).limit(3).select("block_number", F.lit("x").alias("now"))
    canonical = stored.join(top, "block_number", "left").withColumn("block_hash", F.coalesce("now", "block_hash"))
    return R.common_ancestor(stored, canonical, last)


@query("""SELECT block_number, CASE WHEN block_number % 11 = 0 THEN 'inconclusive' WHEN block_number % 5 = 0 THEN 'unknown'
            WHEN block_number % 3 = 0 THEN 'reorg' ELSE 'same' END AS status FROM blocks""")
def reorg_status(spark, d):
    b = O.blocks(spark, d)
    n = F.col("block_number")
    observed = b.withColumn("block_hash", F.when(n % 11 == 0, None).when(n % 3 == 0, "x").otherwise(F.col("block_hash")))
    return R.reorg_status(b.where("block_number % 5 <> 0"), observed)


# -- flatten and positions --------------------------------------------------------


@query("""SELECT block_number, tx_hash, tx_index, CAST(row_number() OVER (PARTITION BY block_number, tx_index
            ORDER BY log_index, l_partkey, l_suppkey, cents, l_returnflag) - 1 AS INT) AS log_index, l_partkey, l_suppkey, cents FROM logs""")
def flatten_logs(spark, d):
    return FL.flatten_logs(O.nested_blocks(spark, d))


@query("SELECT block_number, count(*) AS n FROM logs WHERE block_number % 50 <> 0 GROUP BY 1")
def mismatch_drop(spark, d):
    t = O.txs(spark, d).select("block_number", "tx_index")
    last = F.max("tx_index").over(Window.partitionBy("block_number"))
    receipts = t.withColumn("last", last).where("block_number % 50 <> 0 OR tx_index < last")
    return FL.drop_mismatched(O.logs(spark, d), t, receipts).groupBy("block_number").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM logs WHERE NOT (l_returnflag = 'N' AND l_linenumber = 7) GROUP BY 1")
def anonymous_drop(spark, d):
    return FL.drop_anonymous(O.logs(spark, d)).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("SELECT block_number, count(*) AS receipts FROM txs GROUP BY 1")
def receipts_per_block(spark, d):
    return O.txs(spark, d).groupBy("block_number").agg(F.count("*").alias("receipts"))


@query("SELECT block_number, o_orderkey, tx_index FROM txs")
def tx_positions(spark, d):
    return FL.with_positions(O.txs(spark, d).drop("tx_index"), "o_orderkey").select("block_number", "o_orderkey", "tx_index")


@query("SELECT o_orderkey, CAST(gas AS BIGINT) AS gas_used FROM txs")
def tx_gas_used(spark, d):
    return FL.with_gas_used(O.txs(spark, d)).select("o_orderkey", "gas_used")


@query("SELECT block_number * 4294967296 + tx_index * 65536 + log_index AS id, l_partkey, l_suppkey, cents FROM logs")
def row_id(spark, d):
    return FL.with_row_id(O.logs(spark, d)).select("id", "l_partkey", "l_suppkey", "cents")


@query("SELECT id, part, supp, value FROM tbl")
def dedup_first(spark, d):
    return events_table(spark, d).select("id", "part", "supp", "value")


# -- matching --------------------------------------------------------------------


@query("SELECT contract, count(*) AS n FROM logs WHERE contract IS NOT NULL GROUP BY 1")
def address_filter(spark, d):
    return M.log_contracts(O.logs(spark, d), SPEC.registry(spark), 10).groupBy("contract").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n FROM logs WHERE contract IS NOT NULL AND event IS NOT NULL GROUP BY 1")
def selector_filter(spark, d):
    return matched(spark, d).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""SELECT block_number, tx_index, log_index, l_partkey, l_suppkey, cents FROM logs
WHERE event = 'Transfer' AND contract = 'c3' AND l_partkey BETWEEN 1 AND 1500 AND l_suppkey IN (3, 13, 23, 33)""")
def topic_filter(spark, d):
    parts = tuple(S.topic_literal("uint256", str(i)) for i in range(1, 1501))
    supps = tuple(S.topic_literal("uint256", str(i)) for i in (3, 13, 23, 33))
    spec = S.EventSpec("c3", "Transfer", O.TRANSFER, PARAMS, "c3", topic_filters=((1, parts), (2, supps)))
    found = M.event_logs(O.logs(spark, d), SPEC.registry(spark), spec, 10)
    return found.select("block_number", "tx_index", "log_index", "l_partkey", "l_suppkey", "cents")


@query("""SELECT DISTINCT lpad(lower(hex(l_partkey)), 64, '0') AS number_topic, lpad(lower(hex(8192 + l_suppkey % 10)), 64, '0') AS address_topic,
       CASE WHEN l_linenumber > 3 THEN lpad('1', 64, '0') ELSE repeat('0', 64) END AS bool_topic FROM lineitem""")
def topic_encode(spark, d):
    li = O.table(spark, d, "lineitem")
    return li.select(
        S.encode_topic("uint256", F.col("l_partkey")).alias("number_topic"),
        S.encode_topic("address", F.concat(F.lit("0x"), hex40(8192 + F.col("l_suppkey") % 10))).alias("address_topic"),
        S.encode_topic("bool", F.col("l_linenumber") > 3).alias("bool_topic"),
    ).distinct()


@query("SELECT block_number, count(*) AS n FROM logs WHERE contract IN ('c1', 'c4') GROUP BY 1")
def bloom_prune(spark, d):
    """Real bit positions: blooms are built from every log's address."""
    logs = O.logs(spark, d)
    spec = S.IndexSpec((CONTRACTS[1], CONTRACTS[4]), tuple(e for e in EVENTS if e.contract in ("c1", "c4")))
    kept = M.bloom_blocks(O.with_bloom(O.blocks(spark, d), logs), spec.bloom_bits())
    return M.log_contracts(M.prune_logs(logs, kept), spec.registry(spark), 2).groupBy("block_number").agg(F.count("*").alias("n"))


@query("SELECT contract, block_number, tx_index, log_index, l_partkey, l_suppkey, cents FROM logs WHERE contract IS NOT NULL")
def log_contract_join(spark, d):
    return M.log_contracts(O.logs(spark, d), SPEC.registry(spark), 10).select("contract", "block_number", "tx_index", "log_index", "l_partkey", "l_suppkey", "cents")


@query("SELECT contract, event, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM logs WHERE contract IS NOT NULL AND event IS NOT NULL GROUP BY ALL")
def log_event_join(spark, d):
    return matched(spark, d).groupBy("contract", "event").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("""SELECT contract || '_' || lower(event) || 's' AS "table", block_number, tx_index, log_index, cents FROM logs
WHERE contract IS NOT NULL AND event IS NOT NULL""")
def table_routing(spark, d):
    return matched(spark, d).select("table", "block_number", "tx_index", "log_index", "cents")


@query("""SELECT t.tbl AS "table", count(*) AS n FROM logs JOIN (SELECT 'Transfer' AS event, 'moves' AS tbl UNION ALL SELECT 'Transfer', 'audit' UNION ALL SELECT 'Approval', 'audit') t USING (event)
WHERE contract IS NOT NULL GROUP BY 1""")
def fan_out_counts(spark, d):
    routes = spark.createDataFrame([(c.name, e, t) for c in CONTRACTS for e, t in (("Transfer", "moves"), ("Transfer", "audit"), ("Approval", "audit"))], "contract string, event string, table string")
    return T.fan_out(matched(spark, d).drop("table"), routes, 3 * len(CONTRACTS)).groupBy("table").agg(F.count("*").alias("n"))


@query("""SELECT lpad(lower(hex(8192 + i)), 40, '0') AS address, 'c' || CAST(i AS VARCHAR) AS contract, CAST(0 AS BIGINT) AS created_block FROM range(10) r(i)
UNION ALL SELECT lpad(lower(hex(child)), 40, '0'), 'child', created_block FROM made""")
def registry_union(spark, d):
    children = M.factory_children(O.logs(spark, d), [FACTORY])
    clash = children.limit(0).unionByName(spark.createDataFrame([("child", CONTRACTS[0].address, 5)], "contract string, address string, created_block bigint"))
    return M.registry_union(SPEC.registry(spark), children.unionByName(clash))


@query("SELECT block_number, tx_index, log_index, lpad(lower(hex(65536 + l_partkey)), 40, '0') AS child FROM logs WHERE l_returnflag = 'N' AND l_linenumber = 1")
def factory_discovery(spark, d):
    found = O.logs(spark, d).where((F.col("address") == FACTORY.address) & (F.col("topic0") == FACTORY.selector))
    return found.select("block_number", "tx_index", "log_index", F.right(FACTORY.word(), F.lit(40)).alias("child"))


@query("SELECT 'child' AS contract, lpad(lower(hex(child)), 40, '0') AS address, created_block FROM made")
def factory_children(spark, d):
    return M.factory_children(O.logs(spark, d), [FACTORY])


@query("""SELECT block_number, tx_index, log_index, 65536 + l_partkey AS child, l_suppkey, cents FROM logs JOIN made ON child = 65536 + l_partkey
WHERE l_returnflag = 'A' AND l_suppkey % 10 >= 8 AND block_number >= created_block""")
def factory_child_logs(spark, d):
    logs = O.logs(spark, d)
    found = M.child_logs(logs.where(F.col("topic0") == O.TRANSFER), M.factory_children(logs, [FACTORY]))
    return found.select("block_number", "tx_index", "log_index", (65536 + F.col("l_partkey")).alias("child"), "l_suppkey", "cents")


@query("SELECT lpad(lower(hex(child)), 40, '0') AS address, created_block FROM made WHERE child % 4 = 0")
def orphan_children(spark, d):
    low = F.conv(F.right("address", F.lit(1)), 16, 10).cast("int") % 4 == 0
    children = M.factory_children(O.logs(spark, d), [FACTORY]).withColumn("contract", F.when(low, "gone").otherwise(F.col("contract")))
    return M.orphan_children(children, spark.createDataFrame([("child",)], "contract string")).select("address", "created_block")


# -- transfers and calls -----------------------------------------------------------

MOVED = "value > 0 AND success AND tx_to IS NOT NULL"
CALLED = "o_orderkey % 3 = 0 AND success AND tx_to IS NOT NULL AND o_orderkey % 12 < 10"


@query(f"SELECT block_number, tx_index, tx_from, tx_to, value FROM txs WHERE {MOVED}")
def native_transfers(spark, d):
    return M.native_transfers(O.txs(spark, d)).select("block_number", "tx_index", "tx_from", "tx_to", "value")


@query(f"SELECT block_number, tx_index, value FROM txs WHERE {MOVED} AND o_orderkey % 12 IN (1, 2) AND o_custkey < 600")
def transfer_filter(spark, d):
    spec = S.TransferSpec("moves", tuple(f"0x{i:040x}" for i in range(600)), (CONTRACTS[1].address, CONTRACTS[2].address.upper().replace("X", "x")))
    return M.transfer_filter(M.native_transfers(O.txs(spark, d)), spec).select("block_number", "tx_index", "value")


@query(f"SELECT block_number, tx_index, tx_to FROM txs WHERE {CALLED}")
def function_calls(spark, d):
    return M.call_rows(O.txs(spark, d), functions(spark), 10).select("block_number", "tx_index", "tx_to")


@query(f"SELECT 'c' || CAST(o_orderkey % 12 AS VARCHAR) AS contract, 'transfer' AS function, count(*) AS n FROM txs WHERE {CALLED} GROUP BY 1")
def call_function_join(spark, d):
    return M.call_rows(O.txs(spark, d), functions(spark), 10).groupBy("contract", "function").agg(F.count("*").alias("n"))


@query(f"SELECT block_number, tx_index, '0x' || lpad(lower(hex(o_custkey)), 40, '0') AS \"to\", CAST(total_cents AS VARCHAR) AS amount FROM txs WHERE {CALLED}")
def decode_calls(spark, d):
    return D.decode_calls(M.call_rows(O.txs(spark, d), functions(spark), 10), CALL.params, ("block_number", "tx_index"))


@query(f"SELECT block_number, tx_index, '0x' || lpad(lower(hex(o_custkey)), 40, '0') AS recipient, total_cents AS paid_cents FROM txs WHERE {CALLED}")
def param_projection(spark, d):
    params = (S.Param("to", "address", column="recipient"), S.Param("amount", "uint64", column="paid_cents"))
    return D.decode_calls(M.call_rows(O.txs(spark, d), functions(spark), 10), params, ("block_number", "tx_index"))


# -- context -----------------------------------------------------------------------

PRICE = "CASE WHEN tx_type = 2 THEN least(max_fee, base_fee + tip) ELSE max_fee END"


def attributes(spark: SparkSession, d: str) -> DataFrame:
    return C.context(O.blocks(spark, d), FL.with_gas_used(O.txs(spark, d)))


@query(f"""SELECT block_number, tx_index, block_timestamp, block_hash, tx_from, tx_to, CAST(value AS VARCHAR) AS tx_value, CAST({PRICE} AS BIGINT) AS tx_gas_price,
       CAST(gas AS BIGINT) AS tx_gas_used, nonce AS tx_nonce, cumulative_gas_used, success AS tx_status FROM txs JOIN blocks USING (block_number)""")
def context_join(spark, d):
    return attributes(spark, d)


@query("""SELECT l.block_number, l.tx_index, log_index, cents, block_timestamp, tx_from, CAST(value AS VARCHAR) AS tx_value
FROM logs l JOIN txs t ON l_orderkey = o_orderkey JOIN blocks b ON b.block_number = l.block_number WHERE event = 'Transfer'""")
def context_columns(spark, d):
    spec = S.EventSpec("c0", "Transfer", O.TRANSFER, PARAMS, "t", context=("block_timestamp", "tx_from", "tx_value"))
    fields = S.context_fields(spec)
    rows = O.logs(spark, d).where(F.col("topic0") == O.TRANSFER).select("block_number", "tx_index", "log_index", "cents")
    return C.with_context(rows, attributes(spark, d), fields)


@query("""SELECT l.block_number, l.tx_index, log_index, cents, tx_to, CAST(gas AS BIGINT) AS tx_gas_used, nonce AS tx_nonce, cumulative_gas_used, success AS tx_status
FROM logs l JOIN txs t ON l_orderkey = o_orderkey WHERE event = 'Approval'""")
def receipt_context(spark, d):
    spec = S.EventSpec("c0", "Approval", O.APPROVAL, PARAMS, "t", context=("tx_to",), include_receipts=True)
    rows = O.logs(spark, d).where(F.col("topic0") == O.APPROVAL).select("block_number", "tx_index", "log_index", "cents")
    return C.with_context(rows, attributes(spark, d), S.context_fields(spec))


@query(f"SELECT o_orderkey, CAST({PRICE} AS BIGINT) AS price FROM txs JOIN blocks USING (block_number)")
def effective_gas_price(spark, d):
    rows = O.txs(spark, d).join(O.blocks(spark, d).select("block_number", "base_fee"), "block_number")
    return rows.select("o_orderkey", C.effective_gas_price().cast("bigint").alias("price"))


# -- decoding ------------------------------------------------------------------------


@query("""SELECT block_number, tx_index, log_index, '0x' || lpad(lower(hex(l_partkey)), 40, '0') AS "from", '0x' || lpad(lower(hex(l_suppkey)), 40, '0') AS "to",
       CAST(cents AS VARCHAR) AS value FROM logs WHERE event IS NOT NULL AND contract IS NOT NULL""")
def decode_events(spark, d):
    return D.decode_events(matched(spark, d), PARAMS, ("block_number", "tx_index", "log_index"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 2 = 1 AS flag FROM lineitem")
def decode_bool(spark, d):
    data = O.table(spark, d, "lineitem").withColumn("data", W.encode_word(F.col("l_linenumber") % 2))
    return D.decode_events(data, (S.Param("flag", "bool"),), ("l_orderkey", "l_linenumber", "l_partkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey * 1000000007 + 9000000000000000000 AS number FROM lineitem")
def decode_uint64(spark, d):
    data = O.table(spark, d, "lineitem").withColumn("data", W.encode_word(F.col("l_partkey") * 1_000_000_007 + F.lit(9_000_000_000_000_000_000)))
    return D.decode_events(data, (S.Param("number", "uint64"),), ("l_orderkey", "l_linenumber"))


@query("SELECT l_orderkey, l_linenumber, -l_partkey * 1000003 - l_suppkey AS number FROM lineitem")
def decode_int64(spark, d):
    minus = -F.col("l_partkey") * 1_000_003 - F.col("l_suppkey")
    word = F.when(minus < 0, F.lpad(F.lower(F.hex(minus)), 64, "f")).otherwise(W.encode_word(minus))
    data = O.table(spark, d, "lineitem").withColumn("data", word)
    return D.decode_events(data, (S.Param("number", "int64"),), ("l_orderkey", "l_linenumber"))


@query("""SELECT o_orderkey, CAST(CAST('0x' || substr(h, 1, 15) AS HUGEINT) * 1152921504606846976 + CAST('0x' || substr(h, 16, 15) AS HUGEINT) AS VARCHAR) AS number
FROM (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)""")
def decode_uint256(spark, d):
    low = F.concat(F.lit("0" * 34), F.left(F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit(30)))
    data = O.table(spark, d, "orders").withColumn("data", low)
    return D.decode_events(data, (S.Param("number", "uint256"),), ("o_orderkey",))


@query("""SELECT o_orderkey, CAST(-(CAST('0x' || substr(h, 1, 15) AS HUGEINT) * 1152921504606846976 + CAST('0x' || substr(h, 16, 15) AS HUGEINT)) - 1 AS VARCHAR) AS number
FROM (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)""")
def decode_int256(spark, d):
    low = F.concat(F.lit("0" * 34), F.left(F.sha2(F.col("o_orderkey").cast("string"), 256), F.lit(30)))
    data = O.table(spark, d, "orders").withColumn("data", F.translate(low, "0123456789abcdef", "fedcba9876543210"))
    return D.decode_events(data, (S.Param("number", "int256"),), ("o_orderkey",))


def encoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a dynamic ABI argument: offset, length, padded bytes."""
    body = F.lower(F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    size = (F.length(body) / 2).cast("bigint")
    padded = F.rpad(body, (F.ceil(F.length(body) / 64) * 64).cast("int"), F.lit("0"))
    data = F.concat(W.encode_word(F.lit(32)), W.encode_word(size), padded)
    # through a generator, so that decoding reads the encoded text and does not encode it again
    return O.table(spark, d, "documents").select("doc_id", F.explode(F.array(data)).alias("data"))


@query("SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(coalesce(text, '')) AS digest FROM documents")
def decode_string(spark, d):
    out = D.decode_events(encoded_texts(spark, d), (S.Param("text", "string"),), ("doc_id",))
    return out.select("doc_id", F.char_length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS digest, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS tag FROM documents")
def decode_bytes(spark, d):
    head = F.concat(F.rpad(F.left(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(8)), 64, "0"), W.encode_word(F.lit(64)), F.substring("data", F.lit(65), F.length("data")))
    rows = encoded_texts(spark, d).select("doc_id", F.explode(F.array(head)).alias("data"))
    out = D.decode_events(rows, (S.Param("tag", "bytes4"), S.Param("body", "bytes")), ("doc_id",))
    return out.select("doc_id", F.octet_length("body").cast("bigint").alias("size"), F.sha2("body", 256).alias("digest"), F.lower(F.hex("tag")).alias("tag"))


@query("SELECT o_orderkey, count(l_orderkey) AS n, CAST(coalesce(sum(round(l_extendedprice * 100)), 0) AS BIGINT) AS cents FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def decode_array(spark, d):
    out = D.decode_events(item_arrays(spark, d), (S.Param("cents", "uint64[]"),), ("o_orderkey",))
    return out.select("o_orderkey", F.size("cents").cast("bigint").alias("n"), F.aggregate("cents", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("cents"))


def item_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The cents of each order's items as a dynamic array."""
    items = O.logs(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.collect_list("data"), "").alias("body"))
    keyed = O.table(spark, d, "orders").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    data = F.concat(W.encode_word(F.lit(32)), W.encode_word(F.coalesce("n", F.lit(0))), F.coalesce("body", F.lit("")))
    return keyed.select("o_orderkey", F.explode(F.array(data)).alias("data"))


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS entry, count(*) FILTER (WHERE doc_id % 5 < 2) AS failed, count(*) FILTER (WHERE doc_id % 5 >= 2) AS decoded
FROM documents GROUP BY 1""")
def decode_failures(spark, d):
    n = F.col("doc_id") % 5
    broken = F.when(n == 0, F.left("data", F.lit(96))).when(n == 1, F.concat(W.encode_word(F.length("data") * 2), F.substring("data", 65, 1 << 30))).otherwise(F.col("data"))
    rows = encoded_texts(spark, d).withColumn("data", broken).withColumn("entry", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    return D.decode_failures(rows, (S.Param("text", "string"),), ("entry",))


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'cut' WHEN o_orderkey % 3 = 1 THEN 'far' ELSE 'whole' END AS entry,
 count(*) FILTER (WHERE o_orderkey % 3 = 1 OR (o_orderkey % 3 = 0 AND n > 0)) AS failed, count(*) FILTER (WHERE o_orderkey % 3 = 2 OR (o_orderkey % 3 = 0 AND n = 0)) AS decoded
FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) GROUP BY 1""")
def decode_cut_arrays(spark, d):
    rows = item_arrays(spark, d)
    kind = F.col("o_orderkey") % 3
    whole = F.length("data")
    broken = F.when((kind == 0) & (whole > 128), F.left("data", whole - 64)).when(kind == 1, F.concat(F.left("data", F.lit(64)), W.encode_word(F.lit(1 << 20)))).otherwise(F.col("data"))
    rows = rows.withColumn("data", broken).withColumn("entry", F.when(kind == 0, "cut").when(kind == 1, "far").otherwise("whole"))
    return D.decode_failures(rows, (S.Param("cents", "uint64[]"),), ("entry",))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey % 2 = 0 AS even, 'n' || l_suppkey AS name, l_linenumber AS line FROM lineitem")
def decode_tuple(spark, d):
    """(part, (even, name), line), the inner tuple behind an offset of its own."""
    name = F.lower(F.hex(F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))))
    word = lambda c: W.encode_word(c.cast("bigint"))
    data = F.concat(
        word(F.lit(32)), word(F.col("l_partkey")), word(F.lit(96)), word(F.col("l_linenumber")),
        word(F.col("l_suppkey") % 2 == 0), word(F.lit(64)), word(F.length(name) / 2), F.rpad(name, 64, "0"),
    )
    rows = O.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array(data)).alias("data"))
    out = D.decode_events(rows, (S.Param("t", "(uint64,(bool,string),uint8)"),), ("l_orderkey", "l_linenumber"))
    return out.select("l_orderkey", "l_linenumber", F.col("t.f0").alias("part"), F.col("t.f1.f0").alias("even"), F.col("t.f1.f1").alias("name"), F.col("t.f2").alias("line"))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS a, l_suppkey AS b, CAST(l_linenumber AS BIGINT) AS c, CAST(-1 - l_partkey AS VARCHAR) AS after FROM lineitem")
def decode_fixed_array(spark, d):
    minus = F.concat(F.lit("f" * 48), F.lower(F.hex(-1 - F.col("l_partkey"))))
    data = F.concat(*[W.encode_word(F.col(c).cast("bigint")) for c in ("l_partkey", "l_suppkey", "l_linenumber")], minus)
    rows = O.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array(data)).alias("data"))
    out = D.decode_events(rows, (S.Param("items", "uint64[3]"), S.Param("after", "int128")), ("l_orderkey", "l_linenumber"))
    return out.select("l_orderkey", "l_linenumber", *[F.get("items", F.lit(i)).alias(n) for i, n in enumerate("abc")], "after")


@query("SELECT c_custkey, [c_name, c_mktsegment, ''] AS names FROM customer")
def decode_string_array(spark, d):
    texts = [F.lower(F.hex(c)) for c in (F.col("c_name"), F.col("c_mktsegment"), F.lit(""))]
    parts = [F.concat(W.encode_word((F.length(t) / 2).cast("bigint")), F.rpad(t, (F.ceil(F.length(t) / 64) * 64).cast("int"), F.lit("0"))) for t in texts]
    sizes = [(F.length(p) / 2).cast("bigint") for p in parts]
    offsets = [F.lit(96).cast("bigint"), 96 + sizes[0], 96 + sizes[0] + sizes[1]]
    data = F.concat(W.encode_word(F.lit(32)), W.encode_word(F.lit(3)), *map(W.encode_word, offsets), *parts)
    rows = O.table(spark, d, "customer").select("c_custkey", F.explode(F.array(data)).alias("data"))
    return D.decode_events(rows, (S.Param("names", "string[]"),), ("c_custkey",))


# -- tables ----------------------------------------------------------------------------

KEY = ["block_number", "tx_index", "log_index"]
ORDER = ["l_partkey", "l_suppkey", "cents", "l_returnflag"]


def keyed_logs(spark: SparkSession, d: str) -> DataFrame:
    return O.logs(spark, d).select(*KEY, *ORDER)


@query("SELECT block_number, tx_index, log_index, part, supp, value FROM tbl WHERE (block_number, tx_index, log_index) NOT IN (SELECT (block_number, tx_index, log_index) FROM logs WHERE block_number % 3 = 0)")
def idempotent_append(spark, d):
    rows = keyed_logs(spark, d)
    added = T.new_rows(rows, rows.where("block_number % 3 = 0"), KEY, ORDER)
    return added.select(*KEY, F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("cents").alias("value"))


@query("""SELECT count(*) AS n, CAST(sum(value) AS BIGINT) AS cents FROM tbl t
WHERE (block_number, tx_index) NOT IN (SELECT (block_number, tx_index) FROM txs WHERE o_orderkey % 5 = 0)""")
def conflict_skip(spark, d):
    stored = O.logs(spark, d).where("l_orderkey % 5 = 0").select(*KEY).distinct()
    return T.new_rows(keyed_logs(spark, d), stored, KEY, ORDER).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(f"SELECT block_number, tx_index, value FROM txs WHERE {MOVED} AND block_number % 4 <> 0")
def transfer_append(spark, d):
    moved = M.native_transfers(O.txs(spark, d)).select("block_number", "tx_index", "value")
    again = moved.unionByName(moved.where("value % 3 = 0"))
    return T.new_rows(again, moved.where("block_number % 4 = 0"), ["block_number", "tx_index"], ["value"])


@query(f"SELECT block_number, tx_index, o_orderkey FROM txs WHERE {CALLED} AND block_number % 4 <> 1")
def call_append(spark, d):
    called = M.call_rows(O.txs(spark, d), functions(spark), 10).select("block_number", "tx_index", "o_orderkey")
    return T.new_rows(called.unionByName(called), called.where("block_number % 4 = 1"), ["block_number", "tx_index"], ["o_orderkey"])


@query("SELECT id, block_number, value FROM tbl WHERE block_number <= 21001500")
def rollback_rows(spark, d):
    return T.rolled_back(events_table(spark, d), 21_001_500).select("id", "block_number", "value")


@query("""SELECT id, block_number, value FROM tbl WHERE NOT (block_number // 500 < 42003 AND block_number > 21001200)
  AND NOT (block_number // 500 < 42001 AND block_number > 21000400)""")
def visible_rows(spark, d):
    rows = events_table(spark, d).withColumn("epoch", F.floor(F.col("block_number") / 500))
    back = spark.createDataFrame([(42003, 21_001_200), (42001, 21_000_400)], "epoch bigint, ancestor bigint")
    return T.visible(rows, back).select("id", "block_number", "value")


# -- messages ------------------------------------------------------------------------------


@query("""SELECT block_number, contract || '_' || lower(event) || 's' AS "table", event, count(*) AS n FROM logs WHERE contract IS NOT NULL AND event IS NOT NULL GROUP BY ALL""")
def table_counts(spark, d):
    return MS.table_counts(matched(spark, d))


@query("""SELECT block_number, '{"block_number":' || block_number || ',"block_timestamp":' || block_timestamp || ',"tables":[' ||
       string_agg('{"name":"' || tab || '","event":"' || event || '","count":' || n || '}', ',' ORDER BY tab, event) || ']}' AS body
FROM (SELECT block_number, contract || '_' || lower(event) || 's' AS tab, event, count(*) AS n FROM logs WHERE contract IS NOT NULL AND event IS NOT NULL GROUP BY ALL)
JOIN blocks USING (block_number) GROUP BY block_number, block_timestamp""")
def block_notification(spark, d):
    return MS.block_notifications(MS.table_counts(matched(spark, d)), O.blocks(spark, d))


@query(f"""SELECT 'blocks' AS counter, count(*) AS n FROM blocks UNION ALL SELECT 'receipts', count(*) FROM txs UNION ALL
SELECT 'matched', count(*) FROM logs WHERE contract IS NOT NULL AND event IS NOT NULL UNION ALL
SELECT 'transfers', count(*) FROM txs WHERE {MOVED} UNION ALL SELECT 'calls', count(*) FROM txs WHERE {CALLED}""")
def run_totals(spark, d):
    t = O.txs(spark, d)
    return MS.run_totals(blocks=O.blocks(spark, d), receipts=t, matched=matched(spark, d), transfers=M.native_transfers(t), calls=M.call_rows(t, functions(spark), 10))


def told(spark: SparkSession, d: str) -> DataFrame:
    """Matched logs with the attributes that messages carry."""
    rows = matched(spark, d).withColumn("contract_address", F.col("address"))
    return C.with_context(rows, attributes(spark, d), ("block_timestamp", "tx_from", *MS.RECEIPT_PAYLOAD))


MESSAGE = """'{"table":"' || contract || '_' || lower(event) || 's","event":"' || event || '","contract_name":"' || contract || '","contract":"0x' ||
 lpad(lower(hex(8192 + l_suppkey % 10)), 40, '0') || '","block_number":' || l.block_number || ',"block_timestamp":' || block_timestamp || ',"tx_hash":"0x' || l.tx_hash ||
 '","log_index":' || log_index || ',"tx_index":' || l.tx_index || ',"tx_from":"0x' || tx_from || '"' ||"""
RECEIPTS = f"""',"tx_value":"' || value || '","tx_gas_price":' || {PRICE} || ',"gas_used":' || gas || ',"nonce":' || nonce ||
 ',"cumulative_gas_used":' || cumulative_gas_used || ',"status":' || CASE WHEN success THEN 'true' ELSE 'false' END"""
MESSAGE_ROWS = "logs l JOIN txs t ON l_orderkey = o_orderkey JOIN blocks b ON b.block_number = l.block_number WHERE contract IS NOT NULL AND event IS NOT NULL"
DATA = """',"data":{"from":"0x' || lpad(lower(hex(l_partkey)), 40, '0') || '","to":"0x' || lpad(lower(hex(l_suppkey)), 40, '0') || '","value":"' || cents || '"}}'"""


def event_messages(rows: DataFrame, receipts_for=()) -> DataFrame:
    cols = D.param_columns(PARAMS, F.col("data"), {"from": "p_from", "to": "p_to", "value": "p_value"})
    typed = rows.select(*rows.columns, *cols)
    data = MS.data_struct(typed, (("p_from", "from"), ("p_to", "to"), ("p_value", "value")))
    return MS.payload(typed, data, log_index=True, receipts_for=receipts_for)


@query(f"SELECT l.block_number, l.tx_index, log_index, {MESSAGE} {DATA} AS body FROM {MESSAGE_ROWS}")
def event_payload(spark, d):
    return event_messages(told(spark, d)).select("block_number", "tx_index", "log_index", "body")


@query(f"""SELECT l.block_number, l.tx_index, log_index, {MESSAGE} CASE WHEN contract = 'c1' AND event = 'Transfer' THEN {RECEIPTS} ELSE '' END || {DATA} AS body
FROM {MESSAGE_ROWS}""")
def payload_receipts(spark, d):
    return event_messages(told(spark, d), ("c1_transfers",)).select("block_number", "tx_index", "log_index", "body")


def moved_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = M.native_transfers(O.txs(spark, d)).select("block_number", "tx_index", "tx_hash", "tx_from", "tx_to", "value")
    rows = C.with_context(rows, attributes(spark, d), ("block_timestamp", *MS.RECEIPT_PAYLOAD)).withColumn("table", F.lit("moves"))
    return MS.transfer_payload(rows, ("moves",))


@query(f"""SELECT block_number, tx_index, '{{"table":"moves","event":"transfer","contract_name":"","contract":"0x' || repeat('0', 40) || '","block_number":' || block_number ||
 ',"block_timestamp":' || block_timestamp || ',"tx_hash":"0x' || tx_hash || '","tx_index":' || tx_index || ',"tx_from":"0x' || tx_from || '"' || {RECEIPTS} ||
 ',"data":{{"from_address":"0x' || tx_from || '","to_address":"0x' || tx_to || '","value":"' || value || '"}}}}' AS body
FROM txs JOIN blocks USING (block_number) WHERE {MOVED}""")
def transfer_payload(spark, d):
    return moved_messages(spark, d).select("block_number", "tx_index", "body")


def call_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = M.call_rows(O.txs(spark, d), functions(spark), 10)
    rows = rows.join(O.blocks(spark, d).select("block_number", "block_timestamp"), "block_number").withColumns(
        {"table": F.concat("contract", F.lit("_calls")), "event": F.col("function"), "contract_address": F.col("tx_to")}
    )
    cols = D.param_columns(CALL.params, D.calldata_body(), {"to": "p_to", "amount": "p_amount"})
    typed = rows.select("block_number", "block_timestamp", "tx_hash", "tx_index", "tx_from", "table", "event", "contract", "contract_address", *cols)
    return MS.payload(typed, MS.data_struct(typed, (("p_to", "to"), ("p_amount", "amount"))), log_index=False)


@query(f"""SELECT block_number, tx_index, '{{"table":"c' || o_orderkey % 12 || '_calls","event":"transfer","contract_name":"c' || o_orderkey % 12 || '","contract":"0x' || tx_to || '","block_number":' || block_number ||
 ',"block_timestamp":' || block_timestamp || ',"tx_hash":"0x' || tx_hash || '","tx_index":' || tx_index || ',"tx_from":"0x' || tx_from || '","data":{{"to":"0x' || lpad(lower(hex(o_custkey)), 40, '0') || '","amount":"' || total_cents || '"}}}}' AS body
FROM txs JOIN blocks USING (block_number) WHERE {CALLED}""")
def call_payload(spark, d):
    return call_messages(spark, d).select("block_number", "tx_index", "body")


@query(f"""SELECT kind, kind_order, block_number, count(*) AS n FROM (
SELECT 'event' AS kind, 0 AS kind_order, block_number FROM logs WHERE contract IS NOT NULL AND event IS NOT NULL
UNION ALL SELECT 'transfer', 1, block_number FROM txs WHERE {MOVED} UNION ALL SELECT 'call', 2, block_number FROM txs WHERE {CALLED}) GROUP BY ALL""")
def unified_messages(spark, d):
    events = event_messages(told(spark, d)).select("block_number", "tx_index", "log_index", "body")
    parts = (df.select("block_number", "tx_index", "body") for df in (moved_messages(spark, d), call_messages(spark, d)))
    return MS.unified(events, *parts).groupBy("kind", "kind_order", "block_number").agg(F.count("body").alias("n"))


def stream_messages(spark: SparkSession, d: str) -> DataFrame:
    e = O.table(spark, d, "events")
    return e.select(F.col("event_type").alias("table"), F.lit("seen").alias("event"), F.col("event_id").alias("position"), (F.col("ts") < "2024-01-16").alias("is_backfill"), F.to_json(F.struct("event_id", "user_id")).alias("body"))


@query("""SELECT 'chain.' || event_type || '.seen' AS topic, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS value FROM events""")
def message_rows(spark, d):
    return MS.message_rows(stream_messages(spark, d), "chain.{table}.{event}")


@query("SELECT event_type || '/seen/' || event_type AS routing_key, count(*) AS n FROM events GROUP BY 1")
def routing_key(spark, d):
    return stream_messages(spark, d).select(MS.routing_key("{table}/{event}/{table}").alias("routing_key")).groupBy("routing_key").agg(F.count("*").alias("n"))


@query("SELECT event_type AS \"table\", event_id AS position FROM events WHERE ts >= TIMESTAMP '2024-01-16'")
def backfill_gate(spark, d):
    return MS.backfill_gate(stream_messages(spark, d), wants_backfill=False).select("table", "position")


@query("SELECT event_id, '0x' || sha256(CAST(event_id AS VARCHAR)) AS digest FROM events")
def hex_render(spark, d):
    return O.table(spark, d, "events").select("event_id", W.hex_text(F.unhex(F.sha2(F.col("event_id").cast("string"), 256))).alias("digest"))


@query("""SELECT event_id, '{"number":"' || user_id || '","even":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"raw":"0x' || lower(hex(event_type)) || '","name":"' || event_type || '"}' AS body FROM events""")
def json_values(spark, d):
    e = O.table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 2 == 0).alias("even"), F.col("event_type").cast("binary").alias("raw"), "event_type")
    return e.select("event_id", F.to_json(MS.data_struct(e, (("user_id", "number"), ("even", "even"), ("raw", "raw"), ("event_type", "name")))).alias("body"))


@query("SELECT DISTINCT upper(substr(event_type, 1, 1)) || substr(event_type, 2) || 'Of' || 'Users' AS name FROM events")
def pascal_case(spark, d):
    return O.table(spark, d, "events").select(W.pascal_case(F.concat("event_type", F.lit("_of_users"))).alias("name")).distinct()


# -- table queries ---------------------------------------------------------------------------


def filtered(where: dict):
    return lambda spark, d: (t := events_table(spark, d)).where(Q.where_clause(where, t.schema)).select("id", "part", "value")


for _name, _where, _sql in (
    ("where_eq", {"part": 77}, "part = 77"),
    ("where_ne", {"flag_ne": "A"}, "flag <> 'A'"),
    ("where_gt", {"value_gt": "5000000"}, "value > 5000000"),
    ("where_gte", {"ref_gte": 50}, "ref >= 50"),
    ("where_lt", {"value_lt": 900000}, "value < 900000"),
    ("where_lte", {"ref_lte": 20, "active": "true"}, "ref <= 20 AND active"),
    ("where_in", {"supp_in": [1, 2, "3"]}, "supp IN (1, 2, 3)"),
    ("where_not_in", {"supp_not_in": [1, 2, 3], "ref_not_in": [4]}, "supp NOT IN (1, 2, 3) AND ref NOT IN (4)"),
    (
        "where_and_or",
        {"value_gt": 100000, "OR": [{"part_lt": 100}, {"AND": [{"flag": "R"}, {"supp_in": [5, 6]}]}, {}], "ref": None},
        "value > 100000 AND (part < 100 OR (flag = 'R' AND supp IN (5, 6)))",
    ),
):
    QUERIES[_name] = filtered(_where)
    ORACLE_SQL[_name] = f"{OVERLAY_SQL} SELECT id, part, value FROM tbl WHERE {_sql}"


def wide(spark: SparkSession, d: str, solidity: str) -> DataFrame:
    """Orders with a number of all 256 bits: decimal text and its sortable key."""
    rows = O.table(spark, d, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("data"))
    out = D.decode_events(rows, (S.Param("amount", solidity),), ("o_orderkey",), keys=True)
    return out.withColumnRenamed("o_orderkey", "id")


WIDE_SQL = "(SELECT o_orderkey AS id, sha256(CAST(o_orderkey AS VARCHAR)) AS w, translate(substr(w, 1, 1), '0123456789abcdef', '89abcdef01234567') || substr(w, 2) AS s FROM orders)"


@query(f"SELECT id FROM {WIDE_SQL} WHERE w > '{(1 << 255) + 12345:064x}' AND w <> '{(1 << 255) + 99999:064x}'")
def where_gt_wide(spark, d):
    t = wide(spark, d, "uint256")
    return t.where(Q.where_clause({"amount_gt": str((1 << 255) + 12345), "amount_ne": (1 << 255) + 99999}, t.schema)).select("id")


@query(f"SELECT id FROM {WIDE_SQL} WHERE s < '{(1 << 255) - (1 << 250):064x}' OR s >= '{(1 << 255) + (1 << 254):064x}'")
def where_lt_wide(spark, d):
    t = wide(spark, d, "int256")
    return t.where(Q.where_clause({"OR": [{"amount_lt": -(1 << 250)}, {"amount_gte": 1 << 254}]}, t.schema)).select("id")


@query(f"SELECT id FROM {WIDE_SQL} WHERE s > '{(1 << 255) - (1 << 254):064x}' AND s < '{(1 << 255) + (1 << 252):064x}'")
def where_beyond_wide(spark, d):
    """Borders with fractions, and borders that no 256-bit number reaches."""
    t = wide(spark, d, "int256")
    inside = {"amount_gt": f"{-(1 << 254)}.25", "amount_gte": f"{1 - (1 << 254)}", "amount_lt": f"{(1 << 252) - 1}.5"}
    beyond = {"amount_lt": 10**80, "amount_gt": f"-1{'0' * 90}", "amount_ne": 10**78, "amount_not_in": [10**79, "0.5"]}
    return t.where(Q.where_clause({**inside, "AND": [beyond], "OR": [{"amount_gt": 10**78}, {"amount_lte": 10**78}]}, t.schema)).select("id")


@query("SELECT id, part, value FROM tbl WHERE value > 4999999 AND value <= 5200000 AND supp <> 7")
def where_fractions(spark, d):
    t = events_table(spark, d)
    where = {"value_gt": "4999999.5", "value_lt": 5200000.5, "supp_ne": 7, "part_ne": 3.5, "supp_not_in": [0.5, 10**30], "ref_in": None, "OR": [{"part": 2.5}, {"part_lt": 1e30}]}
    return t.where(Q.where_clause(where, t.schema)).select("id", "part", "value")


@query(f"SELECT id, row_number() OVER (ORDER BY s DESC, id DESC) AS place FROM {WIDE_SQL} ORDER BY place LIMIT 300")
def order_wide(spark, d):
    page = Q.select_page(wide(spark, d, "int256"), order_by="amount", first=300)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*Q.ordering("amount", "DESC", page.schema))).cast("bigint")).select("id", "place")


@query(f"SELECT id FROM {WIDE_SQL} WHERE w < '{1 << 254:064x}' ORDER BY w DESC, id DESC LIMIT 200")
def page_keyset_wide(spark, d):
    cursor = Q.encode_cursor(str(1 << 254), 0)
    return Q.select_page(wide(spark, d, "uint256"), order_by="amount", first=200, after=cursor).select("id")


def named(spark: SparkSession, d: str) -> DataFrame:
    return O.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name LIKE '%77%' AND c_mktsegment LIKE '%U_L%'")
def where_contains(spark, d):
    t = named(spark, d)
    return t.where(Q.where_clause({"name_contains": "77", "segment_contains": "U_L"}, t.schema)).select("id", "name")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment LIKE 'MACH%'")
def where_starts_with(spark, d):
    t = named(spark, d)
    return t.where(Q.where_clause({"segment_starts_with": "MACH"}, t.schema)).select("id", "name")


@query("SELECT id, ref FROM tbl ORDER BY ref DESC NULLS FIRST, id DESC LIMIT 500")
def order_desc(spark, d):
    return Q.select_page(events_table(spark, d), order_by="ref", direction="DESC", first=500).select("id", "ref")


@query("SELECT id, ref FROM tbl ORDER BY ref ASC NULLS LAST, id ASC LIMIT 500")
def order_asc(spark, d):
    return Q.select_page(events_table(spark, d), order_by="ref", direction="ASC", first=500).select("id", "ref")


@query("SELECT id, value FROM tbl ORDER BY value DESC, id DESC LIMIT 1000")
def top_k(spark, d):
    return Q.select_page(events_table(spark, d), order_by="value", first=5000).select("id", "value")


@query("SELECT id, value FROM tbl ORDER BY value ASC, id ASC LIMIT 50 OFFSET 120")
def page_offset(spark, d):
    return Q.select_page(events_table(spark, d), order_by="value", direction="ASC", first=50, skip=120).select("id", "value")


@query("SELECT id, value FROM tbl WHERE value < 5000000 OR (value = 5000000 AND id < 90194313216000000) ORDER BY value DESC, id DESC LIMIT 100")
def page_keyset(spark, d):
    cursor = Q.encode_cursor(5_000_000, 90_194_313_216_000_000)
    return Q.select_page(events_table(spark, d), order_by="value", after=cursor, skip=9).select("id", "value")


@query("""SELECT max(has_next) AS has_next, arg_min(cursor, id) AS end_cursor, count(*) AS n FROM (
SELECT id, (SELECT count(*) FROM tbl WHERE flag = 'A') > 40 AS has_next, to_base64(encode('{"v":"' || id || '","id":' || id || '}')) AS cursor
FROM tbl WHERE flag = 'A' ORDER BY id DESC LIMIT 40)""")
def page_info(spark, d):
    page = Q.query_table(events_table(spark, d), {"flag": "A"}, first=40)
    return page.rows.agg(F.lit(page.has_next).alias("has_next"), F.lit(page.end_cursor).alias("end_cursor"), F.count("*").alias("n"))


@query("""SELECT id, to_base64(encode('{"v":"' || value || '","id":' || id || '}')) AS cursor FROM tbl""")
def cursor_encode(spark, d):
    t = events_table(spark, d)
    return t.select("id", Q.cursor_column(t, "value").alias("cursor"))


@query("""SELECT id, to_base64(encode('{"v":' || CASE WHEN ref IS NULL THEN 'null' ELSE '"' || ref || '"' END || ',"id":' || id || '}')) AS ref_cursor,
 to_base64(encode('{"v":"0x' || lower(hex(flag)) || '","id":' || id || '}')) AS raw_cursor, to_base64(encode('{"v":"' || CASE WHEN active THEN 'true' ELSE 'false' END || '","id":' || id || '}')) AS bool_cursor FROM tbl""")
def cursor_kinds(spark, d):
    """Cursors of columns with nulls, of bytes and of truth values."""
    t = events_table(spark, d).withColumn("raw", F.col("flag").cast("binary"))
    return t.select("id", *[Q.cursor_column(t, c).alias(n) for c, n in (("ref", "ref_cursor"), ("raw", "raw_cursor"), ("active", "bool_cursor"))])


@query("""SELECT CAST(id AS VARCHAR) AS id, CAST(value AS VARCHAR) AS value, tx_index, active, '0x' || lower(hex(flag)) AS raw FROM tbl""")
def api_projection(spark, d):
    return Q.api_projection(events_table(spark, d).select("id", "value", "tx_index", "active", F.col("flag").cast("binary").alias("raw")))


# -- the whole index -----------------------------------------------------------------------------

TOLD = tuple(
    S.EventSpec(e.contract, e.event, e.selector, e.params, e.table, context=("tx_from", "tx_value") if e.event == "Transfer" else (), include_receipts=e.event == "Approval") for e in EVENTS
)
CHILD = S.EventSpec("child", "Transfer", O.TRANSFER, PARAMS, "child_transfers")
WHOLE = S.IndexSpec(CONTRACTS, (*TOLD, CHILD), (CALL,), (S.TransferSpec("moves", context=("block_timestamp",)),), (FACTORY,))


def followed(spark: SparkSession, d: str):
    """An index of all blocks in four stretches, the second of them delivered
    twice, and after that another fork of the last three blocks, without logs."""
    from chainframes.streaming.follow import Index

    blocks, logs, txs = O.blocks(spark, d).persist(), O.logs(spark, d).persist(), O.txs(spark, d).persist()
    span = blocks.agg(F.min("block_number").alias("a"), F.max("block_number").alias("b")).first()
    top = [r["block_number"] for r in blocks.orderBy(F.desc("block_number")).limit(3).collect()]
    forked = lambda c, has: F.when(has, F.concat(F.lit("x"), c)).otherwise(F.col(c))
    now = blocks.withColumns({"block_hash": forked("block_hash", F.col("block_number").isin(top)), "parent_hash": forked("parent_hash", (F.col("block_number") - 1).isin(top))})
    # where days without orders part the fork from the chain, the chain is asked
    index = Index(spark, SC.working_dir(spark), WHOLE, canonical=lambda: now.select("block_number", "block_hash"))
    step = (span["b"] - span["a"]) // 4 + 1
    stretch = lambda df, i: df.where(F.col("block_number").between(span["a"] + i * step, span["a"] + (i + 1) * step - 1))
    try:
        for epoch, i in enumerate((0, 1, 1, 2, 3)):
            index.process(stretch(blocks, i), stretch(logs, i), epoch, True, stretch(txs, i))
        index.process(now.where(F.col("block_number").isin(top)), logs.limit(0), 5, False, txs.limit(0))
    finally:
        for df in (blocks, logs, txs):
            df.unpersist()
    return index


STAYS = "block_number < (SELECT min(block_number) FROM (SELECT block_number FROM blocks ORDER BY 1 DESC LIMIT 3))"
INDEXED = f"""(SELECT l.*, t.tx_from, t.value AS moved, t.gas, '0x' || lpad(lower(hex(l_partkey)), 40, '0') AS source, '0x' || lpad(lower(hex(l_suppkey)), 40, '0') AS target
 FROM (SELECT l.*, CASE WHEN contract IS NOT NULL THEN contract WHEN created_block IS NOT NULL THEN 'child' END AS owner, coalesce(contract, CAST(l_partkey AS VARCHAR)) AS address
       FROM logs l LEFT JOIN made ON l.contract IS NULL AND child = 65536 + l_partkey AND l_returnflag = 'A' AND l_suppkey % 10 >= 8 AND l.block_number >= created_block) l
 JOIN txs t ON l_orderkey = o_orderkey WHERE event IS NOT NULL AND owner IS NOT NULL AND (owner <> 'child' OR event = 'Transfer') AND l.{STAYS}
 QUALIFY row_number() OVER (PARTITION BY address, l.block_number, l.tx_index, log_index, event ORDER BY source, target, CAST(cents AS VARCHAR)) = 1)"""


@query(f"""SELECT owner || '_' || lower(event) || 's' AS "table", block_number * 4294967296 + tx_index * 65536 + log_index AS id, source AS "from", target AS "to", CAST(cents AS VARCHAR) AS value,
 CASE WHEN event = 'Transfer' AND owner <> 'child' THEN tx_from END AS tx_from, CASE WHEN event = 'Transfer' AND owner <> 'child' THEN CAST(moved AS VARCHAR) END AS tx_value,
 CASE WHEN event = 'Approval' THEN CAST(gas AS BIGINT) END AS tx_gas_used FROM {INDEXED}
UNION ALL SELECT 'moves', block_number * 4294967296 + tx_index * 65536, '0x' || tx_from, '0x' || tx_to, CAST(value AS VARCHAR), NULL, NULL, NULL FROM txs WHERE {MOVED} AND {STAYS}
UNION ALL SELECT 'c0_calls', block_number * 4294967296 + tx_index * 65536, NULL, '0x' || lpad(lower(hex(o_custkey)), 40, '0'), CAST(total_cents AS VARCHAR), NULL, NULL, NULL
 FROM txs WHERE {CALLED} AND o_orderkey % 12 = 0 AND {STAYS}
UNION ALL SELECT '_hashes', block_number, NULL, CASE WHEN {STAYS} THEN '' ELSE 'x' END || block_hash, NULL, NULL, NULL, NULL FROM blocks""")
def index_rows(spark, d):
    """All tables of an index, and its block hashes, after batches, a redelivered
    one and a reorganisation."""
    index = followed(spark, d)
    none = {c: F.lit(None).cast(k) for c, k in (("from", "string"), ("tx_from", "string"), ("tx_value", "string"), ("tx_gas_used", "bigint"))}
    hashes = index.hashes().select(F.lit("_hashes").alias("table"), F.col("block_number").alias("id"), *[v.alias(c) for c, v in none.items()], F.col("block_hash").alias("to"), F.lit(None).cast("string").alias("value"))
    out = hashes
    for e in index.entries():
        rows = index.table(e.table).withColumn("table", F.lit(e.table))
        if isinstance(e, S.TransferSpec):
            rows = rows.select("*", F.concat(F.lit("0x"), "from_address").alias("from"), F.concat(F.lit("0x"), "to_address").alias("to"))
        elif isinstance(e, S.CallSpec):
            rows = rows.withColumnRenamed("amount", "value")
        rows = rows.select("table", "id", *[F.col(c) if c in rows.columns else v.alias(c) for c, v in none.items()], "to", "value")
        out = out.unionByName(rows)
    return out


@query(f"""SELECT 'blocks' AS counter, CAST((SELECT count(*) FROM blocks) + n + 3 AS BIGINT) AS n FROM second
UNION ALL SELECT 'checkpoint', max(block_number) FROM blocks UNION ALL SELECT 'rollbacks', 1
UNION ALL SELECT 'transfers_stored', count(*) FROM txs WHERE {MOVED} UNION ALL SELECT 'calls_stored', count(*) FROM txs WHERE {CALLED} AND o_orderkey % 12 = 0
UNION ALL SELECT 'events_stored', count(*) FROM {INDEXED.replace(f"AND l.{STAYS}", "")} UNION ALL SELECT 'undecodable', 0""".replace("FROM second", """FROM (SELECT count(*) AS n FROM blocks,
 (SELECT min(block_number) AS a, (max(block_number) - min(block_number)) // 4 + 1 AS step FROM blocks) WHERE block_number BETWEEN a + step AND a + 2 * step - 1)"""))
def index_totals(spark, d):
    """What an index observed while its batches ran."""
    index = followed(spark, d)
    c = index.counters
    rows = [(k, getattr(c, k)) for k in ("blocks", "rollbacks", "transfers_stored", "calls_stored", "events_stored")]
    return spark.createDataFrame([*rows, ("checkpoint", index.checkpoint()), ("undecodable", sum(c.undecodable.values()))], "counter string, n bigint")
