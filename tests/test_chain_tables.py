import re

from chainframes.operators.context import context, with_context
from chainframes.operators.flatten import with_gas_used
from chainframes.sources import chain as CH
from chainframes.sources import overlay as O
from chainframes.sources import scan as SC

SF = "/root/testdata/sf0.001"


def test_logs_meet_their_transactions_without_a_shuffle(spark):
    names = {"blocks": O.blocks, "txs": O.txs, "logs": O.logs}
    for name, make in names.items():
        CH.write_chain_table(make(spark, SF), f"chain_{name}", 4)
    try:
        blocks, txs, logs = (CH.chain_range(spark, f"chain_{n}", 21_000_100, 21_001_500) for n in names)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            with CH.meeting_by_block(spark):
                told = with_context(logs.select("block_number", "tx_index", "log_index", "cents"), context(blocks, with_gas_used(txs)), ("tx_from", "tx_gas_used", "block_timestamp"))
                plan = told._jdf.queryExecution().executedPlan().toString()
                got = sorted(map(tuple, told.collect()))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and re.search(r"PartitionFilters: \[isnotnull\(block_bucket", plan)
        plain = [SC.block_range(make(spark, SF), 21_000_100, 21_001_500) for make in names.values()]
        want = with_context(plain[2].select("block_number", "tx_index", "log_index", "cents"), context(plain[0], with_gas_used(plain[1])), ("tx_from", "tx_gas_used", "block_timestamp"))
        assert got == sorted(map(tuple, want.collect())) and got
    finally:
        for name in names:
            spark.sql(f"DROP TABLE chain_{name}")
