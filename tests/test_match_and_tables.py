import pytest
from pyspark.sql import functions as F

from chainframes.operators import flatten as FL
from chainframes.operators import match as M
from chainframes.operators import messages as MS
from chainframes.operators import reorg as R
from chainframes.operators import tables as T
from chainframes.plans import specs as S
from chainframes.sources import scan as SC

A, B = "a" * 40, "b" * 40
LOG = "block_number long, tx_index int, log_index int, address string, topic0 string, topic1 string, topic2 string, data string"


def word(x):
    return x.rjust(64, "0")


def test_only_the_right_log_matches(spark):
    spec = S.EventSpec("c", "E", "e1", (), "t")
    logs = spark.createDataFrame([(1, 0, 0, A, "e1", None, None, ""), (1, 0, 1, B, "e1", None, None, ""), (1, 0, 2, A, "e2", None, None, ""), (1, 0, 3, A, None, None, None, "")], LOG)
    registry = spark.createDataFrame([(A, "c")], "address string, contract string")
    assert [r.log_index for r in M.event_logs(logs, registry, spec, 1).collect()] == [0]
    assert FL.drop_anonymous(logs).count() == 3


def test_topic_filters_and_within_or(spark):
    logs = spark.createDataFrame([(1, 0, 0, A, "e", word("1"), word("9"), ""), (1, 1, 0, A, "e", word("1"), word("2"), ""), (1, 2, 0, A, "e", word("1"), None, ""), (1, 3, 0, A, "e", word("5"), word("3"), "")], LOG)
    spec = S.EventSpec("c", "E", "e", (), "t", topic_filters=((1, (word("1"), word("5"))), (2, (word("2"), word("3")))))
    assert sorted(r.tx_index for r in logs.where(M.topic_filter(spec)).collect()) == [1, 3]


def test_factory_children(spark):
    factory = S.FactorySpec("0x" + A, "fc", "pool", (S.Param("pool", "address", True),), "pool")
    logs = spark.createDataFrame([(12369700, 0, 0, A, "fc", word("8ad5"), None, ""), (12369800, 0, 0, A, "fc", word("8ad5"), None, ""), (12369800, 0, 1, B, "fc", word("1"), None, "")], LOG)
    got = M.factory_children(logs, [factory]).collect()
    assert [(r.contract, r.address, r.created_block) for r in got] == [("pool", "8ad5".rjust(40, "0"), 12369700)]
    inside = S.FactorySpec(A, "fc", "pool", (S.Param("x", "uint256"), S.Param("pool", "address")), "pool")
    body = logs.withColumn("data", F.lit(word("7") + word("8ad5")))
    assert M.factory_children(body, [inside]).first().address == "8ad5".rjust(40, "0")
    with pytest.raises(S.SpecError):
        S.FactorySpec(A, "fc", "pool", (S.Param("x", "uint256"),), "x").word()


def test_bloom(spark):
    bits = {A: (0, 9, 2047), B: (1, 9, 2000)}

    def bloom(*who):
        out = bytearray(256)
        for w in who:
            for b in bits[w]:
                out[255 - b // 8] |= 1 << b % 8
        return bytes(out)

    blocks = spark.createDataFrame([(1, bloom(A)), (2, bloom(B)), (3, bloom()), (4, bloom(A, B)), (5, None)], "block_number long, logs_bloom binary")
    assert [r.block_number for r in M.bloom_blocks(blocks, [bits[A]]).collect()] == [1, 4]
    assert [r.block_number for r in M.bloom_blocks(blocks, [bits[A], bits[B]]).collect()] == [1, 2, 4]
    assert M.bloom_blocks(blocks, []).count() == 0


def test_gas_used(spark):
    txs = spark.createDataFrame([(1, 0, 50000), (1, 1, 120000), (1, 2, 200000), (2, 0, 7), (3, 0, 9), (3, 1, 5)], "block_number long, tx_index int, cumulative_gas_used long")
    assert sorted((r.block_number, r.tx_index, r.gas_used) for r in FL.with_gas_used(txs).collect()) == [(1, 0, 50000), (1, 1, 70000), (1, 2, 80000), (2, 0, 7), (3, 0, 9), (3, 1, 0)]


def test_mismatched_blocks_go(spark):
    nested = spark.createDataFrame(
        [(1, [("h",)], [(True, 1, [("x",)]), (True, 1, [])]), (2, [("h",), ("i",)], [(True, 1, [("y",), ("z",)]), (True, 1, [("w",)])])],
        "block_number long, transactions array<struct<tx_hash:string>>, receipts array<struct<success:boolean,cumulative_gas_used:long,logs:array<struct<data:string>>>>",
    )
    assert [tuple(r) for r in FL.flatten_logs(nested).collect()] == [(2, "h", 0, 0, "y"), (2, "h", 0, 1, "z"), (2, "i", 1, 0, "w")]


def test_append_twice_adds_once(spark):
    rows = spark.createDataFrame([(1, 0, "x"), (1, 0, "y"), (2, 0, "z")], "block_number long, tx_index int, v string")
    empty = rows.limit(0)
    once = T.new_rows(rows, empty, ["block_number", "tx_index"], ["v"])
    assert sorted(r.v for r in once.collect()) == ["x", "z"]
    assert T.new_rows(rows, once, ["block_number", "tx_index"], ["v"]).count() == 0


def test_hidden_rows_are_found_without_a_nested_loop(spark):
    rows = spark.createDataFrame([(e, b) for e in range(6) for b in range(8)], "epoch long, block_number long")
    back = spark.createDataFrame([(2, 5), (4, 3), (4, 3), (5, 6), (9, 7)], "epoch long, ancestor long")
    shown = T.visible(rows, back)
    want = [(e, b) for e in range(6) for b in range(8) if not any(r > e and b > a for r, a in ((2, 5), (4, 3), (5, 6), (9, 7)))]
    assert sorted(map(tuple, shown.collect())) == want
    assert "NestedLoop" not in shown._jdf.queryExecution().executedPlan().toString()
    assert T.visible(rows, back.limit(0)).count() == 48


def test_tables_are_made_and_made_anew(spark):
    spec = S.EventSpec("c", "E", "e", (S.Param("v", "uint64"),), "made")
    T.recreate_table(spark, "made", S.table_schema(spec))
    T.create_table(spark, "made", S.table_schema(spec))
    assert spark.table("made").columns[-3:] == ["v", "block_bucket", "epoch"] and spark.table("made").count() == 0
    T.recreate_table(spark, "made", S.table_schema(S.TransferSpec("made")))
    assert "value" in spark.table("made").columns
    spark.sql("DROP TABLE made")


def test_resume(spark):
    rows = lambda *b: spark.createDataFrame([(i, x) for i, x in enumerate(b)], "epoch long, max_block long")
    left = lambda p, a, b: [tuple(r) for r in SC.resume_range(p, a, b).collect()]
    assert left(rows(), 10, 20) == [(10, 20)] and left(rows(5), 10, 20) == [(10, 20)]
    assert left(rows(15, 12), 10, 20) == [(16, 20)] and left(rows(20), 10, 20) == [] and left(rows(0), 0, 3) == [(1, 3)]
    assert T.checkpoint(rows(100, 50)).first()[0] == 100
    back = spark.createDataFrame([(2, 12)], "epoch long, ancestor long")
    assert T.checkpoint(rows(10, 15), back).first()[0] == 12 and T.checkpoint(rows(10, 15, 14), back).first()[0] == 14
    assert [tuple(r) for r in SC.resume_range(rows(10, 15), 0, 20, back).collect()] == [(13, 20)]
    assert SC.meta_block(rows(9, 5), back).first()[0] == "9" and SC.meta_block(rows(), back).first()[0] is None


def test_reorg_operators(spark):
    chain = lambda d: spark.createDataFrame(list(d.items()), "block_number long, block_hash string")
    stored = chain({i: f"h{i}" for i in range(100)})
    now = chain({i: f"h{i}" if i < 97 else "x" for i in range(100)})
    assert R.require_ancestor(stored, now, 99) == 96
    with pytest.raises(R.ReorgTooDeep):
        R.require_ancestor(stored, chain({i: "x" for i in range(20, 100)}), 99)
    status = {r.block_number: r.status for r in R.reorg_status(stored.where("block_number > 1"), chain({1: "h1", 2: "h2", 3: "x", 4: None})).collect()}
    assert status == {1: "unknown", 2: "same", 3: "reorg", 4: "inconclusive"}
    assert [tuple(r) for r in R.block_gaps(chain({1: "", 2: "", 5: "", 2500: ""}), span=10).collect()] == [(3, 4), (6, 2499)]
    assert R.block_gaps(chain({1: ""})).count() == 0
    head = R.head_gap(chain({7: ""}), spark.createDataFrame([(5,)], "max_block long")).first()
    assert (head["head"], head.next_block, head.gap, head.ready) == (7, 6, 2, True)


def test_messages(spark):
    df = spark.createDataFrame([("t", "e", 1)], "table string, event string, n long")
    keys = [df.select(MS.routing_key(p)).first()[0] for p in ("{table}.{event}", "fixed", "only.{table}")]
    assert keys == ["t.e", "fixed", "only.t"]
    values = spark.createDataFrame([("0xab", 1000000, True, bytearray(b"\xde\xad"), "hello")], "a string, n long, b boolean, x binary, s string")
    body = values.select(F.to_json(MS.data_struct(values, [(c, c) for c in values.columns]))).first()[0]
    assert body == '{"a":"0xab","n":"1000000","b":true,"x":"0xdead","s":"hello"}'
    moved = spark.createDataFrame([("t", 1, 2, "h", 0, "a", "b", 5)], "table string, block_number long, block_timestamp long, tx_hash string, tx_index int, tx_from string, tx_to string, value long")
    body = MS.transfer_payload(moved).first().body
    zero = "0x" + "0" * 40
    assert body == f'{{"table":"t","event":"transfer","contract_name":"","contract":"{zero}","block_number":1,"block_timestamp":2,"tx_hash":"0xh","tx_index":0,"tx_from":"0xa","data":{{"from_address":"0xa","to_address":"0xb","value":"5"}}}}'


def test_block_range_prunes_buckets(spark, tmp_path):
    df = spark.range(0, 500_000, 1000).select(F.col("id").alias("block_number")).withColumn("block_bucket", SC.bucket(F.col("block_number")))
    df.write.partitionBy("block_bucket").parquet(str(tmp_path / "b"))
    got = SC.read_range(spark, str(tmp_path / "b"), 150_000, 160_000)
    assert got.count() == 11 and len(got.inputFiles()) >= 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_bucket" in plan
