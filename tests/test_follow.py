import json

import pytest
from pyspark.sql import functions as F

from chainframes.operators.reorg import ReorgTooDeep
from chainframes.plans import specs as S
from chainframes.streaming.follow import Handler, Index, Sink, StreamGauges, follow, partition_sender, read_blocks

A, FACTORY = "a" * 40, "f" * 40
EVENT = S.EventSpec("c", "E", "e1", (S.Param("who", "address", True), S.Param("value", "uint64")), "moves")
POOL = S.EventSpec("pool", "E", "e1", (S.Param("who", "address", True), S.Param("value", "uint64")), "pools")
SPEC = S.IndexSpec((S.ContractSpec("c", A),), (EVENT, POOL), factories=(S.FactorySpec(FACTORY, "fc", "pool", (S.Param("pool", "address", True),), "pool"),))
LOG = "struct<tx_hash:string,tx_index:int,log_index:int,address:string,topic0:string,topic1:string,data:string>"
SCHEMA = f"block_number long, block_hash string, parent_hash string, arrival int, logs array<{LOG}>"


def log(address, topic0, topic1, value, index=0):
    return ("h", 0, index, address, topic0, topic1.rjust(64, "0"), f"{value:064x}")


def block(n, fork="", value=None, logs=None, parent=None):
    own = logs if logs is not None else [log(A, "e1", "1", n if value is None else value)]
    return (n, f"{fork}{n}", parent if parent is not None else f"{fork}{n - 1}", 0, own)


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, str(tmp_path / "index"), SPEC)


def run(index, spark, rows, epoch, backfill=False):
    df = spark.createDataFrame(rows, SCHEMA)
    logs = df.select("block_number", "block_hash", F.explode("logs").alias("l")).select("block_number", "block_hash", "l.*")
    index.process(df.drop("logs"), logs, epoch, backfill)


def moves(index):
    return {r.block_number: r.value for r in index.table("moves").collect()}


def test_batches_replay_and_reorganisation(spark, index):
    run(index, spark, [block(n) for n in range(10)], 0)
    run(index, spark, [block(n) for n in range(10, 20)], 1)
    assert moves(index) == {n: n for n in range(20)} and index.checkpoint() == 19
    run(index, spark, [block(n) for n in range(10, 20)], 1)  # the same batch again
    assert moves(index) == {n: n for n in range(20)}
    fork = [block(n, "f", 1000 + n, parent=str(n - 1) if n == 17 else None) for n in range(17, 22)]
    run(index, spark, fork, 2)
    assert moves(index) == {n: n for n in range(17)} | {n: 1000 + n for n in range(17, 22)}
    assert {r.block_number: r.block_hash for r in index.hashes().where("block_number > 15").collect()} == {16: "16"} | {n: f"f{n}" for n in range(17, 22)}
    assert [r.ancestor for r in index.rollbacks().collect()] == [16] and index.checkpoint() == 21
    run(index, spark, fork, 2)
    assert index.rollbacks().count() == 1 and len(moves(index)) == 22


def test_the_chain_is_asked_for_a_common_block(spark, tmp_path):
    now = [(n, str(n) if n < 14 else f"f{n}") for n in range(25)]
    index = Index(spark, str(tmp_path / "i"), SPEC, canonical=lambda: spark.createDataFrame(now, "block_number long, block_hash string"))
    run(index, spark, [block(n) for n in range(20)], 0)
    run(index, spark, [block(n, "f", 500 + n) for n in range(18, 22)], 1)
    assert moves(index) == {n: n for n in range(14)} | {n: 500 + n for n in range(18, 22)}
    assert [tuple(r) for r in index.gaps().collect()] == [(14, 17)]


def test_too_deep_changes_nothing(spark, index):
    run(index, spark, [block(n) for n in range(100)], 0)
    with pytest.raises(ReorgTooDeep):
        run(index, spark, [block(n, "x", 5) for n in range(20, 100)], 1)
    assert moves(index) == {n: n for n in range(100)} and index.rollbacks().count() == 0


def test_out_of_order_batches_and_gaps(spark, index):
    run(index, spark, [block(n) for n in range(30, 40)], 0)
    run(index, spark, [block(n) for n in range(10, 20)], 1)
    assert index.checkpoint() == 39 and [tuple(r) for r in index.gaps().collect()] == [(20, 29)]
    run(index, spark, [block(n) for n in range(20, 30)], 2)
    assert index.gaps().count() == 0 and len(moves(index)) == 30


def test_children_from_their_own_batch_on(spark, index):
    child = "c" * 40
    made = [log(FACTORY, "fc", child, 0), log(child, "e1", "2", 7, 1)]
    run(index, spark, [block(1, logs=[log(child, "e1", "2", 5)]), block(2, logs=made)], 0)
    run(index, spark, [block(3, logs=[log(child, "e1", "2", 8)])], 1)
    assert {r.block_number: r.value for r in index.table("pools").collect()} == {2: 7, 3: 8}
    again = Index(spark, index.store.root, SPEC)  # children survive a restart
    run(again, spark, [block(2, "f", logs=[], parent="1"), block(3, "f", logs=[log(child, "e1", "2", 9)])], 2)
    assert again.table("pools").count() == 0 and again.children().count() == 0


def test_sinks(spark, tmp_path):
    seen, live = [], []

    def broken(rows, epoch):
        raise ValueError("no network")

    sinks = [
        Sink("all", lambda rows, epoch: seen.extend(r.body for r in rows.collect())),
        Sink("live", lambda rows, epoch: live.extend(r.body for r in rows.collect()), wants_backfill=False),
        Sink("broken", broken),
        Sink("executors", partition_sender(lambda rows: [None for _ in rows] and None)),
    ]
    handled = []
    index = Index(spark, str(tmp_path / "i"), SPEC, sinks, [Handler("mine", lambda c, e: (c, e) == ("c", "E"), lambda rows, epoch: handled.append((epoch, rows.count())))])
    run(index, spark, [block(1), block(2)], 0, backfill=True)
    run(index, spark, [block(3)], 1)
    assert len(seen) == 3 and len(live) == 1 and handled == [(0, 2), (1, 1)]
    assert '"data":{"who":"0x' + "1".rjust(40, "0") + '","value":"1"}' in seen[0] or '"value":"2"' in seen[0]
    assert [e.split(": ")[1] for e in sinks[2].errors] == ["no network"] * 2 and moves(index) == {1: 1, 2: 2, 3: 3}
    assert sinks[3].errors == []


TX = "block_number long, tx_index int, tx_hash string, tx_from string, tx_to string, value long, success boolean, input string, cumulative_gas_used long, nonce long, tx_type int, max_fee long, tip long"


def test_calls_transfers_context_and_notifications(spark, tmp_path):
    event = S.EventSpec("c", "E", "e1", EVENT.params, "moves", context=("tx_from", "tx_gas_price"), include_receipts=True)
    call = S.CallSpec("c", "pay", "aabbccdd", (S.Param("amount", "uint256"),), "calls")
    spec = S.IndexSpec((S.ContractSpec("c", A),), (event,), (call,), (S.TransferSpec("paid", context=("block_timestamp",)),))
    bodies, blocks_told = [], []
    sinks = [Sink("rows", lambda rows, epoch: bodies.extend(r.body for r in rows.orderBy("table").collect())), Sink("blocks", notify=lambda rows, epoch: blocks_told.extend(r.body for r in rows.collect()))]
    index = Index(spark, str(tmp_path / "i"), spec, sinks)
    txs = spark.createDataFrame(
        [
            (1, 0, "t0", "9" * 40, A, 7, True, "aabbccdd" + f"{2**200:064x}", 100, 3, 2, 50, 1),
            (1, 1, "t1", "8" * 40, None, 5, True, "", 130, 0, 0, 10, 0),
            (1, 2, "t2", "8" * 40, A, 5, False, "aabbccdd" + "0" * 64, 150, 0, 0, 10, 0),
        ],
        TX,
    )
    blocks = spark.createDataFrame([(1, "b1", "b0", 1700, 20, 3), (2, "b2", "b1", 1712, 20, 1)], "block_number long, block_hash string, parent_hash string, block_timestamp long, base_fee long, receipts int")
    logs = spark.createDataFrame([(1, "b1", *log(A, "e1", "1", 4)), (2, "b2", *log(A, "e1", "1", 6))], "block_number long, block_hash string, " + LOG.removeprefix("struct<").removesuffix(">").replace(":", " "))
    with pytest.raises(ValueError):
        index.process(blocks, logs, 0)
    index.process(blocks, logs, 0, txs=txs)
    assert [(r.block_number, r.tx_from, r.tx_gas_price, r.tx_gas_used, r.tx_nonce, r.tx_status, r.value) for r in index.table("moves").collect()] == [(1, "9" * 40, 21, 100, 3, True, 4)]
    assert [(r.tx_index, r.amount) for r in index.table("calls").collect()] == [(0, str(2**200))]
    assert [(r.tx_hash, r.to_address, r.value, r.block_timestamp) for r in index.table("paid").collect()] == [("t0", A, "7", 1700)]
    found = {j["table"]: j for j in map(json.loads, bodies)}
    assert found["calls"]["contract"] == "0x" + A and found["calls"]["data"] == {"amount": str(2**200)} and "log_index" not in found["calls"] and "gas_used" not in found["calls"]
    assert found["moves"]["gas_used"] == 100 and found["moves"]["tx_value"] == "7" and found["moves"]["block_timestamp"] == 1700 and found["moves"]["contract_name"] == "c"
    assert found["paid"]["data"] == {"from_address": "0x" + "9" * 40, "to_address": "0x" + A, "value": "7"}
    told = json.loads(blocks_told[0])
    assert len(blocks_told) == 1 and {(t["name"], t["count"]) for t in told["tables"]} == {("moves", 1), ("calls", 1), ("paid", 1)} and told["block_timestamp"] == 1700


def test_stream_of_files(spark, tmp_path):
    source, schema = str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema
    index = Index(spark, str(tmp_path / "index"), SPEC)
    metrics = StreamGauges()
    spark.streams.addListener(metrics)

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def catch_up():
        query = follow(index, read_blocks(spark, source, schema), str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None

    arrive([block(n) for n in range(5)])
    arrive([block(n) for n in range(5, 9)])
    catch_up()
    assert moves(index) == {n: n for n in range(9)}
    arrive([block(n, "f", 50 + n, parent="6" if n == 7 else None) for n in (7, 8, 9)])
    catch_up()
    assert moves(index) == {n: n for n in range(7)} | {n: 50 + n for n in (7, 8, 9)}
    assert metrics.failed == 0 and (metrics.batches == 0 or metrics.input_rows > 0)
    spark.streams.removeListener(metrics)


def test_last_arrival_of_a_block_counts(spark, index):
    old, new = block(1), block(1, "f", 99)
    rows = [old, (*new[:3], 1, new[4])]
    run(index, spark, rows, 0)
    assert moves(index) == {1: 99}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reading_is_a_plain_scan(spark, index):
    run(index, spark, [block(n) for n in range(10)], 0)
    run(index, spark, [block(n) for n in range(10, 20)], 1)
    run(index, spark, [block(n, "f", 1000 + n, parent="17" if n == 18 else None) for n in range(18, 22)], 2)
    rows = index.table("moves").where("block_number > 12 and value > 3")
    text = plan(rows)
    assert "Aggregate" not in text and "Exchange" not in text and "Join" not in text and "GreaterThan(value,3)" in text
    assert rows.count() == 9 and len(index.table("moves", 19, 21).inputFiles()) < len(index.table("moves").inputFiles())


def test_redelivered_rows_are_left_out_when_written(spark, index):
    run(index, spark, [block(1), block(2)], 0)
    again = [log(A, "e1", "1", 77), log(A, "e1", "1", 88), log(A, "e1", "1", 5, 1), log(A, "e1", "1", 6, 1)]
    run(index, spark, [block(2, logs=again), block(3)], 1)
    assert sorted((r.block_number, r.log_index, r.value) for r in index.table("moves").collect()) == [(1, 0, 1), (2, 0, 2), (2, 1, 5), (3, 0, 3)]
    assert sorted(r.block_number for r in index.hashes().collect()) == [1, 2, 3]
    assert index.counters.stored == {"moves": 4} and index.counters.events_matched == 7


def test_units_are_merged_and_old_ones_deleted(spark, tmp_path, monkeypatch):
    from chainframes.streaming import store

    monkeypatch.setattr(store, "TIER", 3)
    index = Index(spark, str(tmp_path / "i"), SPEC)
    for n in range(14):
        run(index, spark, [block(n, logs=[log(FACTORY, "fc", f"{n:040x}", 0), log(A, "e1", "1", n, 1)])], n)
    m = index.manifest()
    assert [u.level for u in m.units] == [2, 1, 0, 0] and m.checkpoint == 13 and m.runs == ((0, 13),) and [u.blocks for u in m.units] == [9, 3, 1, 1]
    assert moves(index) == {n: n for n in range(14)} and index.children().count() == 14 and index.gaps().count() == 0
    assert len(index.store.names("_manifest")) <= store.KEPT_MANIFESTS and len(index.store.names("data")) < 14
    run(index, spark, [block(n) for n in (3, 4)], 3)  # merged long ago
    assert moves(index) == {n: n for n in range(14)}
    run(index, spark, [block(12, "f", 50, parent="11")], 14)
    assert moves(index) == {n: n for n in range(12)} | {12: 50} and index.checkpoint() == 12
    assert Index(spark, index.store.root, SPEC).children().count() == 12


def test_manifest_of_a_thousand_epochs(tmp_path, spark):
    from dataclasses import replace

    from chainframes.streaming.store import TIER, Manifest, Store, Unit

    store = Store(spark, str(tmp_path / "s"))
    store._merge = lambda m, at, group, schemas, blocks: replace(m, units=(*m.units[:at], Unit(group[0].name, group[0].low, group[-1].high, sum(u.blocks for u in group), level=group[0].level + 1), *m.units[at + TIER :]))
    m = Manifest()
    for n in range(1000):
        m = store.merge(replace(m.with_epoch(str(n)), units=(*m.units, Unit(f"epoch-{n}", n, n, 1))), {}, {})
        assert len(m.units) < 3 * TIER
    assert sum(u.blocks for u in m.units) == 1000 and m.runs == ((0, 999),) and m.done("5") and not m.done("1000")


def test_a_second_writer_fails(spark, index):
    from chainframes.streaming.store import ConcurrentCommit

    run(index, spark, [block(1)], 0)
    old = index.manifest()
    run(index, spark, [block(2)], 1)
    with pytest.raises(ConcurrentCommit):
        index.store.commit(old)
    assert moves(index) == {1: 1, 2: 2}


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    def fail(rows, epoch):
        rows.count()
        raise ValueError("not yet")

    handler = Handler("h", lambda c, e: True, fail)
    index = Index(spark, str(tmp_path / "i"), SPEC, handlers=[handler])
    with pytest.raises(ValueError):
        run(index, spark, [block(1), block(2)], 0)
    assert moves(index) == {} and index.checkpoint() == 0
    handler.handle = None
    run(index, spark, [block(1)], 0)
    assert moves(index) == {1: 1}


def test_counters_are_observed(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), SPEC)
    short = ("h", 0, 3, A, "e1", "1".rjust(64, "0"), "00")
    run(index, spark, [block(1, logs=[log(A, "e1", "1", 5), short, log("d" * 40, "e1", "1", 5, 4)]), block(2), block(3, logs=[])], 0)
    c = index.counters
    assert (c.blocks, c.events_matched, c.events_stored, c.indexed_block, c.head) == (3, 3, 2, 3, 3)
    assert c.undecodable == {"moves": 1} and c.stored == {"moves": 2} and c.ready
    c.head = 9
    assert not c.ready
    run(index, spark, [block(3, "f", logs=[], parent="2"), block(4, "f")], 1)
    assert c.rollbacks == 1 and c.blocks == 5 and index.table("moves").count() == 3


def test_handlers_see_rollbacks_and_derive_tables(spark, tmp_path):
    log_, schema = [], spark.createDataFrame([], "block_number long, double long").schema
    handlers = [
        Handler("watch", lambda c, e: c == "c", lambda rows, epoch: log_.append(("rows", epoch, rows.count())), lambda last, epoch: log_.append(("back", epoch, last))),
        Handler("doubled", lambda c, e: e == "E", derive=lambda rows: rows.selectExpr("block_number", "value * 2 AS double"), schema=schema),
    ]
    index = Index(spark, str(tmp_path / "i"), SPEC, handlers=handlers)
    run(index, spark, [block(n) for n in range(5)], 0)
    run(index, spark, [block(n, "f", 10 * n, parent="2" if n == 3 else None) for n in (3, 4, 5)], 1)
    assert log_ == [("rows", 0, 5), ("back", 1, 2), ("rows", 1, 3)]
    assert {r.block_number: r.double for r in index.table("doubled").collect()} == {0: 0, 1: 2, 2: 4, 3: 60, 4: 80, 5: 100}


def test_gaps_are_refilled(spark, tmp_path):
    asked = []

    def refill(first, last):
        asked.append((first, last))
        df = spark.createDataFrame([block(n) for n in range(first, last + 1)], SCHEMA)
        return df.drop("logs"), df.select("block_number", "block_hash", F.explode("logs").alias("l")).select("block_number", "block_hash", "l.*"), None

    index = Index(spark, str(tmp_path / "i"), SPEC, refill=refill)
    run(index, spark, [block(n) for n in range(5)], 0)
    run(index, spark, [block(n) for n in (12, 13, 15)], 1)
    assert sorted(asked) == [(5, 11), (14, 14)] and index.gaps().count() == 0 and moves(index) == {n: n for n in range(16)}
    assert not index.manifest().holes
    asked.clear()
    run(index, spark, [block(n) for n in range(16, 18)], 2)
    assert asked == [] and index.repair() == 0


def test_tables_are_views(spark, index):
    assert index.register("ix_") == ["ix_moves", "ix_pools"] and spark.table("ix_moves").count() == 0
    run(index, spark, [block(1), block(2)], 0)
    index.register("ix_")
    assert [r.v for r in spark.sql("SELECT sum(value) AS v FROM ix_moves").collect()] == [3] and spark.table("ix_pools").count() == 0
    for name in ("ix_moves", "ix_pools"):
        spark.catalog.dropTempView(name)


def test_reset(spark, index):
    run(index, spark, [block(1), block(2)], 0)
    index.reset()
    assert moves(index) == {} and index.checkpoint() == 0 and index.counters.blocks == 0
    run(index, spark, [block(1, value=9)], 0)
    assert moves(index) == {1: 9}


B = "b" * 40


def bloom(*addresses):
    from chainframes.functions.keccak import bloom_positions

    out = bytearray(256)
    for a in addresses:
        for bit in bloom_positions(a):
            out[255 - bit // 8] |= 1 << bit % 8
    return bytes(out)


def test_blocks_are_pruned_by_their_bloom(spark, tmp_path):
    plain_spec = S.IndexSpec((S.ContractSpec("c", A),), (EVENT,))
    # the second block's bloom does not hold A, though a log of A stands there: it is not read
    rows = [(*block(n), bloom(A) if n % 3 == 0 else bloom(B)) for n in range(1, 10)]
    df = spark.createDataFrame(rows, SCHEMA + ", logs_bloom binary")

    def go(name, spec):
        from chainframes.streaming.follow import nested

        index = Index(spark, str(tmp_path / name), spec)
        own, logs, _ = nested(index, df)
        index.process(own, logs, 0)
        whole = df.select("block_number", "block_hash", F.explode("logs").alias("l")).select("block_number", "block_hash", "l.*")
        flat = Index(spark, str(tmp_path / f"{name}-flat"), spec)
        flat.process(df.drop("logs"), whole, 0)
        assert moves(index) == moves(flat)
        return index

    pruned = go("plain", plain_spec)
    assert moves(pruned) == {3: 3, 6: 6, 9: 9} and pruned.counters.pruned_blocks == 6 and pruned.hashes().count() == 9
    assert moves(go("factory", SPEC)) == {n: n for n in range(1, 10)}


def test_one_pass_over_the_logs_for_all_entries(spark, tmp_path):
    events = tuple(S.EventSpec("c", f"E{i}", f"e{i}", EVENT.params, f"t{i}", topic_filters=((1, ("1".rjust(64, "0"),)),) if i == 1 else ()) for i in range(29))
    twice = S.EventSpec("c", "E1", "e1", EVENT.params, "copy")
    other = S.EventSpec("c", "E2", "e2", (S.Param("who", "address", True), S.Param("value", "uint8"), S.Param("hashed", "string", True)), "other")
    index = Index(spark, str(tmp_path / "i"), S.IndexSpec((S.ContractSpec("c", A),), (*events, twice, other)))
    path = str(tmp_path / "logs")
    rows = [(n, f"{n}", *log(A, f"e{n % 31}", "1" if n % 2 else "2", n)) for n in range(62)]
    flat = "block_number long, block_hash string, " + LOG.removeprefix("struct<").removesuffix(">").replace(":", " ")
    spark.createDataFrame(rows, flat).withColumn("topic2", F.lit(None).cast("string")).coalesce(1).write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    logs = spark.read.parquet(path)
    blocks = spark.createDataFrame([(n, f"{n}", f"{n - 1}") for n in range(62)], "block_number long, block_hash string, parent_hash string")
    index.process(blocks, logs.mapInArrow(counted, logs.schema), 0)
    assert read.value == 62
    assert index.table("t1").count() == 1 and index.table("copy").count() == 2 and index.table("t5").count() == 2 and index.table("other").count() == 0
    assert index.counters.undecodable == {"other": 2}


def test_ranges_of_blocks_across_a_restart(spark, tmp_path):
    from chainframes.streaming.follow import follow_ranges, table_reader

    flat = "block_number long, block_hash string, " + LOG.removeprefix("struct<").removesuffix(">").replace(":", " ")
    blocks, logs = str(tmp_path / "blocks"), str(tmp_path / "logs")
    spark.createDataFrame([(n, f"{n}", f"{n - 1}") for n in range(100)], "block_number long, block_hash string, parent_hash string").write.parquet(blocks)
    spark.createDataFrame([(n, f"{n}", *log(A, "e1", "1", n)) for n in range(100)], flat).write.parquet(logs)
    head, checkpoint = tmp_path / "head", str(tmp_path / "checkpoint")
    head.write_text("24")
    sizes = []
    read = table_reader(spark, blocks, logs)

    def noted(first, last):
        sizes.append((first, last))
        return read(first, last)

    def until(index, last, **options):
        query = follow_ranges(index, noted, checkpoint, start=3, head=str(head), max_blocks=10, seconds=0.1, **options)
        for _ in range(600):
            if index.checkpoint() >= last or query.exception() is not None:
                break
            query.awaitTermination(0.2)
        query.stop()
        assert query.exception() is None

    index = Index(spark, str(tmp_path / "index"), SPEC)
    until(index, 24)
    assert sizes == [(3, 12), (13, 22), (23, 24)] and moves(index) == {n: n for n in range(3, 25)}
    head.write_text("60")
    again = Index(spark, index.store.root, SPEC)
    until(again, 41, end=41)
    assert all(b - a < 10 for a, b in sizes) and sizes[3][0] == 25 and max(b for _, b in sizes) == 41
    assert moves(again) == {n: n for n in range(3, 42)} and again.counters.head == 60 and again.gaps().count() == 0
