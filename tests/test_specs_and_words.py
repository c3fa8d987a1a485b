import pytest
from pyspark.sql import functions as F

from chainframes.functions import words as W
from chainframes.operators import decode as D
from chainframes.plans import specs as S


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        ("_troveId", "trove_id"), ("_L_ETH", "l_eth"), ("amount0Out", "amount0_out"), ("sqrtPriceX96", "sqrt_price_x96"), ("newICR", "new_icr"),
        ("WETH", "weth"), ("a___b", "a_b"), ("value_", "value_"), ("status", "status"), ("tx_status", "param_tx_status"), ("id", "param_id"), ("blockNumber", "param_block_number"), ("tx_from", "param_tx_from"), ("___", ""),
    ],
)
def test_column_names(raw, name):
    assert S.column_name(raw) == name


def test_name_clashes(spark):
    with pytest.raises(S.SpecError):
        S.column_names(["fooBar", "foo_bar"])
    assert S.normalised(spark.range(1).toDF("blockNumber")).columns == ["param_block_number"]
    with pytest.raises(S.SpecError):
        S.identifier("Not a name")


@pytest.mark.parametrize(
    ("solidity", "kind"),
    [
        ("bool", "boolean"), ("uint8", "bigint"), ("uint40", "bigint"), ("uint64", "bigint"), ("uint96", "numeric"), ("uint256", "numeric"), ("uint", "numeric"),
        ("int8", "bigint"), ("int64", "bigint"), ("int128", "numeric"), ("bytes", "bytea"), ("bytes20", "bytea"), ("bytes32", "bytea"), ("string", "text"),
        ("address", "text"), ("(uint256,bool)", "text"),
    ],
)
def test_type_map(solidity, kind):
    assert S.sql_kind(solidity) == kind


def test_topic_literals():
    assert S.topic_literal("uint256", "100").endswith("64") and S.topic_literal("uint256", "0x64") == S.topic_literal("uint256", "100")
    assert S.topic_literal("bool", "true")[-1] == "1" and S.topic_literal("bool", "false")[-1] == "0"
    assert S.topic_literal("address", "0x" + "AB" * 20) == "0" * 24 + "ab" * 20
    assert S.topic_literal("int256", "-1") == "f" * 64 and S.topic_literal("bytes32", "0x" + "1c" * 32) == "1c" * 32
    for solidity, bad in (("address", "0x12"), ("bool", "yes"), ("uint8", "-1"), ("bytes32", "ab")):
        with pytest.raises(S.SpecError):
            S.topic_literal(solidity, bad)


def event(**more):
    return S.EventSpec("c", "Transfer", "ab", (S.Param("from", "address", True), S.Param("value", "uint256")), "t", **more)


def test_schemas_and_context():
    schema = S.table_schema(event(context=("block_timestamp",), include_receipts=True))
    assert schema.fieldNames() == ["id", "block_number", "tx_hash", "tx_index", "log_index", "contract_address", "block_timestamp", "tx_gas_used", "tx_nonce", "cumulative_gas_used", "tx_status", "from", "value", "value_w"]
    assert S.table_key(event()) == ("contract_address", "block_number", "tx_index", "log_index") and S.table_key(S.TransferSpec("t")) == ("block_number", "tx_index")
    with pytest.raises(S.SpecError):
        S.context_fields(event(context=("nope",)))
    with pytest.raises(S.SpecError):
        S.context_fields(event(context=("tx_nonce", "tx_nonce")))


def test_bloom_is_used_for_plain_events_only(spark):
    plain = S.IndexSpec((S.ContractSpec("c", "0x" + "1" * 40, 7), S.ContractSpec("d", None, 3)), (event(),))
    assert plain.bloom_usable() and plain.effective_start() == 3 and plain.effective_start(9) == 9
    assert not S.IndexSpec(plain.contracts, plain.events, transfers=(S.TransferSpec("x"),)).bloom_usable()
    assert not S.IndexSpec((S.ContractSpec("d"),), plain.events).bloom_usable()
    assert {r.contract: r.entries for r in plain.summary(spark).collect()} == {"c": 1}
    assert plain.registry(spark).count() == 1


NUMBERS = [0, 1, 9, 10**9, 2**32 - 1, 2**64 - 1, 2**64, 2**119 + 5, 2**120 - 1, 2**120, 2**128, 10**38, 10**77, 2**255 - 1, 2**255, 2**256 - 1, 123456789 * 10**60]


def test_wide_integers(spark):
    rows = spark.createDataFrame([(f"{n:064x}", n.__str__()) for n in NUMBERS], "w string, n string")
    got = rows.select("n", W.uint_text(F.col("w")).alias("u"), W.int_text(F.col("w")).alias("i"), W.sortable(F.col("w"), True).alias("s")).collect()
    signed = lambda n: n - 2**256 if n >= 2**255 else n
    for r in got:
        assert (r.u, r.i) == (r.n, str(signed(int(r.n))))
    assert [int(r.n) for r in sorted(got, key=lambda r: r.s)] == sorted(NUMBERS, key=signed)


def test_short_integers_wrap(spark):
    words = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    got = spark.createDataFrame([(f"{n:064x}",) for n in words], "w string").select(W.int64(F.col("w")), W.uint64_exact(F.col("w")), W.decimal38(W.uint_text(F.col("w")))).collect()
    assert [r[0] for r in got] == [0, 1, 2**63 - 1, -(2**63), -1]
    assert [int(r[1]) for r in got] == words == [int(r[2]) for r in got]


def encode(data: bytes) -> str:
    return f"{32:064x}{len(data):064x}" + data.hex().ljust(-(-len(data) // 32) * 64, "0")


def test_dynamic_values_and_guards(spark):
    good = ["", "hello", "é" * 40, "x" * 64]
    rows = [(t, encode(t.encode())) for t in good]
    rows += [("!cut", encode(b"hello world")[:130]), ("!far", f"{10**6:064x}" + "0" * 64), ("!huge", "f" * 128), ("!short", "00"), ("!none", None)]
    df = spark.createDataFrame(rows, "t string, data string")
    params = (S.Param("text", "string"),)
    assert [(r.t, r.text) for r in D.decode_events(df, params, ("t",)).collect()] == [(t, t) for t in good]
    assert D.decode_failures(df.withColumn("e", F.lit(1)), params, ("e",)).first().failed == 5
    array = spark.createDataFrame([(f"{32:064x}{0:064x}",), (f"{32:064x}{2:064x}{5:064x}{2**64 - 1:064x}",)], "data string")
    assert [r.a for r in D.decode_events(array, (S.Param("a", "int64[]"),)).collect()] == [[], [5, -1]]


def test_nested_types_and_their_guards(spark):
    w = lambda *n: "".join(f"{x:064x}" for x in n)
    text = lambda t: w(len(t)) + t.encode().hex().ljust(64, "0")
    strings = w(32, 2, 64, 128) + text("ab") + text("c")
    lists = w(32, 3, 96, 192, 224) + w(2, 7, 8) + w(0) + w(1, 9)
    pairs = w(32, 2, 1, 0, 2, 1)
    cases = [
        ("string[]", strings, ["ab", "c"]), ("uint64[][]", lists, [[7, 8], [], [9]]), ("(uint64,bool)[]", pairs, [(1, False), (2, True)]),
        ("uint64[2]", w(5, 6), [5, 6]), ("string[1]", w(32, 32) + text("z"), ["z"]), ("(uint8,(string,bool))", w(32, 4, 64, 64, 1) + text("q"), (4, ("q", True))),
    ]
    for solidity, data, want in cases:
        params = (S.Param("x", solidity),)
        whole = spark.createDataFrame([(data,)], "data string")
        assert whole.select(*D.param_columns(params, F.col("data"))).schema["x"].dataType.simpleString() == S.spark_type(solidity).simpleString()
        plain = lambda v: tuple(map(plain, v)) if isinstance(v, tuple) else list(map(plain, v)) if isinstance(v, list) else v
        assert plain(D.decode_events(whole, params).first().x) == want, solidity
        cut = spark.createDataFrame([(data[:-64],), (data[:64],), ("",), (None,)], "data string").withColumn("e", F.lit(1))
        rest = 0 if solidity != "string[1]" else 0
        assert D.decode_failures(cut, params, ("e",)).first().decoded == rest, solidity
    far = spark.createDataFrame([(w(32, 1 << 28),), (w(32) + "f" * 64,), (w(1 << 28),)], "data string").withColumn("e", F.lit(1))
    assert D.decode_failures(far, (S.Param("x", "uint64[]"),), ("e",)).first().failed == 3
    two = spark.createDataFrame([(w(1, 2, 3, 128) + text("k"),)], "data string")
    got = D.decode_events(two, (S.Param("a", "uint64[2]"), S.Param("b", "uint64"), S.Param("c", "string"))).first()
    assert (got.a, got.b, got.c) == ([1, 2], 3, "k")


def test_decode_golden(spark):
    row = [("ddf2", "11".rjust(64, "1"), "22".rjust(64, "2"), f"{1000000:064x}")]
    df = spark.createDataFrame(row, "topic0 string, topic1 string, topic2 string, data string")
    params = (S.Param("from", "address", True), S.Param("to", "address", True), S.Param("value", "uint256"))
    r = D.decode_events(df, params).first()
    assert (r["from"], r["to"], r["value"]) == ("0x" + "1" * 40, "0x" + "2" * 40, "1000000")
    assert D.decode_events(df.withColumn("topic2", F.lit(None).cast("string")), params).count() == 0
    named = D.decode_events(df, (S.Param("who", "string", True), S.Param("v", "bytes4"))).first()
    assert named.who == bytes.fromhex("1" * 64) and named.v == b"\0" * 4


def test_hex_and_case(spark):
    df = spark.createDataFrame([(bytearray(b"\xde\xad"), "usdc_transfers")], "b binary, n string")
    long = "x" * 12_000
    assert spark.createDataFrame([(f"{long}_y",)], "n string").select(W.pascal_case(F.col("n"))).first()[0] == "X" + long[1:] + "Y"
    assert tuple(df.select(W.hex_text(F.col("b")), W.pascal_case(F.col("n"))).first()) == ("0xdead", "UsdcTransfers")
