import pytest
from pyspark.sql import functions as F

from chainframes.functions import words as W
from chainframes.functions.keccak import bloom_positions, call_selector, keccak256, selector
from chainframes.operators import match as M
from chainframes.plans import specs as S


def test_hashes():
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"abc").hex() == "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert selector("Transfer(address,address,uint256)") == "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert selector("Approval(address,address,uint256)") == "8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"
    assert call_selector("transfer(address,uint256)") == "a9059cbb"
    assert len({keccak256(b"x" * n) for n in (0, 1, 134, 135, 136, 137, 271, 272, 273)}) == 9


def test_positions_in_a_bloom():
    address = "0x095e7baea6a6c7c4c2dfeb977efac326af552d87"
    digest = keccak256(bytes.fromhex(address[2:]))
    assert bloom_positions(address) == bloom_positions(address.upper().replace("X", "x")) == tuple((digest[i] << 8 | digest[i + 1]) & 0x7FF for i in (0, 2, 4))
    # a published header bloom with this address alone sets bits in these bytes
    out = bytearray(256)
    for bit in bloom_positions(address):
        out[255 - bit // 8] |= 1 << bit % 8
    assert sum(bin(b).count("1") for b in out) == 3


def test_spec_names_bits_of_its_addresses(spark):
    spec = S.IndexSpec((S.ContractSpec("a", "0x" + "11" * 20), S.ContractSpec("zero", "0x" + "0" * 40), S.ContractSpec("child")), (S.EventSpec("a", "E", "e", (), "t"),))
    assert spec.bloom_usable() and spec.bloom_bits() == [bloom_positions("11" * 20)]
    assert not S.IndexSpec((S.ContractSpec("zero", "0x" + "0" * 40),), spec.events).bloom_usable()
    with pytest.raises(ValueError):
        bloom_positions("0xzz")


def test_numbers_become_words(spark):
    numbers = [0, 1, 255, 2**32 - 1, 2**32, 2**63, 2**64 - 1, 2**64, 2**96 + 7, 10**38 - 1]
    df = spark.createDataFrame([(str(n),) for n in numbers], "n string")
    assert [int(r[0], 16) for r in df.select(W.number_word(F.col("n"))).collect()] == numbers


def test_factories_are_met_in_one_join(spark):
    logs = spark.createDataFrame(
        [(1, 0, 0, "a" * 40, "f1", "0" * 24 + "1" * 40, ""), (2, 0, 0, "b" * 40, "f2", None, "0" * 64 + "0" * 24 + "2" * 40), (2, 0, 1, "b" * 40, "f1", "0" * 24 + "3" * 40, ""), (3, 0, 0, "a" * 40, "f1", "0" * 24 + "1" * 40, "")],
        "block_number long, tx_index int, log_index int, address string, topic0 string, topic1 string, data string",
    )
    specs = [S.FactorySpec("a" * 40, "f1", "one", (S.Param("x", "address", True),), "x"), S.FactorySpec("b" * 40, "f2", "two", (S.Param("n", "uint8"), S.Param("x", "address")), "x")]
    found = M.factory_children(logs, specs)
    assert sorted(map(tuple, found.collect())) == [("one", "1" * 40, 1), ("two", "2" * 40, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
