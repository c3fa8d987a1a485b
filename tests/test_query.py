from decimal import Decimal

import pytest

from chainframes.plans import query as Q

SCHEMA = "id long, block_number long, tx_hash binary, tx_index int, from_address string, value decimal(38,0), active boolean"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, 100 + i // 3, bytes([i]), i % 3, f"0x{'ab' if i % 2 else 'cd'}{i}", None if i % 5 == 0 else Decimal(i * 10), i % 2 == 0) for i in range(1, 31)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r.id for r in df.collect()]


def test_keys():
    columns = ["value", "value_in", "from_address"]
    assert Q.split_key("value_in", columns) == ("value", "in") and Q.split_key("value_in_in", columns) == ("value_in", "in")
    assert Q.split_key("value_gte", columns) == ("value", "gte") and Q.split_key("value_not_in", columns) == ("value", "not_in")
    assert Q.split_key("from_address_starts_with", columns) == ("from_address", "starts_with")
    for bad in ("nope", "nope_gt", "value_like"):
        with pytest.raises(Q.QueryError):
            Q.split_key(bad, columns)


def test_filters(table):
    found = lambda **w: sorted(ids(table.where(Q.where_clause(w, table.schema))))
    assert found(tx_hash="0x05") == [5] and found(tx_hash_in=["05", "0x06"]) == [5, 6]
    assert found(from_address_contains="cd1") == [10, 12, 14, 16, 18] and found(active="true", block_number_lt=102) == [2, 4]
    assert found(value_in=[]) == [] and len(found(value_not_in=[])) == 30
    assert found(OR=[{"block_number": 100}, {"value_gt": "290"}]) == [1, 2] and found(AND=[{}], OR=[]) == list(range(1, 31))
    assert found(value_ne=10) == [i for i in range(2, 31) if i % 5] and found(value=None, block_number=110) == [30]
    for bad in ({"id": 1}, {"active_gt": True}, {"from_address_gt": "a"}, {"value_contains": "1"}, {"tx_hash": "zz"}, {"active": "maybe"}, {"tx_index": "x"}):
        with pytest.raises(Q.QueryError):
            Q.where_clause(bad, table.schema)


WIDE = [0, 5, 40, 300, 2**64, 2**128 + 1, 2**200, 2**255, 2**256 - 1]


@pytest.mark.parametrize("numbers", [WIDE, [-n for n in WIDE[:-1]] + WIDE[:-1]])
def test_wide_numbers_compare_sort_and_page(spark, numbers):
    df = spark.createDataFrame([(i, str(n)) for i, n in enumerate(numbers)] + [(99, None)], "id long, value string")
    with pytest.raises(Q.QueryError):
        Q.where_clause({"value_gt": 5}, df.schema)
    df = Q.mark_numeric(df, "value")
    values = lambda rows: [None if r.value is None else int(r.value) for r in rows.collect()]
    for border in (0, 40, 2**128, -(2**200), 2**255):
        for suffix, test in (("gt", int.__gt__), ("gte", int.__ge__), ("lt", int.__lt__), ("lte", int.__le__), ("ne", int.__ne__)):
            got = values(df.where(Q.where_clause({f"value_{suffix}": str(border)}, df.schema)))
            assert sorted(got) == sorted(n for n in numbers if test(n, border))
    assert values(df.where(Q.where_clause({"value_in": ["0300", 2**200]}, df.schema))) == [n for n in numbers if n in (300, 2**200)]
    with pytest.raises(Q.QueryError):
        Q.where_clause({"value_contains": "1"}, df.schema)
    for direction in ("ASC", "DESC"):
        seen, cursor = [], None
        while True:
            page = Q.query_table(df, order_by="value", direction=direction, first=4, after=cursor)
            seen += values(page.rows)
            cursor = page.end_cursor
            if not page.has_next:
                break
        want = sorted(numbers, reverse=direction == "DESC")
        assert seen == ([None, *want] if direction == "DESC" else [*want, None])


def test_cursor():
    assert Q.decode_cursor(Q.encode_cursor("21000042", 99)) == ("21000042", 99)
    for bad in ("not-base64!!!", "bm90IGpzb24=", "e30="):
        with pytest.raises(Q.QueryError):
            Q.decode_cursor(bad)


@pytest.mark.parametrize("column", ["id", "value", "active", "block_number", "from_address", "tx_hash"])
@pytest.mark.parametrize("direction", ["ASC", "DESC"])
def test_pages_walk_the_whole_table(table, column, direction):
    whole = ids(table.orderBy(*Q.ordering(column, direction)))
    seen, cursor = [], None
    while True:
        page = Q.query_table(table, order_by=column, direction=direction, first=11, after=cursor)
        seen += ids(page.rows)
        cursor = page.end_cursor
        if not page.has_next:
            break
    assert seen == whole and len(seen) == 30


def test_nulls_and_limits(table):
    values = [r.value for r in table.orderBy(*Q.ordering("value", "DESC")).collect()]
    assert values[:6] == [None] * 6 and [Q.page_size(n) for n in (None, 0, 5, 99999)] == [100, 1, 5, 1000]
    assert ids(Q.select_page(table, skip=5, first=2, direction="ASC")) == [6, 7]
    empty = Q.query_table(table, {"block_number": 5})
    assert (empty.rows.count(), empty.has_next, empty.end_cursor) == (0, False, None)
    for bad in ({"order_by": "nope"}, {"direction": "UP"}):
        with pytest.raises(Q.QueryError):
            Q.select_page(table, **bad)


def test_projection(table):
    r = Q.api_projection(table).where("id = '7'").first()
    assert (r.id, r.tx_hash, r.tx_index, r.value, r.active) == ("7", "0x07", 1, "70", False)


def test_top_k_and_push_down(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    df = Q.select_page(spark.read.parquet(str(tmp_path / "t")), {"block_number_gte": 105, "from_address_starts_with": "0xab"}, first=3)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(block_number,105)" in plan and "StringStartsWith(from_address,0xab)" in plan
