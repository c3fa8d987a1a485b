import random

import pytest
from pyspark.sql import functions as F

from chainframes.operators import decode as D
from chainframes.plans import query as Q
from chainframes.plans import specs as S


def w(*numbers):
    return "".join(f"{n % 2**256:064x}" for n in numbers)


def dynamic(t):
    return D.is_dynamic(t)


def encode(solidity, value):
    """The ABI encoding of a value, in hex: tails behind heads, in order."""
    if solidity in ("string", "bytes"):
        raw = value.encode() if isinstance(value, str) else value
        return w(len(raw)) + raw.hex().ljust(-(-len(raw) // 32) * 64, "0")
    if found := D.array_of(solidity):
        element, n = found
        return ("" if n is not None else w(len(value))) + sequence([element] * len(value), value)
    if solidity.startswith("("):
        return sequence(S.tuple_types(solidity), value)
    return w(int(value))


def sequence(types, values):
    heads, tails, at = [], [], 32 * sum(map(D.head_words, types))
    for t, v in zip(types, values, strict=True):
        body = encode(t, v)
        if dynamic(t):
            heads.append(w(at))
            tails.append(body)
            at += len(body) // 2
        else:
            heads.append(body)
    return "".join(heads + tails)


def some(solidity, rng):
    if solidity == "string":
        return "".join(rng.choices("abcé ", k=rng.choice([0, 1, 31, 32, 33, 90])))
    if solidity == "bytes":
        return rng.randbytes(rng.choice([0, 5, 32, 70]))
    if found := D.array_of(solidity):
        return [some(found[0], rng) for _ in range(found[1] if found[1] is not None else rng.randint(0, 3))]
    if solidity.startswith("("):
        return tuple(some(t, rng) for t in S.tuple_types(solidity))
    return rng.random() < 0.5 if solidity == "bool" else rng.randrange(2**40)


def plain(v):
    if isinstance(v, tuple):
        return tuple(map(plain, v))
    return list(map(plain, v)) if isinstance(v, list) else bytes(v) if isinstance(v, bytearray) else v


TYPES = ("(string,uint64[])", "string[][2]", "(uint64,(bool,string),bytes)[]", "uint64[2][3]", "((string,(bytes,uint64[2])),bool)", "(uint64,bool)[2]", "uint64[20]", "bytes[]")


@pytest.mark.parametrize("solidity", TYPES)
def test_round_trips(spark, solidity):
    rng = random.Random(solidity)
    params = (S.Param("a", "uint64"), S.Param("x", solidity), S.Param("s", "string"), S.Param("y", solidity))
    values = [tuple(some(p.type, rng) for p in params) for _ in range(30)]
    rows = spark.createDataFrame([(i, sequence([p.type for p in params], v)) for i, v in enumerate(values)], "i long, data string")
    got = {r.i: plain(tuple(r)[1:]) for r in D.decode_events(rows, params, ("i",)).collect()}
    assert got == dict(enumerate(values))
    headless = rows.select("i", F.expr("left(data, 64)").alias("data"))
    assert D.decode_failures(headless, params, ()).first().decoded == 0
    assert D.decode_failures(rows, params, ()).first().failed == 0


def size(solidity):
    program = D.program([(solidity, 0)], F.col("data"))
    return len(str(program._jc.toString() if hasattr(program, "_jc") else program))


def test_programs_are_as_long_as_their_type(spark):
    nested = "(uint64,string)"
    sizes = []
    for _ in range(6):
        sizes.append(size(nested))
        nested = f"(uint64,{nested})"
    steps = [b - a for a, b in zip(sizes, sizes[1:], strict=False)]
    assert max(steps) < 1.2 * min(steps)
    df = spark.createDataFrame([("",)], "data string")
    plan = D.decode_events(df, (S.Param("t", "(uint64,(bool,string),uint8)"),))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(") < 40


def test_many_offsets_to_one_long_value_do_not_pass(spark):
    n = 2000
    inner = w(n) + w(*range(n))
    lists = w(32, n) + w(*[32 * n] * n) + inner
    texts = w(32, n) + w(*[32 * n] * n) + w(32 * n) + "61" * (32 * n)
    df = spark.createDataFrame([(lists,), (texts,)], "data string")
    for solidity in ("uint64[][]", "string[]"):
        assert D.decode_failures(df, (S.Param("x", solidity),), ()).first().decoded == 0
    shared = w(32, 2, 64, 64) + w(1, 7)  # twice the same short value is legal
    assert D.decode_events(spark.createDataFrame([(shared + w(0, 0),)], "data string"), (S.Param("x", "uint64[][]"),)).first().x == [[7], [7]]


def test_hostile_data_end_no_job(spark):
    params = (S.Param("n", "uint64", True), S.Param("s", "string"), S.Param("x", "(uint64,string[])"), S.Param("big", "int256"))
    rng = random.Random(1)
    bad = [None, "", "0", "zz" * 200, w(2**32 - 1, 2**32 - 1, 0), w(2**31, 64, 5), w(96, 2**31 - 1, 0), w(96, 96, 1, 2**32 - 1), "f" * 640, w(96, 128, 1) + w(2**32 - 1) + w(7, 64, 2**31)]
    bad += [rng.randbytes(rng.randrange(400)).hex() for _ in range(200)]
    df = spark.createDataFrame([(w(1), b) for b in bad], "topic1 string, data string")
    assert D.decode_events(df, params).count() == 0
    counted = D.decode_failures(df, params, ()).first()
    assert (counted.failed, counted.decoded) == (len(bad), 0)
    shown = D.with_decoded(df, params, F.col("data"), ("topic1",), keys=True)
    assert {r.decoded for r in shown.collect()} == {False} and shown.where("s is not null or big_w is not null or x is not null").count() == 0


def test_invalid_utf8_is_replaced(spark):
    raw = b"ab\xff\xfec"
    df = spark.createDataFrame([(w(32) + encode("bytes", raw),)], "data string")
    assert D.decode_events(df, (S.Param("s", "string"),)).first().s == raw.decode(errors="replace")
    df = spark.createDataFrame([(w(32) + encode("bytes[]", [raw]),)], "data string")
    assert D.decode_events(df, (S.Param("s", "string[]"),)).first().s == [raw.decode(errors="replace")]


WIDE = [0, 1, 5, 40, 2**64, 2**128 + 1, 2**200, 2**255 - 1, 2**255, 2**256 - 1]


@pytest.mark.parametrize("solidity", ["uint256", "int256"])
def test_keys_compare_like_numbers(spark, tmp_path, solidity):
    numbers = WIDE if solidity == "uint256" else sorted({n - 2**256 if n >= 2**255 else n for n in WIDE} | {-1, -5, -(2**200)})
    params = (S.Param("v", solidity),)
    decoded = D.decode_events(spark.createDataFrame([(i, w(n)) for i, n in enumerate(numbers)], "id long, data string"), params, ("id",), keys=True)
    decoded.write.parquet(str(tmp_path / "t"))
    table = spark.read.schema(decoded.schema).parquet(str(tmp_path / "t"))
    found = lambda **where: sorted(int(r.v) for r in table.where(Q.where_clause(where, table.schema)).collect())
    import operator

    tests = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
    for border in (5, "5.5", -5.5, "-0.5", 2**200, 10**77, 10**80, -(10**80), 2**256, 2**255, -(2**255) - 1, "1e400", "-1e400", "1e-400", "0.0", "40.00"):
        exact = Q.number(border)
        for suffix, test in tests.items():
            assert found(**{f"v_{suffix}": border}) == [n for n in numbers if test(n, exact)], (border, suffix)
        assert found(v=border) == [n for n in numbers if n == exact] and found(v_ne=border) == [n for n in numbers if n != exact]
        assert found(v_in=[border]) == [n for n in numbers if n == exact] and found(v_not_in=[border]) == [n for n in numbers if n != exact]
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = table.where(Q.where_clause({"v_gt": 40}, table.schema))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v_w), GreaterThan(v_w," in plan
    seen, cursor = [], None
    while True:
        page = Q.query_table(table, order_by="v", direction="ASC", first=3, after=cursor)
        seen += [int(r.v) for r in page.rows.collect()]
        cursor = page.end_cursor
        if not page.has_next:
            break
    assert seen == numbers and "v_w" not in Q.api_projection(table).columns
    for bad in ({"v_w": "00"}, {"v_gt": True}, {"v": "x"}, {"v_gt": float("nan")}, {"v_lt": None, "v_gt": "inf"}):
        with pytest.raises(Q.QueryError):
            Q.where_clause(bad, table.schema)
    with pytest.raises(Q.QueryError):
        Q.select_page(table, order_by="v_w")


def test_fractions_on_plain_numbers(spark):
    df = spark.createDataFrame([(i, i, i % 2 == 0) for i in range(-3, 8)] + [(99, None, None)], "id long, n int, b boolean")
    df = df.withColumn("d", (F.col("n") / 2).cast("decimal(10,1)")).withColumn("f", F.col("n").cast("double"))
    found = lambda **where: sorted(r.n for r in df.where(Q.where_clause(where, df.schema)).collect())
    assert found(n_lt=5.5, n_gt="4.5") == [5] and found(n_gte=5.5) == [6, 7] and found(n_lte=-2.5) == [-3] and found(n=2.5) == [] and found(n_ne=2.5) == list(range(-3, 8))
    assert found(d="2.5") == [5] and found(d_gt="2.45", d_lt=2.55) == [5] and found(d_lt=10**30) == list(range(-3, 8)) and found(d=2.25) == []
    assert found(n_in=[1, 1.5, 10**12, "2"]) == [1, 2] and found(n_not_in=[0.5]) == list(range(-3, 8)) and found(n_gt=-(10**20)) == list(range(-3, 8)) and found(n_gt=10**20) == []
    assert found(f_gt=4.5) == [5, 6, 7] and found(b=True, n_gt=3) == [4, 6]
    for bad in ({"n": True}, {"n_gt": "one"}, {"b": 1}, {"n": float("inf")}):
        with pytest.raises(Q.QueryError):
            Q.where_clause(bad, df.schema)


def test_one_cursor_codec(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(7, None, bytearray(b"\xab"), True, Decimal("1.50"), 'a"é\\', "x" * 90)], "id long, n long, raw binary, b boolean, d decimal(5,2), s string, long string")
    row = df.first()
    for c in df.columns:
        assert df.select(Q.cursor_column(df, c)).first()[0] == Q.encode_cursor(row[c], 7)
        assert Q.decode_cursor(Q.encode_cursor(row[c], 7))[1] == 7
        assert df.where(Q.after_cursor(Q.encode_cursor(row[c], 7), c, "DESC", df.schema)).count() == 0
