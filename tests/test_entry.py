import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["block_number", "tx_index", "log_index", "from", "to", "value"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_filters_reach_the_scan_and_nothing_python_runs(spark):
    df = entry.queries()["topic_filter"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["decode_events", "context_join", "idempotent_append", "block_notification", "page_keyset", "factory_child_logs", "decode_failures"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, DATA).select(*[f"`{c}`" for c in columns]).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall()))
