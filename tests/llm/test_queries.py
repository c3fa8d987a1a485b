"""The registered queries and the pipeline on the small tables."""

import os
import random

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_all_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for _, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, DATA))
        assert set(docs.columns) == set(P.COLUMNS)
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[2] < counts[0]
    packed = P.materialize(P.STAGES[-1][1](spark, docs, DATA))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.agg({"offset": "min"}).first()[0] == 0


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, DATA))
        assert docs.count() == 0


def junk():
    rng = random.Random(0)
    mash = " ".join("".join(rng.choices("qwxzjkvbfpy", k=rng.randint(3, 9))) for _ in range(60))
    digits = " ".join("".join(rng.choices("0123456789abcdef", k=16)) for _ in range(40))
    base64 = " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=64)) for _ in range(10))
    foreign = "a gyors barna róka átugrik a lusta kutya felett és elszalad az erdőbe ahol süt a nap"
    return [mash, digits, base64, foreign, "我们今天去公园散步然后一起吃饭看电影回家休息", "12 34 !!", ""]


def test_the_language_stage_rejects_planted_text_and_keeps_the_rest(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(-1 - i, t, None, "planted", len(t)) for i, t in enumerate(junk())]
    planted = spark.createDataFrame(rows, docs.schema)
    kept = {r.doc_id for r in P.language_stage(spark, docs.unionByName(planted), DATA).select("doc_id").collect()}
    letters = {r.doc_id for r in docs.where("text rlike '[a-zA-Z]'").select("doc_id").collect()}
    assert kept == letters


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a = docs.where("text is not null").orderBy("doc_id").limit(40)
    nulls = a.limit(5)
    odd = nulls.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars")
    blank = spark.createDataFrame([(900_001, None, "en", "s", None), (900_002, "", "en", None, 0), (900_003, "word " * 60_000, "en", "s", None), (None, None, None, None, None)], docs.schema)
    rows = a.unionByName(a.limit(10)).unionByName(odd).unionByName(blank).selectExpr("*", "1 AS __key", "2 AS id", "3 AS size", "4 AS piece", "5 AS fit", "6 AS kept_text")
    out = rows
    for name, stage in P.STAGES:
        out = P.materialize(stage(spark, out, DATA))
        if name != P.STAGES[-1][0]:
            assert set(out.columns) == set(P.COLUMNS)
            out = out.selectExpr("*", "1 AS __key", "2 AS h", "3 AS copies", "4 AS chunk", "5 AS n_removed")
        assert out.count() > 0
    assert out.where("length > 2048 or offset < 0").count() == 0


def test_kept_columns_may_not_clash(spark):
    from pyspark.sql import functions as F

    from chainframes.llm.attribution import token_counts
    from chainframes.llm.language import identify_languages, learn_languages
    from chainframes.llm.packing import pack_documents
    from chainframes.llm.simhash import keep_one
    from chainframes.llm.substrings import remove_repeats
    from chainframes.llm.toxicity import ToxicityModel, score_toxicity

    docs = spark.createDataFrame([(1, "a few words", "x", "y")], "doc_id long, text string, score string, n_tokens string").withColumn("n_words", F.lit(1)).withColumn("lang", F.lit("en"))
    for call in (
        lambda: score_toxicity(docs, ToxicityModel({}), keep=("doc_id", "score")),
        lambda: identify_languages(docs, learn_languages(docs), keep=("doc_id", "score")),
        lambda: token_counts(docs, "", F.array(), keep=("doc_id", "n_tokens")),
        lambda: remove_repeats(docs, keep=("doc_id", "n_words")),
        lambda: remove_repeats(docs, keep=("doc_id", "doc_id")),
        lambda: pack_documents(docs.withColumnRenamed("doc_id", "piece"), "", id_col="piece"),
    ):
        with pytest.raises(ValueError, match="keep holds"):
            call()
    clash = docs.select("doc_id", "text", F.lit(7).alias("__key"), F.lit(8).alias("__NODE"))
    assert keep_one(clash).columns == clash.columns and [tuple(r) for r in keep_one(clash).collect()] == [(1, "a few words", 7, 8)]
