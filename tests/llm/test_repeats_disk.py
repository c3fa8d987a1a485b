import re

from chainframes.llm.substrings import remove_repeats


def shuffles_on_disk(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {m[1] for n in names if (m := re.match(r"shuffle_(\d+)_\d+_\d+\.data$", n))}


def test_the_phrase_count_leaves_no_shuffle_beside_the_dealt_texts(spark, make_docs, prose):
    docs = make_docs(prose).repartition(3)
    docs.count()
    before = shuffles_on_disk(spark)
    found = remove_repeats(docs)
    # that of the number of rows and the caller's own
    assert len(shuffles_on_disk(spark) - before) <= 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert "chunk" in exchanges and "phrase" not in exchanges
    assert {r.doc_id: r.n_removed for r in found.collect()}[300] == 60
