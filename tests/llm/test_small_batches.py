import corpus_pipeline
import pytest

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize(("own", "want"), [("10000", 2000), ("0", 2000), ("-1", 2000), ("500", 500)])
def test_stages_send_texts_in_small_batches(spark, make_docs, monkeypatch, own, want):
    seen = []

    def note(*_, **__):
        seen.append(int(spark.conf.get(KEY)))
        raise InterruptedError

    for name in ("learn_languages", "keep_one", "remove_repeats", "pack_documents"):
        monkeypatch.setattr(corpus_pipeline, name, note)
    before = spark.conf.get(KEY)
    try:
        for name, stage in corpus_pipeline.STAGES:
            if name != "source mixing":  # no Python
                spark.conf.set(KEY, own)
                with pytest.raises(InterruptedError):
                    stage(spark, make_docs([]), "")
    finally:
        spark.conf.set(KEY, before)
    assert seen == [want] * 4
