import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from chainframes.llm import ranked
from chainframes.llm.ranked import Best, Shard, Statistics, best_positions, ranked_search, terms_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 75 + 25 * c.total() * n_docs // n_terms
            scores.append((-sum(q * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in Counter(terms(text)).items() if c[t]), d is None, d or 0))
        out += [(item, k, None if missing else d, -s) for k, (s, missing, d) in enumerate(sorted(scores)[:20], 1) if s < 0]
    return sorted(out, key=str)


def found(spark, docs, items, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted(map(tuple, ranked_search(d, spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)


def test_terms():
    for text in ("Ab-cD éX9_z ÉÀ", "", "  \n", "İstanbul DŽ ſt a b  c", "\x7f\x80[]{}@`a/0:9"):
        assert [t.decode() for t in terms_of(text)] == terms(text)
    assert terms_of(None) == []


def test_against_brute_force_with_ties_copies_nulls_and_long_texts(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(40)] + ["The", "of", "É"]
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 30)))) for i in range(300)]
    docs += [(1000 + i, "the OF w1 w2") for i in range(90)] + [(7, docs[7][1])] * 3 + [(None, "w1 w2 the of"), (None, None), (5000, None), (5001, ""), (5002, "-- !"), (5003, "w1 " * 50_000)]
    items = [(i, " ".join(random.choices(words, k=random.randint(1, 15)))) for i in range(25)] + [(90, "the of w1 w2 w2 w2"), (91, None), (92, "?!"), (93, "unheard of"), (94, "unheard"), (None, "w3 w4")]
    assert found(spark, docs, items) == brute(docs, items)
    clash = spark.createDataFrame(docs[:50], "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS rank", "3 AS query", "4 AS item_id")
    assert ranked_search(clash, spark.createDataFrame(items[:2], "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS texts")).columns == ["item_id", "rank", "doc_id", "score"]


def test_empty_tables_and_blocks_of_items(spark, monkeypatch):
    docs, items = [(i, f"a{i % 7} b{i % 3}") for i in range(60)], [(i, f"a{i} b{i % 3} a0") for i in range(8)]
    assert found(spark, docs, []) == [] and found(spark, [], items) == []
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 6)
    assert found(spark, docs, items) == brute(docs, items)


def test_reading_stops_early_and_never_at_a_tie():
    rng = np.random.default_rng(3)
    size = 20_000
    stats, weights = Statistics(size, 2 * size * 5, np.full(2, size)), np.array([900, 700])
    tfs = rng.geometric(0.3, (size, 2)).astype(np.int32)
    tfs[:50] = 40  # the best, all alike

    def shard(tf, ids):
        at = pa.array(np.arange(0, 2 * len(tf) + 1, 2), pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (np.tile([0, 1], len(tf)), tf.ravel())]
        return Shard(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(tf), 10)), *lists], ["doc_id", "n", "terms", "tfs"]), stats, weights)

    best = Best()
    read = best_positions(shard(tfs, np.arange(size)[::-1].copy()), np.array([0, 1]), np.array([1, 2]), best)
    assert read < size / 10 and best.doc_id.tolist() == list(range(size - 50, size - 30)) and len(set(best.score.tolist())) == 1
    rare = np.full((size, 2), 1, np.int32)
    assert best_positions(shard(rare, np.arange(size)), np.array([0, 1]), np.array([1, 2]), best) == 2 * ranked.FIRST_ROUND  # scores of earlier batches count
