import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainframes.llm.mixing import mix_sources
from chainframes.llm.packing import best_fit_runs, byte_alphabet, few_document_patterns, fit_repeats, pack_documents, pack_histogram, piece_bounds, ranked

tokens = pytest.importorskip("public_tokenizers")
PATH = tokens.path("byte_bpe_50k.json")


def levels(sizes, weights, most):
    """Targets by sharing the excess again and again."""
    targets = dict.fromkeys(sizes, 0.0)
    left, free = float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and free:
        share = left / sum(weights[s] for s in free)
        left = 0.0
        for s in list(free):
            targets[s] += share * weights[s]
            if targets[s] >= most * sizes[s] - 1e-12:
                left += targets[s] - most * sizes[s]
                targets[s] = most * sizes[s]
                free.discard(s)
    return targets


def test_mix_targets_and_takes(make_docs):
    rows = []
    for k, (source, n) in enumerate([("b", 40), ("a", 3), (None, 25), ("z", 400), ("É", 60)]):
        rows += [(1000 * k + i, " ".join(["w"] * (i % 7 + 1)), "en", source, 1) for i in range(n)]
    got = mix_sources(make_docs(rows, extra=True)).toPandas()
    docs = make_docs(rows).select("doc_id", "source").toPandas()
    got = got.merge(docs, on="doc_id")
    got["source"] = got["source"].fillna("~null")
    sizes = got.groupby("source")["size"].sum().to_dict()
    order = ["a", "b", "z", "É", "~null"]
    weights = {s: 1 + i % 3 for i, s in enumerate(order)}
    want = levels(sizes, weights, 3)
    for s, g in got.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(want[s])
        assert abs(g.taken.sum() - want[s]) <= 7
        assert (g.taken <= 3 * g["size"]).all() and (g.source_size == sizes[s]).all()
    again = mix_sources(make_docs(rows[::-1])).toPandas()
    assert got.set_index("doc_id").taken.sort_index().equals(again.set_index("doc_id").taken.sort_index())


def test_mix_edges(make_docs):
    assert mix_sources(make_docs([])).count() == 0
    only_empty = mix_sources(make_docs([(1, None), (2, ""), (None, " ")])).collect()
    assert {(r["size"], r.target, r.taken) for r in only_empty} == {(0, 0.0, 0)}
    capped = mix_sources(make_docs([(i, "a" if i % 2 else " ", "en", "s", 1) for i in range(20)] + [(100 + i, "b " * 50, "en", "t", 1) for i in range(20)])).collect()
    assert max(r.copies for r in capped) <= 3
    repeated = mix_sources(make_docs([(1, "a b")] * 4 + [(None, "a")] * 3)).collect()
    assert sum(r.taken for r in repeated) == 11 and len(repeated) == 7


def test_pieces():
    assert piece_bounds(5, 10) == [(0, 5)]
    assert piece_bounds(20, 10) == [(0, 10), (10, 10)]
    assert piece_bounds(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_plan_is_exact_and_tight():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        lengths = rng.integers(1, 129, n)
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = pack_histogram(counts, 128)
        back: dict[int, int] = {}
        for made, k in plan:
            assert sum(made) <= 128 and k > 0
            for length in made:
                back[length] = back.get(length, 0) + k
        assert back == counts
        assert sum(k for _, k in plan) <= 1.02 * sum(lengths) / 128 + 2
    patterns = few_document_patterns(np.array([2, 3, 5, 10]), 10)
    assert sorted(tuple(sorted(x for x in p if x >= 0)) for p in patterns.tolist()) == [(0, 1, 2), (2, 2), (3,)]


def test_fit_meets_the_conditions_of_the_optimum():
    rng = np.random.default_rng(5)
    for n in (12, 40, 64):
        lengths = np.unique(rng.integers(1, 97, n))
        counts = rng.integers(0, 500, len(lengths))
        patterns = few_document_patterns(lengths, 96)
        x = fit_repeats(patterns, counts, tolerance=1e-6, rounds=500)
        a = np.zeros((len(lengths), len(patterns)))
        for j, row in enumerate(patterns.tolist()):
            for i in row:
                if i >= 0:
                    a[i, j] += 1
        gain = a.T @ (counts - a @ x)
        assert (x >= 0).all() and gain.max() < 1 and np.abs(gain[x > 1e-6]).max() < 1


def test_plan_is_about_as_tight_as_best_fit():
    rng = np.random.default_rng(8)
    for lengths in (rng.integers(20, 512, 6000), rng.integers(150, 300, 6000), rng.choice(rng.integers(5, 512, 30), 6000)):
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plain = sum(n for _, n in best_fit_runs(counts, 512))
        assert sum(n for _, n in pack_histogram(counts, 512)) <= 1.002 * plain + 1


def test_alphabet_covers_all_bytes():
    assert sorted(byte_alphabet().values()) == list(range(256)) and byte_alphabet()["Ġ"] == 0x20


def test_pack_documents(make_docs, prose):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    prose = [*prose, (500, "a <|endoftext|> b"), (501, "<|endoftext|>"), (502, "x" * 90_000 + " y" * 90_000)]
    got = pack_documents(make_docs(prose, extra=True), PATH, capacity=256).toPandas()
    texts = {i: t for i, t in prose}
    for i, rows in got[got.doc_id.notna() & (got.doc_id != 407)].groupby("doc_id"):
        ids = [*plain.encode(texts[int(i)] or "", add_special_tokens=False).ids, 0]
        rows = rows.sort_values("piece")
        assert rows.length.sum() == len(ids) and list(rows.piece) == list(range(len(rows)))
        for r in rows.itertuples():
            assert zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32
    assert len(got[got.doc_id == 407]) % 3 == 0
    places = got.sort_values(["sequence_id", "offset"])
    for _, rows in places.groupby("sequence_id"):
        ends = (rows.offset + rows.length).tolist()
        assert rows.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 2


def test_pack_edges(make_docs):
    assert pack_documents(make_docs([]), PATH).count() == 0
    got = pack_documents(make_docs([(None, None), (1, "")]), PATH).collect()
    assert {(r.length, r.piece, r.sequence_id) for r in got} == {(1, 0, 0)} and {r.offset for r in got} == {0, 1}


def test_ranks_in_buckets(spark):
    pieces = spark.range(1000).select(F.col("id"), F.lit(0).alias("piece"), (F.col("id") % 2).alias("length"), F.col("id").alias("ids_crc32"))
    got = ranked(pieces, 30).toPandas()
    for _, rows in got.groupby("length"):
        assert sorted(rows["rank"]) == list(range(500))
