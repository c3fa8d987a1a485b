import time

import hashlib
import os
import re

import numpy as np
import pytest
import pandas as pd
from xxhash import xxh64_intdigest

from chainframes.llm.components import connected_components
from chainframes.llm import simhash as simhash_module
from chainframes.llm.simhash import Scheme, _linked_stars, _variants, keep_one, met_pairs, near_duplicates, proposed_groups, simhash
from chainframes.llm.substrings import passages, remove_repeats, sliding_min

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids):
    fps = np.array(fps, dtype=np.uint64)
    seen = {}
    for i in range(len(fps)):
        if i in seen:
            continue
        group, stack = {i}, [i]
        while stack:
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[stack.pop()]) <= 3).tolist():
                if j not in group:
                    group.add(j)
                    stack.append(j)
        least = min((ids[j] for j in group if ids[j] is not None), default=None)
        seen |= dict.fromkeys(group, least)
    return [seen[i] for i in range(len(fps))]


def test_near_duplicates(make_docs, prose):
    got = near_duplicates(make_docs(prose, extra=True)).collect()
    fps = [fingerprint(t) for _, t in prose]
    want = sorted(zip([i for i, _ in prose], fps, components(fps, [i for i, _ in prose]), strict=True), key=repr)
    assert sorted(((r.doc_id, r.fp0 & (1 << 64) - 1, r.component) for r in got), key=repr) == want
    assert {r.fp0 for r in got if r.doc_id in (401, 402, 403)} == {0}


def test_near_edges(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    got = near_duplicates(make_docs([(None, "a b c d"), (None, "a b c d")])).collect()
    assert [(r.doc_id, r.component) for r in got] == [(None, None)] * 2


def test_links_of_another_scheme(make_docs, prose):
    scheme = Scheme(1, 42, True)
    got = near_duplicates(make_docs(prose), scheme=scheme).collect()
    fps = [simhash(t, scheme) & (1 << 64) - 1 for _, t in prose]
    want = sorted(zip([i for i, _ in prose], fps, components(fps, [i for i, _ in prose]), strict=True), key=repr)
    assert sorted(((r.doc_id, r.fp0 & (1 << 64) - 1, r.component) for r in got), key=repr) == want
    copies = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 210]
    assert sum(r.component == r.doc_id - 180 for r in copies) >= 3  # one word of each is changed


@pytest.mark.parametrize("small", [4, 32, 1024])
def test_large_buckets_are_split_by_the_bits_that_differ(monkeypatch, small):
    monkeypatch.setattr(simhash_module, "_COMPARED", small)
    rng = np.random.default_rng(small)
    for trial in range(12):
        n, wide = int(rng.integers(2, 300)), int(rng.integers(4, 22))
        base = rng.integers(0, 2**63, dtype=np.uint64)
        fps = base ^ (rng.integers(0, 2**wide, n).astype(np.uint64) << np.uint64(rng.integers(0, 40)))
        flips = rng.integers(0, 65, n)
        fps = np.unique(np.where(flips < 64, fps ^ (np.uint64(1) << np.minimum(flips, 63).astype(np.uint64)), fps))
        names = rng.permutation(len(fps)) if trial % 2 else rng.integers(0, max(1, len(fps) // 2), len(fps))
        label = {int(m): int(m) for m in names}

        def find(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for u, v in simhash_module._linked_stars(fps, 3, names):
            label[max(find(u), find(v))] = min(find(u), find(v))
        got = [find(int(m)) for m in names]
        want = names.copy()
        for _ in range(len(fps)):
            before = want.copy()
            for i, f in enumerate(fps):
                near = want[(np.bitwise_count(fps ^ f) <= 3) | (names == names[i])]
                want[np.isin(want, near)] = near.min()
            if (before == want).all():
                break
        assert len({*zip(got, want.tolist(), strict=True)}) == len(set(got)) == len(set(want.tolist()))


def test_alike_fingerprints_of_one_bucket_take_no_square():
    rng = np.random.default_rng(0)
    times = []
    for n in (8_000, 32_000):
        fps = np.unique(rng.integers(0, 2**22, n).astype(np.uint64) ^ np.uint64(0xABCDEF << 30))
        began = time.process_time()
        simhash_module._linked_stars(fps, 3)
        times.append(time.process_time() - began)
    assert times[1] < 13 * max(times[0], 0.1)


def test_every_close_pair_meets():
    rng = np.random.default_rng(1)
    masks = np.array([pair for group in _variants(6) for pair in group], dtype=np.int64)
    keys = lambda fp: set(((np.int64(fp) & masks[:, 0]) ^ masks[:, 1]).tolist())
    for _ in range(300):
        a = int(rng.integers(-(2**63), 2**63 - 1))
        flips = rng.choice(63, size=rng.integers(1, 4), replace=False)
        b = a
        for f in flips:
            b ^= 1 << int(f)
        assert keys(a) & keys(b)


@pytest.mark.parametrize("home_bits", [1, 6, 20])
def test_variants_of_one_row_share_their_home(home_bits):
    home, groups = simhash_module._home_mask(home_bits), _variants(home_bits)
    flat = [pair for group in groups for pair in group]
    assert len(flat) == len(set(flat)) == 131
    for fp in (0, -1, 0x123456789ABCDEF, -(2**63)):
        homes = [{((fp & a) ^ x) & home for a, x in group} for group in groups]
        assert all(len(h) == 1 for h in homes)


def test_scratch_tables_go_and_results_stay(spark):
    from chainframes.llm.common import materialize, scratch

    exists = lambda df: os.path.exists(df.inputFiles()[0].removeprefix("file:"))
    with scratch(spark) as outer:
        with scratch(spark) as result:
            passing, kept = materialize(spark.range(3)), result(spark.range(4))
            places = passing.inputFiles()
        assert not os.path.exists(places[0].removeprefix("file:"))
        assert exists(kept) and kept.count() == 4
        last, places = outer(kept), kept.inputFiles()
    assert not os.path.exists(places[0].removeprefix("file:"))
    assert exists(last) and last.count() == 4


def test_scratch_tables_go_when_a_step_fails(spark):
    from chainframes.llm.common import materialize, scratch

    with pytest.raises(ZeroDivisionError), scratch(spark):
        places = materialize(spark.range(3)).inputFiles()
        raise ZeroDivisionError
    assert not os.path.exists(places[0].removeprefix("file:"))


def test_bucket_stars():
    fps = np.array([0, 1, 3, 7, 0xFF, 0x1FF, 0xF << 40], dtype=np.uint64)
    edges = {(u, v) for u, v in _linked_stars(fps, 3)}
    assert edges == {(1, 0), (3, 0), (7, 0), (0x1FF, 0xFF)}


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {1000 + i: 1000 for i in range(1, 50)}


def test_members_of_one_name_give_no_edge():
    fps = np.array([0, 1, 3, 7, 0xFF, 0x1FF, 0xF << 40], dtype=np.uint64)
    assert _linked_stars(fps, 3, np.full(7, 9)) == []
    assert _linked_stars(fps, 3, np.array([4, 4, 5, 4, 6, 6, 4])) == [(5, 4)]


def test_named_fingerprints_meet_between_names_only(spark):
    rows = [(0, 10), (1, 10), (3, 20), (7, 20), (1 << 50, 10), (0xFFFF << 20, 30)]
    got = met_pairs(spark.createDataFrame(rows, "fp long, name long")).distinct().collect()
    assert {frozenset(r) for r in got} == {frozenset((10, 20))}


def test_groups_of_several_fingerprints_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    n, schemes = 120, tuple(Scheme(1, seed, True) for seed in range(5))
    # each text is a near copy of an earlier one by one of its fingerprints, or of none
    fps = rng.integers(-(2**63), 2**63 - 1, (n, len(schemes)))
    for i in range(1, n):
        if rng.random() < 0.7:
            c = rng.integers(len(schemes))
            flips = np.bitwise_xor.reduce(np.int64(1) << rng.choice(63, size=3, replace=False).astype(np.int64))
            fps[i, c] = fps[rng.integers(i), c] ^ (flips if rng.random() < 0.8 else 0)
    fps[80:, 0] = fps[0, 0] ^ (np.int64(1) << (np.arange(40) % 8))  # one large group
    nodes = rng.permutation(n) * 7 - 200
    near = (np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 3).any(axis=2)
    root = nodes.copy()
    while True:
        low = np.array([root[row].min() for row in near])
        if (low == root).all():
            break
        root = low
    texts = spark.createDataFrame([(int(x), *map(int, f)) for x, f in zip(nodes, fps, strict=True)], "node long, " + ", ".join(f"fp{i} long" for i in range(len(schemes))))
    got = {r.node: r.root for r in proposed_groups(texts, schemes).collect()}
    assert got == dict(zip(nodes.tolist(), root.tolist(), strict=True))


def test_a_split_bucket_links_what_all_pairs_link():
    rng = np.random.default_rng(6)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) for c in rng.integers(0, 1 << 63, 4).astype(np.uint64)]))
    label = {int(x): i for i, x in enumerate(fps)}
    for u, v in _linked_stars(fps, 3):
        old, new = label[u], label[v]
        label = {k: new if x == old else x for k, x in label.items()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert len(fps) > 200 and all((label[int(fps[i])] == label[int(fps[j])]) for i, j in zip(*np.nonzero(near), strict=True))


def test_keep_one(make_docs, prose):
    kept = keep_one(make_docs(prose)).toPandas()
    ids = sorted(int(i) for i in kept.doc_id.dropna())
    assert len(ids) == len(set(ids)) and not {100 + i for i in range(10)} & set(ids)
    assert {407, 404} <= set(ids) and len({401, 402, 403} & set(ids)) == 1


def removed(rows, window=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + window))
    return [(i, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for (i, _), w, g in zip(rows, words, gone, strict=True)]


def test_remove_repeats(make_docs, prose):
    got = remove_repeats(make_docs(prose, extra=True)).collect()
    digest = lambda t: hashlib.sha256(" ".join(WORD.findall(t)).encode()).hexdigest()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, digest(r.kept_text)) for r in got), key=repr) == sorted(
        ((i, n, g, digest(t)) for i, n, g, t in removed(prose)), key=repr
    )
    texts = dict(prose)
    assert all(r.kept_text == (texts[r.doc_id] or "") for r in got if not r.n_removed)


def test_remove_repeats_edges(make_docs):
    assert remove_repeats(make_docs([])).count() == 0
    words = " ".join(str(i) for i in range(35))
    got = {r.doc_id: r for r in remove_repeats(make_docs([(1, words), (2, f"x\n{words}  y  z"), (3, words.rsplit(" ", 1)[0])])).collect()}
    assert (got[1].n_removed, got[1].kept_text) == (35, "") and got[3].n_removed == 0
    assert got[2].kept_text == "x y  z"


def test_passages_stay_in_documents():
    found = passages(np.array([0, 1, 2, 40, 41, 100]), np.array([0, 41]))
    assert found == [(0, 37), (40, 75), (41, 76), (100, 135)]
    assert pd.Series(sliding_min(np.array([5, 3, 4, 1, 9]), 3)).tolist() == [3, 1, 1]
