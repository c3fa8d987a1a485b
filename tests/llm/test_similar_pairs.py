import random

import numpy as np
from chainframes.llm.components import connected_components
from chainframes.llm.shingles import run_set, similar_pairs


def parts(n, pairs):
    label = list(range(n))
    for i, j in pairs:
        low, high = sorted((label[i], label[j]))
        label = [low if x == high else x for x in label]
    return label


def by_all_pairs(texts):
    sets = [set(run_set(t).tolist()) for t in texts]
    return parts(len(texts), [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 5 * len(x & y) >= 4 * len(x | y)])


def found(spark, groups):
    rows = [(node, root, text) for root, texts in groups.items() for node, text in texts]
    got = connected_components(similar_pairs(spark.createDataFrame(rows, "node long, root long, text string")))
    return {r["node"]: r["root"] for r in got.collect()}


def edited(words, rng, times, mark):
    words = list(words)
    for k in range(times):  # runs of five do not overlap: each edit costs five runs
        words[10 + 20 * k + rng.randrange(10)] = f"{mark}x{k}"
    return " ".join(words)


def test_no_link_of_a_large_group_is_lost(spark):
    """Texts like their centre, but not like each other: whatever two texts a bucket
    is compared with, hardly one of them is the centre."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(9000)}" for _ in range(200)]
    texts = [edited(words, rng, 4, f"a{i}") for i in range(250)]
    texts.insert(70, " ".join(words))
    texts += [edited(words, rng, 9, f"b{i}") for i in range(30)]  # like none
    texts += [edited(words, rng, 9, f"c{i}") for i in range(3) for _ in range(2)]
    texts += ["", " \n", "one two", "ONE two"]
    want = by_all_pairs(texts)
    assert want[:251] == [0] * 251 and len(set(want)) == 1 + 30 + 6 + 2
    got = found(spark, {7: list(enumerate(texts))})
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_groups_stay_apart(spark):
    """One group's links do not reach into another; a group of all degrees of likeness."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(9000)}" for _ in range(200)]
    texts = [edited(words, rng, rng.randrange(10), f"d{i}") for i in range(60)]
    want = by_all_pairs(texts)
    assert 1 < len(set(want)) < 60
    got = found(spark, {1: list(enumerate(texts)), 2: [(100 + i, t) for i, t in enumerate(texts)]})
    assert [got.get(i, i) for i in range(60)] == want
    assert [got.get(100 + i, 100 + i) - 100 for i in range(60)] == want


def test_bitmaps_differ_in_no_more_bits_than_sets():
    from chainframes.llm.shingles import bitmap

    rng = np.random.default_rng(5)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 3000, rng.integers(0, 2000), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        apart = int(np.bitwise_count((bitmap(x) ^ bitmap(y)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(x, y))
    assert not bitmap(np.zeros(0, np.uint64)).any()
