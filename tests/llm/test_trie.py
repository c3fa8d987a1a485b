import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from chainframes.llm import trie
from chainframes.llm.trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The trie by plain dictionaries."""
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    own = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, digest(r or "", t or ""), (r or "", t or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(who) - 1) * words
    return sorted(
        (min(who), len(n), min(members[n[:-1]]) if n else -1, len(who), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, who in members.items()
    )


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in conversation_trie(df).collect())


def test_nulls_ties_repeats_negative_ids_and_odd_texts(spark):
    rows = [(0, i, "user" if i % 2 == 0 else "assistant", f"t{i} and more") for i in range(4)]
    rows += [(c, i, "user", f"t{i} and more" if c % 3 else f"own {c % 2}") for c in range(1, 45) for i in range(c % 6)]
    rows += [(5, None, None, None), (5, None, "user", None), (5, 1, "user", ""), (5, 1, "user", ""), (None, 0, "user", "lost"), (-3, 0, "user", "minus"), (-20, 0, "a", "b c"), (-21, 0, "a", "b c"), (7, 9, "user", "x " * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute(rows)
    clash = df.selectExpr("*", "'k' AS key", "1 AS depth", "2 AS block", "'d' AS digest", "3 AS words")
    assert found(clash) == brute(rows)
    assert conversation_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("band", [2, 8])
def test_deep_conversations_cross_bands(spark, monkeypatch, band):
    monkeypatch.setattr(trie, "BAND", band)
    rows = [(20 * c, i, "user", f"t{i}" if i < 70 - 9 * c else f"u{c} {i}") for c in range(6) for i in range(70 + c)]
    rows += [(21 + c, i, "user", f"t{i} w") for c in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    if band == 8:
        assert found(df) == brute(rows)
    else:  # workers import the module anew, so their paths are built here
        turns = trie.ordered_turns(df).select("block", "conv_id", "digest", "words").coalesce(1).toArrow()
        paths = spark.createDataFrame(__import__("pyarrow").Table.from_batches(list(trie._prefixes(iter(turns.to_batches()))))) if turns.num_rows else None
        monkeypatch.setattr(trie, "prefixes", lambda _: paths)
        assert found(df) == brute(rows)


def test_deep_rounds_are_few(spark, monkeypatch):
    calls = []
    real = trie.subtree_totals
    monkeypatch.setattr(trie, "subtree_totals", lambda *a, **k: (calls.append(a[-1]), real(*a, **k))[1])
    rows = [(0, i, "user", f"t{i}") for i in range(600)]
    out = conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 601 and len(calls) == 4 and {r.n_leaves for r in out} == {1}


def test_a_popular_end_is_hashed_in_order(spark):
    rows = [(20 * c, 0, "user", "hello there") for c in range(3000)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
