import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chainframes.llm import quality
from chainframes.llm.chat import format_conversations, parse
from chainframes.llm.fingerprint import containment, fingerprint_documents, likeness, merge, op5_fingerprint, with_next

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- chat -------------------------------------------------------------------------


def test_round_trip(spark):
    nasty = ["<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<|\\im_end|>", "<|\\\\im_start|>", "plain \\ text", "", None, "é\n\n", "<|im_end|><|im_end|>", "<|im_x|>"]
    roles = ["user", "assistant", "sys\ntem", "a\\nb", "<|im_start|>", None, "assistant"]
    rows = [(c, t, roles[(c + t) % len(roles)], nasty[(c * 3 + t) % len(nasty)]) for c in range(12) for t in range(5)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "first"), (50, 1, "user", "twice"), (50, 1, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("conv", F.lit(2))
    out = {r.conv_id: r for r in format_conversations(df).withColumn("back", parse(F.col("formatted"))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert [(b.role, b.text) for b in out[conv].back] == [(r, t) for _, r, t in own]
        spans = [out[conv].formatted[s.start : s.start + s.length] for s in out[conv].loss_spans]
        plain = [re.sub(r"<\|\\(\\*)im_(start|end)\|>", r"<|\1im_\2|>", s) for s in spans]
        assert plain == [t for _, r, t in own if r == "assistant"]
    assert not out[50].escaped and out[0].formatted.count("<|im_start|>") == 5
    assert format_conversations(df.limit(0)).count() == 0


# -- fingerprints -------------------------------------------------------------------


def all_hashes(text, k=3):
    words = WORD.findall(text or "")
    word = [xxh64_intdigest(w.encode(), 42) for w in words]

    def chain(hashes):
        seed = 42
        for h in hashes:
            seed = xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed >> 16

    if not words:
        return set()
    return {chain(word[i : i + k]) for i in range(len(word) - k + 1)} if len(word) >= k else {chain(word)}


def reduced(hashes, scale=2):
    return sorted({h for h in hashes if h < (1 << 48) // scale}) or sorted(hashes)[:1]


def sketch(text):
    return reduced(all_hashes(text))


def test_sketches(make_docs, prose):
    got = fingerprint_documents(make_docs(prose, extra=True)).select("text", "sketch").collect()
    for r in got:
        assert r.sketch == sketch(r.text)


def test_estimates(spark):
    row = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5], [])], "a array<long>, b array<long>, c array<long>")
    got = row.select(likeness(F.col("a"), F.col("b")), likeness(F.col("c"), F.col("c")), likeness(F.col("a"), F.col("c")), containment(F.col("a"), F.col("b")), containment(F.col("c"), F.col("a")), merge(F.col("a"), F.col("b"))).first()
    assert tuple(got) == (0.4, 1.0, 0.0, pytest.approx(2 / 3), 1.0, [1, 2, 3, 4, 5])


@pytest.mark.parametrize("ids", [[3], [5, 1], [7, 7, 7], list(range(0, 400, 3)) + [10**15, -(10**12)], [None, 4, None, 9]])
@pytest.mark.parametrize("fan", [3, 256])
def test_next_in_descending_order(make_docs, ids, fan):
    rows = [(i, f"t{n}") for n, i in enumerate(ids)]
    got = with_next(make_docs(rows, extra=True), "doc_id", ["text"], rows_per_bucket=5, fan=fan).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t in rows)
    ids_of = {t: i for i, t in rows}
    order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
    follow = Counter(zip(order, [*order[1:], order[0]], strict=True))
    assert Counter((r.doc_id, ids_of[r.next_text]) for r in got) == follow
    assert len({r.next_text for r in got}) == len(rows)  # one circle


def test_merged_sketches_are_sketches_of_the_union(make_docs, prose, spark):
    texts = [t for _, t in prose if t][:40] + ["a", "b", "c d", "e f g", ""]
    pairs = [(2 * i, a + "\n\n" + b, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False))]
    df = spark.createDataFrame([(a, b) for _, _, a, b in pairs], "a string, b string").withColumn("__words", F.lit(1)).withColumn("sketch", F.lit(2))
    both = fingerprint_documents(fingerprint_documents(df, "a", "sa"), "b", "sb")
    for r in both.select("*", merge(F.col("sa"), F.col("sb")).alias("m")).collect():
        assert r.m == reduced(all_hashes(r.a) | all_hashes(r.b)) and (r["__words"], r.sketch) == (1, 2)


def test_op5_against_brute_force(spark, make_docs, prose, tmp_path):
    rows = [(i, t) for i, t in prose if i is not None and i != 407] + [(-5, "é" * 7), (10**12, "a b"), (10**12 + 1, None)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op5_fingerprint(spark, str(tmp_path)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    like = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    text_of = lambda hashes: "".join(f"{h:012x}" for h in hashes)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = sketch(t), sketch(edited), sketch(after)
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), like(a, b), like(a, c))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == want


def test_next_of_nothing(make_docs):
    assert with_next(make_docs([]), "doc_id", ["text"]).count() == 0


# -- quality ---------------------------------------------------------------------------


def statistics(text):
    words = WORD.findall(text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(runs)
    covered = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(make_docs, prose):
    rows = [*prose, (900, "a\na\n \n\nb\na"), (901, "#$ <b> " * 9), (902, "a b c d e f g h i a b c d e f g h"), (903, "x " * 8)]
    got = quality.base_statistics(make_docs(rows, extra=True)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *statistics(t)) for i, t in rows), key=repr)


def test_outliers_go_and_clean_texts_stay(make_docs):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(rng.randint(25, 300))), ("en", "de", None)[i % 3], "s1", 1) for i in range(600)]
    junk = [(1000 + i, " ".join(word() + "%%%" for _ in range(120)), "en", "s1", 1) for i in range(30)]
    few = [(2000 + i, " ".join(word() for _ in range(50)), "fr", f"t{i}", 1) for i in range(5)]
    got = {r.doc_id: r for r in quality.quality_rules(make_docs([*clean, *junk, *few, (3000, None), (3001, "short")])).collect()}
    assert all(got[i].kept for i, *_ in clean + few)
    assert not any(got[i].kept for i, *_ in junk)
    assert got[3000].base_failed and not got[3000].kept and got[3001].base_failed
    assert quality.quality_rules(make_docs([])).count() == 0
    assert [r.kept for r in quality.quality_rules(make_docs([(1, "a b " * 3), (2, None)])).collect()] == [False, False]


def brute_distances(rows):
    """The estimates of all three levels with NumPy: exact quantiles, full matrices."""
    q = lambda x, p: np.sort(x)[int(np.ceil(p * len(x))) - 1]
    stats = [(lang, source, *statistics(t)) for _, t, lang, source, _ in rows]
    ok = [s[2] >= 20 and 100 * s[6] <= 30 * s[2] for s in stats]
    keys = {}
    for k, (s, good) in enumerate(zip(stats, ok, strict=True)):
        if good:
            for key in ((), (s[0],), (s[0], s[1])):
                keys.setdefault(key, []).append(k)
    length = np.array([np.log(max(s[3], 1) / max(s[2], 1)) for s in stats])
    center = {}
    for key in sorted(keys, key=len):
        own, n = q(length[keys[key]], 0.5), len(keys[key])
        center[key] = own if not key else (n * own + quality.PRIOR_ROWS * center[key[:-1]]) / (n + quality.PRIOR_ROWS)

    def features(k, key):
        n = max(stats[k][2], 1)
        return [(length[k] - center[key]) * min(n, 400) ** 0.5, (stats[k][4] / n) ** 0.5, (stats[k][5] / n**0.5) ** 0.5, (stats[k][6] / n) ** 0.5]

    x = {key: np.array([features(k, key) for k in members]) for key, members in keys.items()}
    floors = np.diag(np.array(quality.FLOORS) ** 2)

    def estimates(cores, scale):
        out, moments = {}, {}
        for key in sorted(cores, key=len):
            n, s, p = len(cores[key]), cores[key].sum(axis=0), cores[key].T @ cores[key]
            if key:
                n0, s0, p0 = moments[key[:-1]]
                n, s, p = n + quality.PRIOR_ROWS, s + s0 / n0 * quality.PRIOR_ROWS, p + p0 / n0 * quality.PRIOR_ROWS
            moments[key] = n, s, p
            out[key] = s / n, (p / n - np.outer(s / n, s / n)) * scale + floors
        return out

    def distance(values, estimate):
        away = values - estimate[0]
        return (away * np.linalg.solve(estimate[1], away.T).T).sum(axis=1)

    starts = [{}, estimates(x, 1.0)]
    for key, values in x.items():
        m = np.array([q(c, 0.5) for c in values.T])
        mad = np.array([q(np.abs(c - mm), 0.5) for c, mm in zip(values.T, m, strict=True)])
        starts[0][key] = m, np.diag((1.4826 * mad) ** 2) + floors
    final, before = [], None
    for _ in range(quality.MAX_STEPS):
        final = []
        for at, current in enumerate(starts):
            cores, edge = {}, {}
            for key in sorted(x, key=len):
                d, n = distance(x[key], current[key]), len(x[key])
                edge[key] = q(d, quality.CORE_SHARE)
                if key:
                    edge[key] = (n * edge[key] + quality.PRIOR_ROWS * edge[key[:-1]]) / (n + quality.PRIOR_ROWS)
                cores[key] = x[key][d <= edge[key]]
            starts[at] = estimates(cores, quality.CONSISTENCY)
            final += [np.log(np.linalg.det(starts[at][key][1])) / 2 for key in x]
        if before is not None and np.abs(np.array(final) - before).max() <= quality.SETTLED:
            break
        before = np.array(final)
    out = {}
    for key, members in keys.items():
        if len(key) == 2:
            best = min((np.linalg.det(s[key][1]), at) for at, s in enumerate(starts))[1]
            out |= dict(zip(members, distance(x[key], starts[best][key]), strict=True))
    return [out.get(k) for k in range(len(rows))]


def test_distances_against_brute_force(make_docs):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.randint(15, 120))]
        for _ in range(rng.choice([0, 0, 1, 5])):
            words[rng.randrange(len(words))] = rng.choice(["#", "50%", "a|b", "<x>"])
        text = " ".join(words) + rng.choice(["", "\n" + " ".join(words[:9]) + "\nx\nx"])
        rows.append((i, text, rng.choice(["en", "en", "de", None]), f"s{min(rng.randrange(60), 7)}", 1))
    rows += [(900, " ".join(word() + "%%%" for _ in range(80)), "en", "alone", 1), (901, None, "en", "s1", 1), (902, "few words", "fr", None, 1)]
    got = {r.doc_id: r for r in quality.quality_rules(make_docs(rows)).collect()}
    for (i, *_), want in zip(rows, brute_distances(rows), strict=True):
        assert got[i].distance2 == (None if want is None else pytest.approx(want, rel=1e-6, abs=1e-9))
        assert got[i].kept == (want is not None and want <= quality.CUT)
    assert not got[900].kept  # the only one of its source


