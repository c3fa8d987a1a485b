import random

import numpy as np
import pytest

from chainframes.llm.language import BUCKETS, UNKNOWN, code_matrix, gram_counts, has_letter, identify_languages, learn_languages
from chainframes.llm.toxicity import GAP, MAX_E, TOKEN, ToxicityModel, fit_extreme_values, learn_toxicity, maximal_segments, score_toxicity, token_features

SYLLABLES = {"aa": ["the", "ing", "and", "wh"], "bb": ["ung", "sch", "ein", "ü"], "cc": ["eau", "que", "é", "oi"], "dd": ["ción", "ado", "ll", "ñ"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [(i, text(rng, lang, rng.randint(3, 80)), lang, "s", 1) for i, lang in enumerate(list(SYLLABLES) * 60)]


def test_languages(make_docs, texts):
    model = learn_languages(make_docs([*texts[:160], (900, None, "aa", "s", 1), (901, "x", None, "s", 1)], extra=True))
    odd = [(910, None), (911, ""), (912, "123 !?"), (913, "日本語"), (None, texts[0][1])]
    got = {r.doc_id: r for r in identify_languages(make_docs([*texts[160:], *odd], extra=True), model).collect()}
    truth = {i: lang for i, _, lang, *_ in texts[160:]}
    assert np.mean([got[i].lang_pred == lang for i, lang in truth.items()]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (910, 911, 912):
        assert (got[i].lang_pred, got[i].score, got[i].ambiguous) == (UNKNOWN, 0.0, True)
    assert got[913].lang_pred != UNKNOWN and got[None].lang_pred == "aa"
    assert identify_languages(make_docs([]), model).count() == 0


def test_few_languages(make_docs, texts):
    none = learn_languages(make_docs([(1, "x")]))
    assert identify_languages(make_docs(texts[:3]), none).first().lang_pred == UNKNOWN
    one = learn_languages(make_docs([t for t in texts if t[2] == "aa"]))
    assert {r.lang_pred for r in identify_languages(make_docs(texts[:8]), one).collect()} == {"aa"}
    assert learn_languages(make_docs([])).languages == []


def test_codes_and_grams():
    for n in (2, 4, 30):
        codes = code_matrix(n)
        apart = (codes[:, None] != codes[None]).sum(axis=2)[np.triu_indices(n, 1)]
        assert apart.min() >= 2
    raw = lambda s: np.frombuffer(s.encode(), np.uint8)
    assert (gram_counts(raw("ÉTÉ Ab")) == gram_counts(raw("été aB"))).all() and gram_counts(raw("")).shape == (BUCKETS,)
    assert has_letter(raw("é")) and not has_letter(raw("١٢ 12 €"))


def plain_grams(text):
    """Buckets of all 1-, 2- and 3-grams, one by one."""
    low = {**{c: c + 32 for c in range(65, 91)}, **{c: 32 for c in range(128) if not 97 <= c <= 122 and not 65 <= c <= 90}}
    raw = list(text.encode())
    out = []
    for i, c in enumerate(raw):
        if i and raw[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97:
            out.append(c + 32)
        else:
            out.append(low.get(c, c))
    found = []
    for k in (1, 2, 3):
        for i in range(len(out) - k + 1):
            gram = out[i : i + k]
            if any(c != 32 for c in gram):
                value = int.from_bytes(bytes(gram), "big")
                found.append(value if k == 1 else ((value + ((k - 1) << 24)) * 2654435761 & 0xFFFFFFFF) >> (32 - BUCKETS.bit_length() + 1))
    return found


def test_languages_against_brute_force(make_docs, texts):
    learned, asked = texts[:100], texts[100:140]
    model = learn_languages(make_docs(learned))
    rates = {}
    for lang in model.languages:
        grams = [g for _, t, own, *_ in learned if own == lang for g in plain_grams(t)]
        rates[lang] = ({g: grams.count(g) / len(grams) for g in set(grams)}, len(grams))
    floor = 0.5 / np.mean([n for _, n in rates.values()])

    def weight(gram, bit):
        sides = []
        for sign in (1, -1):
            own = [rates[lang][0].get(gram, 0.0) for lang, code in zip(model.languages, model.codes, strict=True) if code[bit] == sign]
            sides.append(np.log(sum(own) / len(own) + floor))
        return sides[0] - sides[1]

    got = {r.doc_id: r for r in identify_languages(make_docs(asked), model).collect()}
    for i, t, *_ in asked:
        grams = plain_grams(t)
        margins = [np.mean([weight(g, b) for g in grams]) for b in range(model.codes.shape[1])]
        losses = [sum(w * np.log1p(np.exp(-model.scale * m * c)) for m, c, w in zip(margins, code, model.bit_weights, strict=True)) for code in model.codes]
        share = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        assert got[i].lang_pred == model.languages[int(np.argmin(losses))]
        assert got[i].score == pytest.approx(share.max()) and got[i].fit == pytest.approx(1 - min(losses) / (np.log(2) * sum(model.bit_weights)))


def test_very_many_languages_are_all_learned(make_docs):
    rng = random.Random(2)
    rows = []
    for k in range(700):  # each with words of its own
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)]
        rows += [(3 * k + i, " ".join(rng.choice(own) for _ in range(30)), f"l{k:03d}", "s", 1) for i in range(2)]
    model = learn_languages(make_docs(rows))
    assert len(model.languages) == 700
    got = {r.doc_id: r.lang_pred for r in identify_languages(make_docs(rows), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang, *_ in rows]) > 0.9
    with pytest.raises(ValueError):
        identify_languages(make_docs(rows), model, keep=("doc_id", "score"))


def brute_segments(scores):
    def best(low, high):
        if low >= high:
            return []
        total, found = -1e18, None
        for i in range(low, high):
            s = 0.0
            for j in range(i, high):
                s += scores[j]
                if s > total + 1e-12:
                    total, found = s, (i, j + 1)
        if total <= 1e-12:
            return []
        return [*best(low, found[0]), (*found, total), *best(found[1], high)]

    return best(0, len(scores))


def test_segments_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(0, 24)
        hits = [(i, rng.choice([1, 1, -1]) * rng.uniform(0.1, 3)) for i in range(n) if rng.random() < 0.4]
        scores = [-0.4321] * n
        for i, s in hits:
            scores[i] = s
        got = [(a, b, round(s, 9)) for a, b, s in maximal_segments(hits, 0.4321)]
        assert got == [(a, b, round(s, 9)) for a, b, s in brute_segments(scores)]


def test_very_strong_evidence():
    model = ToxicityModel({"=x": 900.0}, lam=2.0, k=1e-3, slope=1.0)
    value, e_values = model.evidence([(0, 1, 900.0), (5, 6, 0.1)], 10)
    assert value == pytest.approx(1800.2 - 2 * np.log(0.01)) and e_values[0] == 0.0 and model.probability(value) > 0.99


def test_constants_of_extreme_values():
    rng = np.random.default_rng(3)
    n = rng.integers(20, 2000, 20_000)
    largest = np.maximum((np.log(n * 1e-3) - np.log(-np.log(rng.random(len(n))))) / 0.7, 0.0)
    lam, k = fit_extreme_values(n, largest, 2.0)
    assert lam == pytest.approx(0.7, rel=0.05) and k == pytest.approx(1e-3, rel=0.1)
    lam, k = fit_extreme_values(np.array([100.0] * 50), np.zeros(50), 2.0)
    assert 0 < lam < 64 and 0 < k < 1
    assert all(np.isfinite(fit_extreme_values(np.zeros(0), np.zeros(0), 1.0)))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows, marks = [], []
    for i in range(900):
        own = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            for bad in rng.sample(["vilest", "zorkish", "zorkets", "zorkum", "krunged"], 2):
                own.insert(rng.randint(0, len(own)), bad)
        rows.append((i, " ".join(own), "en", "s", 1))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxicity_on_held_out_rows(spark, make_docs, labelled):
    rows, marks = labelled
    labels = spark.createDataFrame([*marks[:600], (None, 1), (1, None), (2, 0), (77777, 1)], "doc_id long, toxic int")
    model = learn_toxicity(make_docs(rows, extra=True), labels)
    odd = [(5000, None), (5001, ""), (None, "vilest zorkum"), (5002, "VILEST, krunged! " + rows[1][1])]
    got = {r.doc_id: r for r in score_toxicity(make_docs([*rows[600:], *odd], extra=True), model).collect()}
    truth = dict(marks[600:])
    assert np.mean([(got[i].score >= 0.7) == bool(t) for i, t in truth.items()]) > 0.97
    assert got[5000].score == got[5001].score < 0.3 and got[None].score >= 0.7
    assert [s.start for s in got[5002].segments] == [0] and got[5002].segments[0].end == 15
    assert score_toxicity(make_docs([]), model).count() == 0


def test_scores_against_brute_force(spark, make_docs, labelled):
    rows, marks = labelled
    labels = spark.createDataFrame(marks[:600], "doc_id long, toxic int")
    model = learn_toxicity(make_docs(rows), labels)
    assert learn_toxicity(make_docs(rows[::-1]), labels).probability(5.0) == pytest.approx(model.probability(5.0), rel=1e-9)
    got = {r.doc_id: r for r in score_toxicity(make_docs(rows[600:660]), model).collect()}
    for i, text, *_ in rows[600:660]:
        tokens = TOKEN.findall(text.lower())
        own = []
        for t in tokens:
            found = [model.scores[f] for f in token_features(t) if f in model.scores]
            own.append((max(found) if found and max(found) > 0 else model.scores.get("=" + t, 0.0)) - GAP)
        logs = [np.log(model.k * len(tokens)) - model.lam * s for *_, s in brute_segments(own)]
        evidence = -sum(x for x in logs if x < np.log(MAX_E))
        assert got[i].evidence == pytest.approx(evidence) and got[i].score == pytest.approx(model.probability(evidence))
        assert len(got[i].segments) == sum(x < np.log(MAX_E) for x in logs)


def test_toxicity_without_labels(spark, make_docs, labelled):
    rows, _ = labelled
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert learn_toxicity(make_docs(rows[:5]), none) == ToxicityModel({}, intercept=-40.0)
    clean = spark.createDataFrame([(i, 0) for i in range(5)], "doc_id long, toxic int")
    assert score_toxicity(make_docs(rows[:5]), learn_toxicity(make_docs(rows[:5]), clean)).first().score < 0.01
