import numpy as np
import pytest
from pyspark.sql import functions as F

from chainframes.llm.attribution import attribute, line_lengths, tile, token_counts
from chainframes.llm.packing import WholeTokenizer

tokens = pytest.importorskip("public_tokenizers")
PATH = tokens.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = ["", "  ", " a  b", "a \n b", "foo\n\n bar \t", "it's 'll  've", " a　 b", "日本語 123 😀😀 é", "é  è\r\n  q   ", "x" * 50 + " \n\n\n y"]
MARKS = ["<|endoftext|>", "<|endoftext|> a", "a <|endoftext|> b", "a<|endoftext|>", "a  <|endoftext|>  \n<|endoftext|><|endoftext|>b <|endoftex|>"]


@pytest.mark.parametrize("stretch", [4, 1 << 20])
def test_ids_and_spans_are_those_of_the_whole_text(plain, stretch):
    fast = WholeTokenizer(PATH)
    fast.CHECKED, fast.STRETCH = 0, stretch
    for text in ODD + MARKS + [" ".join(ODD * 3)]:
        want = plain.encode(text, add_special_tokens=False)
        assert fast.ids(text).tolist() == want.ids, repr(text)
        assert [tuple(s) for s in fast.spans(text).tolist()] == want.offsets, repr(text)
    assert 50256 in fast.ids(MARKS[2]) and len(fast.ids(MARKS[2])) == 4


def brute(offsets, borders, rule):
    out = [0.0] * (len(borders) - 1)
    for a, b in offsets:
        chars = list(range(a, max(b, a + 1)))
        owners = [next((i for i in range(len(out)) if borders[i] <= c < borders[i + 1]), len(out) - 1) for c in chars]
        if rule == "share":
            for o in owners:
                out[o] += 1 / len(owners)
        else:
            out[owners[0] if rule == "first" else owners[-1] if rule == "last" else max(sorted(set(owners)), key=owners.count)] += 1
    return out


@pytest.mark.parametrize("rule", ["first", "last", "most", "share"])
def test_rules(rule):
    rng = np.random.default_rng(2)
    for _ in range(60):
        cuts = np.unique(np.r_[0, rng.integers(1, 40, 5), 40])
        starts = np.sort(rng.integers(0, 40, 12))
        spans = np.stack([starts, np.minimum(starts + rng.integers(0, 9, 12), 40)], axis=1)
        counts, _ = attribute(spans, cuts, rule)
        assert counts.tolist() == pytest.approx(brute(spans.tolist(), cuts.tolist(), rule))


def test_tiles():
    borders, where = tile(np.array([[2, 4], [4, 4], [4, 6], [8, 99]]), 10)
    assert borders.tolist() == [0, 2, 4, 6, 8, 10] and where.tolist() == [1, -1, 2, 4]
    with pytest.raises(ValueError):
        tile(np.array([[0, 4], [3, 5]]), 9)


def test_lines_of_documents(make_docs, prose, plain):
    rows = [*prose, (900, "a\n\n\nb b\n"), (901, "\n"), (902, "a <|endoftext|>\nb"), (903, "a\n" * 50_000)]
    docs = make_docs(rows, extra=True).withColumn("text", F.coalesce("text", F.lit("")))
    got = token_counts(docs, PATH, line_lengths(F.col("text")), keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        offsets = plain.encode(r.text, add_special_tokens=False).offsets
        borders = np.cumsum([0, *(len(x) + 1 for x in r.text.split("\n"))])
        borders[-1] = max(len(r.text), 1)
        assert (r.n_tokens, r.outside) == (len(offsets), 0)
        assert [(s.start, s.end) for s in r.sections][:3] == [(a, b) for a, b in zip(borders[:3].tolist(), borders[1:4].tolist(), strict=False)] or len(borders) <= 4
        if r.doc_id == 903:  # many lines: each has its letter and its break
            assert len(r.sections) == 50_001 and {s.tokens for s in r.sections[:-1]} == {2.0}
            continue
        want = brute(offsets, borders.tolist(), "most") if borders[-1] > borders[-2] else None
        if want:
            assert [s.tokens for s in r.sections] == want


def test_attribution_edges(make_docs):
    docs = make_docs([(1, None), (2, "one two three"), (None, "x")])
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    got = {r.doc_id: r for r in token_counts(docs, PATH, none).collect()}
    assert (got[1].n_tokens, got[1].outside, got[1].sections) == (0, 0.0, []) and got[2].outside == got[2].n_tokens == 3
    some = F.array(F.struct(F.lit(4).alias("start"), F.lit(7).alias("end")))
    assert {r.doc_id: [s.tokens for s in r.sections] for r in token_counts(docs, PATH, some).collect()}[2] == [1.0]
    assert token_counts(make_docs([]), PATH, none).count() == 0
    with pytest.raises(ValueError):
        token_counts(docs, PATH, none, rule="odd")
