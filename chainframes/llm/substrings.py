"""Removal of passages that occur more than once, with phrase automata.

A window is ``WINDOW`` consecutive words.  Texts are dealt to chunks of a few
hundred documents; a chunk is one group of a cogrouped step, and the shuffled
texts are reused by every step.

1. Every window has a *phrase*: the run of ``PHRASE`` of its words whose hash is
   smallest.  Equal windows have equal phrases, and neighbouring windows mostly
   share theirs, so only one in fourteen positions is a phrase.  Phrases are
   counted over the corpus; those seen once are dropped.  The others are written
   to the shared folder, and the shuffles of the count go before texts are dealt.
2. Windows whose phrase recurs are hashed (95 bits), summed inside a chunk, and
   counted over the corpus.  This confirms the recurring windows; each chunk is
   told which of its windows they are, by the place of one occurrence.
3. Each chunk joins these into passages, compiles an Aho-Corasick automaton of
   their phrases, and streams all its documents through it.  The windows around
   every phrase found are looked up among the confirmed ones and compared word
   by word, and the words of those that agree are removed.

A chunk's automaton holds phrases of its own texts only, so shards stay small
at any corpus size, every document passes through exactly one of them, and a
passage found everywhere costs each chunk one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import run_hashes, span_hashes, utf8, word_spans
from .common import documents, dropping_shuffles, materialize, refuse_clashes, text_or_empty, words

WINDOW = 35
PHRASE = 8
DOCS_PER_CHUNK = 400
#: Bytes of text that are hashed at once.
PIECE_BYTES = 1 << 21


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values."""
    if len(x) < n:
        return x[:0]
    out, have = x, 1
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - have : n - have + len(x) - n + 1])


def phrase_hashes(hashes: np.ndarray) -> np.ndarray:
    """The phrase hash of every window of one text's word hashes."""
    return sliding_min(run_hashes(hashes, PHRASE), WINDOW - PHRASE + 1)


def _texts(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, raw bytes, word hashes) of every text, hashed some MB at a time."""
    raw, offsets = utf8(column)
    n, begin = len(offsets) - 1, 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PIECE_BYTES, side="right")) - 1)
        part = raw[offsets[begin] : offsets[end]]
        first, last, at = word_spans(part, offsets[begin : end + 1] - offsets[begin])
        hashes = span_hashes(part, first, last)
        for i in range(begin, end):
            yield i, raw[offsets[i] : offsets[i + 1]], hashes[at[i - begin] : at[i - begin + 1]]
        begin = end


def _phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, phrase, n): how often each text's phrases occur in it."""
    for batch in batches:
        chunk = batch.column(0).to_numpy()
        where, phrases, counts = [], [], []
        for i, _, hashes in _texts(batch.column(1)):
            own = np.unique(phrase_hashes(hashes))
            if len(own):
                runs, n = np.unique(run_hashes(hashes, PHRASE), return_counts=True)
                phrases.append(own)
                counts.append(n[np.searchsorted(runs, own)])
                where.append(np.full(len(own), chunk[i]))
        if where:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(where).astype(np.int32)),
                    pa.array(np.concatenate(phrases).view(np.int64)),
                    pa.array(np.minimum(np.concatenate(counts), 2).astype(np.int32)),
                ],
                ["chunk", "phrase", "n"],
            )


def _in_order(docs: pa.Table) -> pa.Table:
    """Rows by their hash: the same places of words in every step."""
    return docs.take(pa.array(np.argsort(docs.column("rid").to_numpy(), kind="stable")))


_WINDOW_SCHEMA = "h1 long, h2 int, n int, place long"


def _window_rows(docs: pa.Table, recurring: pa.Table) -> pa.Table:
    """Distinct windows of a chunk whose phrase recurs: hashes, count (2 stands
    for more) and place = chunk * 2**32 + number of words before the first one."""
    kind = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("n", pa.int32()), ("place", pa.int64())])
    if not docs.num_rows or not recurring.num_rows:
        return kind.empty_table()
    wanted = np.unique(recurring.column("phrase").to_numpy()).view(np.uint64)
    wanted.sort()
    base = int(docs.column("chunk")[0].as_py()) << 32
    h1, h2, place, before = [], [], [], 0
    for _, _, hashes in _texts(_in_order(docs).column("text")):
        phrases = phrase_hashes(hashes)
        if len(phrases):
            at = np.searchsorted(wanted, phrases)
            at[at == len(wanted)] = 0
            hit = np.flatnonzero(wanted[at] == phrases)
            if len(hit):
                h1.append(run_hashes(hashes, WINDOW, 3)[hit])
                h2.append(run_hashes(hashes, WINDOW, 5)[hit])
                place.append(hit + before)
        before += len(hashes)
    if not h1:
        return kind.empty_table()
    a, b, c = np.concatenate(h1), np.concatenate(h2) >> np.uint64(33), np.concatenate(place)
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    begins = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    counts = np.minimum(np.diff(np.r_[begins, len(a)]), 2)
    return pa.table(
        [
            pa.array(a[begins].view(np.int64)),
            pa.array(b[begins].astype(np.int32)),
            pa.array(counts.astype(np.int32)),
            pa.array(c[begins] + base),
        ],
        schema=kind,
    )


def passages(places: np.ndarray, doc_begins: np.ndarray) -> list[tuple[int, int]]:
    """Joins window places (in order) into runs of words (first, end) that stay
    inside one document."""
    if not len(places):
        return []
    doc = np.searchsorted(doc_begins, places, side="right")
    cut = np.flatnonzero((np.diff(places) > 1) | (np.diff(doc) > 0)) + 1
    first = places[np.r_[0, cut]]
    last = places[np.r_[cut - 1, len(places) - 1]]
    return [(int(a), int(b) + WINDOW) for a, b in zip(first, last, strict=True)]


def phrase_places(hashes: np.ndarray) -> np.ndarray:
    """Where a passage's windows have their phrases: first words, distinct."""
    runs = run_hashes(hashes, PHRASE)
    n = WINDOW - PHRASE + 1
    views = np.lib.stride_tricks.sliding_window_view(runs, n)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def covered_words(ids: np.ndarray, texts: list[list[bytes]], begins: np.ndarray, places: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """Marks the words of a chunk that lie in a recurring window.

    ``ids`` are exact word numbers of all texts in a row, ``begins`` the first
    word of each text (and the end), ``places`` (in order) one occurrence of
    each recurring window.  The automaton finds phrases; every window around a
    phrase found is looked up once by its hash, whatever the number of passages
    with that phrase, and compared word by word with the occurrence held."""
    import ahocorasick

    marked = np.zeros(len(ids) + 1, dtype=np.int32)  # +1 opens a stretch, -1 ends one
    automaton = ahocorasick.Automaton()
    known = []
    for a, b in passages(places, begins[:-1]):
        doc = int(np.searchsorted(begins, a, side="right")) - 1
        text, at = texts[doc], int(begins[doc])
        own = hashes[doc][a - at : b - at]
        known.append(run_hashes(own, WINDOW, 3))
        for p in phrase_places(own).tolist():
            automaton.add_word((b" " + b" ".join(text[a - at + p : a - at + p + PHRASE]) + b" ").decode("latin-1"), 1)
    if not known:
        return marked[:-1].astype(bool)
    automaton.make_automaton()
    held = np.concatenate(known)
    order = np.argsort(held, kind="stable")
    held, spots = held[order], places[order]
    reach = WINDOW - PHRASE
    words = np.arange(WINDOW)
    for doc, text in enumerate(texts):
        n = len(text) - WINDOW + 1  # windows
        if n < 1:
            continue
        line = (b" " + b" ".join(text) + b" ").decode("latin-1")
        found = np.fromiter((end for end, _ in automaton.iter(line)), dtype=np.int64)
        if not len(found):
            continue
        ends = np.cumsum([len(w) + 1 for w in text])  # place of the blank after each word
        at = np.searchsorted(ends, found) - (PHRASE - 1)
        around = np.zeros(n + 1, dtype=np.int32)
        np.add.at(around, np.maximum(at - reach, 0), 1)
        np.add.at(around, np.minimum(at, n - 1) + 1, -1)
        windows = np.flatnonzero(np.cumsum(around[:-1]) > 0)
        wanted = run_hashes(hashes[doc], WINDOW, 3)[windows]
        k = np.searchsorted(held, wanted)
        k[k == len(held)] = 0
        hit = np.flatnonzero(held[k] == wanted)
        begin = int(begins[doc])
        for part in np.array_split(hit, len(hit) // 65536 + 1):
            here, there = windows[part] + begin, spots[k[part]]
            same = (ids[here[:, None] + words] == ids[there[:, None] + words]).all(axis=1)
            np.add.at(marked, here[same], 1)
            np.add.at(marked, here[same] + WINDOW, -1)
    return np.cumsum(marked[:-1]) > 0


def _remove(keep: list[str]):
    """Texts of a chunk without the words of recurring windows."""

    def run(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        docs = _in_order(docs)
        raws, hashes = [], []
        for _, raw, own in _texts(docs.column("text")):
            raws.append(raw)
            hashes.append(own)
        begins = np.cumsum([0, *(len(h) for h in hashes)])
        total = int(begins[-1])
        gone = np.zeros(total, dtype=bool)
        if confirmed.num_rows:
            places = np.unique(confirmed.column("place").to_numpy() & 0xFFFFFFFF)
            texts = [r.tobytes().split() for r in raws]
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), dtype=np.int64, count=total)
            gone = covered_words(ids, texts, begins, places, hashes)
        out, removed = [], []
        for i, raw in enumerate(raws):
            mine = gone[begins[i] : begins[i + 1]]
            n = int(mine.sum())
            removed.append(n)
            if n:
                first, last, _ = word_spans(raw, np.array([0, len(raw)]))
                edge = np.diff(np.r_[True, mine, True].astype(np.int8))
                starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
                out.append(b" ".join(raw[first[a] : last[b - 1]].tobytes() for a, b in zip(starts, ends, strict=True)).decode("utf-8"))
            else:
                out.append(raw.tobytes().decode("utf-8"))
        return pa.table(
            [*(docs.column(c) for c in keep), pa.array(out, pa.string()), pa.array(np.diff(begins)), pa.array(removed, pa.int64())],
            names=[*keep, "kept_text", "n_words", "n_removed"],
        )

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``kept_text, n_words, n_removed`` for every row.

    Removed is each word in a window whose words also start anywhere else, in
    the same text or another; windows are judged on the input.  Texts that lose
    nothing come back as they are (null: empty); in others, stretches that stay
    keep their own white space and are joined by one blank.  Texts of fewer
    than ``WINDOW`` words lose nothing.  Repeated rows are copies of each other
    and lose all their windows.  An empty table gives no rows.  Further columns are
    not read, and ``keep`` may not hold a name of the added ones."""
    refuse_clashes(keep, ("kept_text", "n_words", "n_removed"))
    n_chunks = max(1, -(-docs.count() // DOCS_PER_CHUNK))
    names = [f"k{i}" for i in range(len(keep))]
    rid = F.xxhash64(*[F.col(c) for c in keep], F.col(text_col))
    dealt = docs.select(
        F.pmod(rid, F.lit(n_chunks)).cast("int").alias("chunk"),
        rid.alias("rid"),
        text_or_empty(text_col).alias("text"),
        *[F.col(c).alias(k) for c, k in zip(keep, names, strict=True)],
    )
    phrases = dealt.select("chunk", "text").mapInArrow(_phrase_rows, "chunk int, phrase long, n int")
    phrases = phrases.groupBy("phrase", "chunk").agg(F.sum("n").alias("n"))
    seen = Window.partitionBy("phrase")
    with dropping_shuffles(docs.sparkSession):
        recurring = materialize(phrases.withColumn("all", F.sum("n").over(seen)).where("all > 1").select("chunk", "phrase"))
    chunks = dealt.groupBy("chunk")
    windows = chunks.cogroup(recurring.groupBy("chunk")).applyInArrow(_window_rows, _WINDOW_SCHEMA)
    same = Window.partitionBy("h1", "h2")
    confirmed = (
        windows.withColumn("all", F.sum("n").over(same))
        .where("all > 1")
        .select(F.shiftright("place", 32).cast("int").alias("chunk"), "place")
    )
    kinds = dict(dealt.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in names] + ["kept_text string, n_words long, n_removed long"])
    out = chunks.cogroup(confirmed.groupBy("chunk")).applyInArrow(_remove(names), schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "kept_text", "n_words", "n_removed")


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words(F.col("kept_text")), " "), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS win
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS i FROM w WHERE len(words) >= 35)),
hit AS (
  SELECT doc_id, i FROM starts WHERE win IN (SELECT win FROM starts GROUP BY win HAVING count(*) > 1)),
gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM hit)),
places AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words))) AS p FROM w WHERE len(words) > 0),
kept AS (
  SELECT a.doc_id, string_agg(a.words[a.p], ' ' ORDER BY a.p) AS kept, count(*) AS n
  FROM places a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p WHERE g.p IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
       CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
