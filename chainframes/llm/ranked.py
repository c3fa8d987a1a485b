"""Ranked lexical search over impact lists, by best positions.

The corpus is read once into an index of the terms that are asked for.  Searching
takes a batch of the index at a time: its impact lists (one per term, highest
impact first) are read from the top, every document met is looked up in the other
lists directly, and each list's *best position*, up to which all its entries have
been met by either way, gives what a document not met yet can still score.  A
query ends in a batch when that is strictly below its k-th score so far, so that
ties are never lost.  The best of every task meet at the end.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

TOP = 20
#: Entries of each list that are read in a query's first round; doubled in each further one.
FIRST_ROUND = 32
#: Query terms (repeats included) that one pass over the corpus answers.
BLOCK_TERMS = 500_000
_ABSENT_ID = np.iinfo(np.int64).max
_INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"


def _fold() -> bytes:
    """A byte table: A-Z to a-z, other ASCII letters, digits and bytes of longer
    characters as they are, all else to a blank."""
    table = bytearray(b" " * 48 + bytes(range(48, 58)) + b" " * 7 + bytes(range(97, 123)) + b" " * 6 + bytes(range(97, 123)) + b" " * 5)
    return bytes(table) + bytes(range(128, 256))


_FOLD = _fold()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters, digits and characters beyond
    ASCII, with A-Z lower-cased."""
    return text.encode("utf-8").translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class Query:
    """One item: which terms it holds, and how often."""

    item_id: int | None
    terms: dict[bytes, int]


def query_blocks(items: DataFrame) -> Iterator[list[Query]]:
    """Items in blocks of ``BLOCK_TERMS`` terms.  Rows of one ``item_id`` are one
    item with the terms of all of them."""
    grouped = items.groupBy("item_id").agg(F.collect_list("text").alias("texts")).orderBy("item_id")
    block, size = [], 0
    for row in grouped.toLocalIterator():
        found = Counter(t for text in row["texts"] for t in terms_of(text))
        if not found:
            continue
        if block and size + found.total() > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append(Query(row["item_id"], dict(found)))
        size += found.total()
    if block:
        yield block


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text``) as its number of terms and the
    counts of the vocabulary's terms in it."""
    lookup = vocabulary.get

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, tfs, sizes = [], [], [], [0]
            for text in batch.column(1):
                found = terms_of(text.as_py())
                counted = Counter(map(lookup, found))
                counted.pop(None, None)
                n.append(len(found))
                ids.extend(counted)
                tfs.extend(counted.values())
                sizes.append(len(ids))
            at = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(rows, _INDEX)


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all their terms, and documents per vocabulary term."""

    documents: int
    terms: int
    df: np.ndarray


def statistics(index: DataFrame, size: int) -> Statistics:
    """Counts over the whole index; the driver gets one number per vocabulary term."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "df"])

    whole = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(size, np.int64)
    for row in index.select("terms").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]
    return Statistics(whole["documents"], whole["terms"], df)


def term_weights(stats: Statistics) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * stats.documents + 2) / (2 * int(d) + 1))) if d else 0 for d in stats.df], np.int64)


class Shard:
    """The impact lists of one batch of the index."""

    def __init__(self, batch: pa.RecordBatch, stats: Statistics, weights: np.ndarray):
        ids = batch.column(0)
        self.doc_id = ids.fill_null(_ABSENT_ID).to_numpy(zero_copy_only=False)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        lists = batch.column(2)
        term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        m = 100 - 25 + (25 * n * stats.documents) // max(1, stats.terms)
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
        # by term and impact: the lists; by term and row: direct access
        order = np.lexsort((row, -impact, term))
        self.rows, self.impacts = row[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.n_rows = max(1, len(n))
        key = term[order] * self.n_rows + self.rows
        self.place = np.argsort(key, kind="stable")
        self.keys = key[self.place]
        self.met = np.zeros(len(key), bool)

    def lookup(self, terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct accesses: for each term and row the position in the lists, and
        whether the row is there."""
        wanted = (terms[:, None] * self.n_rows + rows[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.place[at].reshape(len(terms), -1), (self.keys[at] == wanted).reshape(len(terms), -1)


class Best:
    """The best documents of one query so far."""

    def __init__(self) -> None:
        self.doc_id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, doc_id: np.ndarray, score: np.ndarray) -> None:
        doc_id, score = np.concatenate([self.doc_id, doc_id[score > 0]]), np.concatenate([self.score, score[score > 0]])
        kept = np.lexsort((doc_id, -score))[:TOP]
        self.doc_id, self.score = doc_id[kept], score[kept]

    def settled(self, threshold: int) -> bool:
        """Whether no document that can score ``threshold`` at most belongs here."""
        return threshold <= 0 or (len(self.score) == TOP and threshold < self.score[-1])


def best_positions(shard: Shard, terms: np.ndarray, often: np.ndarray, best: Best) -> int:
    """One query over one shard; returns how many entries were read in order."""
    start, end = shard.starts[terms], shard.starts[terms + 1]
    used = end > start
    terms, often, start, end = terms[used], often[used], start[used], end[used]
    if not len(terms):
        return 0
    position = start.copy()  # first entry of each list that was not met
    read, step, sequential = np.zeros(shard.n_rows, bool), FIRST_ROUND, 0
    depth = 0
    while True:
        parts = [shard.rows[s + depth : min(s + depth + step, e)] for s, e in zip(start, end, strict=True)]
        sequential += sum(map(len, parts))
        rows = np.unique(np.concatenate(parts))
        rows = rows[~read[rows]]
        read[rows] = True
        depth, step = depth + step, step * 2
        if len(rows):
            at, there = shard.lookup(terms, rows)
            shard.met[at[there]] = True
            best.add(shard.doc_id[rows], (np.where(there, shard.impacts[at], 0) * often[:, None]).sum(axis=0))
        threshold = 0
        for i, (p, e) in enumerate(zip(position, end, strict=True)):
            ahead = shard.met[p:e]
            p = position[i] = e if ahead.all() else p + int(np.argmin(ahead))
            if p < e:
                threshold += int(often[i]) * int(shard.impacts[p - 1])
        if best.settled(threshold):
            break
    for s, e in zip(start, end, strict=True):
        shard.met[s:e] = False
    return sequential


def search(index: DataFrame, queries: list[Query], vocabulary: dict[bytes, int], stats: Statistics) -> DataFrame:
    """``query`` (its number), ``doc_id, score`` and ``rank`` of each query's best."""
    weights = term_weights(stats)
    compiled = [(np.array([vocabulary[t] for t in q.terms], np.int64), np.array(list(q.terms.values()), np.int64)) for q in queries]
    compiled = [(t[weights[t] > 0], o[weights[t] > 0]) for t, o in compiled]

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in compiled]
        for batch in batches:
            shard = Shard(batch, stats, weights)
            for (terms, often), b in zip(compiled, best, strict=True):
                best_positions(shard, terms, often, b)
        held = [(i, b) for i, b in enumerate(best) if len(b.score)]
        if held:
            number = np.repeat([i for i, _ in held], [len(b.score) for _, b in held])
            doc_id, score = (np.concatenate([getattr(b, c) for _, b in held]) for c in ("doc_id", "score"))
            ids = pa.array(doc_id, mask=doc_id == _ABSENT_ID)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), ids, pa.array(score)], ["query", "doc_id", "score"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    met = index.where("n > 0").mapInArrow(tops, "query long, doc_id long, score long")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ``TOP`` best documents of every item: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id`` (whole numbers below 2 ** 63 - 1) and ``text``,
    ``items`` ``item_id`` and ``text``; further columns are not read.  Null and
    empty texts have no terms: such documents count nowhere and are never found,
    such items find nothing.  Every row of ``docs`` is a document: repeated ones
    take ranks of their own, null ids stand behind equal scores.  Rows of one
    ``item_id`` are one item.  Empty tables give no rows.  Texts are read whole,
    each in one row; a task holds one batch of the index and ``TOP`` documents
    per item."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for queries in query_blocks(items):
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for q in queries for t in q.terms))}
        index = materialize(build_index(docs, vocabulary))
        found = search(index, queries, vocabulary, statistics(index, len(vocabulary)))
        names = spark.createDataFrame([(i, q.item_id) for i, q in enumerate(queries)], "query long, item_id long")
        out = out.unionByName(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM words WHERE len(terms) > 0),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
often AS (SELECT item_id, term, count(*) AS q FROM asked GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM words) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
impact AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact
  FROM tf JOIN weight USING (term), total WHERE term IN (SELECT term FROM often)),
scored AS (SELECT item_id, doc_id, r, CAST(sum(q * impact) AS BIGINT) AS score FROM impact JOIN often USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
