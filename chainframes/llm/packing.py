"""Best-fit packing by non-negative least squares over length patterns.

Documents are tokenized and cut into pieces of at most one sequence.  Only the
histogram of piece lengths (at most ``capacity`` numbers, however large the
corpus) decides the packing: patterns of up to three lengths that fill a
sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares, rounded down, and what is left is packed best-fit
in runs of equal lengths.  The plan is a list of patterns with repeat counts;
pieces find their place in it by their rank among pieces of their length.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, refuse_clashes

CAPACITY = 2048
END_ID = 0
#: Shares of the fitted repeat counts that are tried; the rest is packed best-fit.
SHARES = (1.0, 0.75, 0.5, 0.25)


# -- tokens ----------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes:
    printable Latin-1 stands for itself, the rest for U+0100 onwards in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class WholeTokenizer:
    """Ids and character spans as the ``tokenizers`` file gives them.

    A text in which an added token (such as an end mark) is spelled out goes
    through ``tokenizers`` itself, which gives that token's id, and so does one
    with a run of white space that the other engine's stack does not bear.  All
    others are encoded by the ``tiktoken`` engine over the very vocabulary of the
    file, several times as fast.  Each worker encodes its first CHECKED texts by both,
    and a difference is an error."""

    CHECKED = 100
    #: Longer texts are encoded in stretches of about so many characters, cut before
    #: a blank that a character other than white space follows: the pre-tokenizer
    #: never joins text across the front of that blank.
    STRETCH = 1 << 20
    _CUT = re.compile(r" (?=\S)")
    #: Runs of white space from this length on are left to ``tokenizers``.
    LONG_RUN = 100_000
    _RUN = re.compile(r"\s{2,}+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder()
        alphabet = byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in self._tokenizer.get_vocab().items() if i not in added}
        self._added = [t.content for t in added.values()]
        self._engine = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._sizes[list(ranks.values())] = list(map(len, ranks))
        self._left = self.CHECKED

    def _stretches(self, text: str) -> Iterator[tuple[int, str]]:
        """(first character, stretch) pairs that make up the text."""
        at = 0
        while len(text) - at > self.STRETCH:
            cut = self._CUT.search(text, at + self.STRETCH)
            if cut is None:
                break
            yield at, text[at : cut.start()]
            at = cut.start()
        yield at, text[at:]

    def _left_out(self, text: str) -> bool:
        """Whether the text is for ``tokenizers``."""
        if len(text) >= self.LONG_RUN and any(m.end() - m.start() >= self.LONG_RUN for m in self._RUN.finditer(text)):
            return True
        return any(t in text for t in self._added)

    def ids(self, text: str) -> np.ndarray:
        if self._left_out(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        parts = [np.array(self._engine.encode_ordinary(part), dtype="<u4") for _, part in self._stretches(text)]
        found = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if self._left > 0:
            self._left -= 1
            if self._tokenizer.encode(text, add_special_tokens=False).ids != found.tolist():
                raise RuntimeError("the two engines disagree on this vocabulary")
        return found

    def spans(self, text: str) -> np.ndarray:
        """(tokens, 2) starts and ends in code points.  A token that holds a part
        of a character's bytes spans that character."""
        if self._left_out(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        found = []
        for at, part in self._stretches(text):
            sizes = self._sizes[self._engine.encode_ordinary(part)]
            raw = np.frombuffer(part.encode(), np.uint8)
            of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1 + at
            ends = np.cumsum(sizes)
            found.append(np.stack([of_byte[ends - sizes], of_byte[ends - 1] + 1], axis=1) if len(ends) else np.zeros((0, 2), np.int64))
        whole = found[0] if len(found) == 1 else np.concatenate(found)
        if self._left > 0:
            self._left -= 1
            if self._tokenizer.encode(text, add_special_tokens=False).offsets != [tuple(s) for s in whole.tolist()]:
                raise RuntimeError("the two engines disagree on this vocabulary")
        return whole


_tokenizers: dict[str, WholeTokenizer] = {}


def worker_tokenizer(path: str) -> WholeTokenizer:
    """One tokenizer per Python worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WholeTokenizer(path)
    return _tokenizers[path]


def piece_bounds(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but the first, which takes the rest."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    bounds = [(0, first)] if n_tokens else []
    bounds += [(at, capacity) for at in range(first, n_tokens, capacity)]
    return bounds


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``id, piece, start, length, ids_crc32``: every document's ids, ``end_id``
    last, cut into pieces.  Null texts count as empty (one piece of one id).
    Texts are read one by one, so the longest one bounds a worker's memory."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                rows: list[tuple[int, int, int, int, int]] = []
                for i, text in enumerate(texts.slice(at, 256)):
                    ids = encoder.ids(text.as_py() or "").tobytes() + end
                    for piece, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                        rows.append((i, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                where, piece, start, length, crc = (list(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, 256).take(pa.array(where, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long")


# -- the plan ----------------------------------------------------------------


def few_document_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three of the given lengths that fill a sequence
    exactly, as rows of indices into ``lengths`` (-1: no document)."""
    lengths = np.asarray(lengths)
    index = np.full(capacity + 1, -1)
    index[lengths] = np.arange(len(lengths))
    found = []
    if index[capacity] >= 0:
        found.append(np.array([[index[capacity], -1, -1]]))
    for i, a in enumerate(lengths):  # a >= b >= c
        b = lengths[lengths <= min(a, capacity - a)]
        rest = capacity - a - b
        third = np.where((rest > 0) & (rest <= b), index[rest], -1)
        ok = (rest == 0) | (third >= 0)
        if ok.any():
            found.append(np.stack([np.full(ok.sum(), i), index[b[ok]], third[ok]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, tolerance: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2, where column j of A
    counts how often pattern j uses each length.

    Active-set coordinate descent.  The first sweep goes over all patterns from
    zero, longest first length first.  Then the patterns in use are swept until
    they settle, those left out that would lower the sum most come in, and so on
    until none would by more than ``tolerance`` of the largest count: the
    conditions of the optimum.  ``rounds`` only ends a fit that does not settle;
    any x >= 0 gives a right packing."""
    x = np.zeros(len(patterns))
    if not len(patterns):
        return x
    rows = [[i for i in row if i >= 0] for row in patterns.tolist()]
    norm = [float(sum(row.count(i) for i in row)) for row in rows]
    left = [*counts.astype(float).tolist(), 0.0]  # the last one stands for "no document"

    def sweep(order: list[int]) -> float:
        moved = 0.0
        for j in order:
            row, old = rows[j], x[j]
            new = max(0.0, old + sum(left[i] for i in row) / norm[j])
            if new != old:
                x[j] = new
                for i in row:
                    left[i] -= new - old
                moved = max(moved, abs(new - old))
        return moved

    limit = tolerance * float(counts.max())
    steps = np.array(norm)
    sweep(np.argsort(-patterns.max(axis=1), kind="stable").tolist())
    for _ in range(rounds):
        used = np.flatnonzero(x > 0).tolist()
        for _ in range(40):
            if sweep(used) < limit / 4:
                break
        gain = np.array(left)[patterns].sum(axis=1) / steps
        gain[x > 0] = 0.0
        best = np.argsort(-gain)[: len(counts)]
        fresh = best[gain[best] > limit].tolist()
        if not fresh:
            break
        sweep(fresh)
    return x


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram, equal bins moved together."""
    plan: dict[tuple[int, ...], int] = {}
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []  # sorted rooms with open bins

    def put(room: int, made: tuple[int, ...], n: int) -> None:
        if not room:
            plan[made] = plan.get(made, 0) + n
            return
        if room not in open_bins:
            open_bins[room] = {}
            insort(rooms, room)
        open_bins[room][made] = open_bins[room].get(made, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    put(capacity - per * length, (length,) * per, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                left = 0
                continue
            room = rooms[at]
            bins = open_bins[room]
            made, n = next(iter(bins.items()))
            k = min(room // length, left)
            n = min(n, left // k)
            bins[made] -= n
            if not bins[made]:
                del bins[made]
                if not bins:
                    del open_bins[room]
                    rooms.pop(at)
            put(room - k * length, made + (length,) * k, n)
            left -= n * k
    for bins in open_bins.values():
        for made, n in bins.items():
            plan[made] = plan.get(made, 0) + n
    return sorted(plan.items())


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeat count) whose lengths add up to ``counts``.

    Rounding the fit down leaves pieces over, and best-fit packs them the tighter
    the more of them it gets; of a few shares of the fit the best one is kept."""
    counts = {k: v for k, v in counts.items() if v}
    lengths = np.array(sorted(counts), dtype=np.int64)
    patterns = few_document_patterns(lengths, capacity)
    wanted = np.array([counts[int(k)] for k in lengths], dtype=np.int64)
    fitted = fit_repeats(patterns, wanted)
    best: list[tuple[tuple[int, ...], int]] | None = None
    for share in SHARES:
        repeats = np.floor(fitted * share + 1e-6).astype(np.int64)
        plan, left = [], wanted.copy()
        for j in np.flatnonzero(repeats):
            row = [int(i) for i in patterns[j] if i >= 0]
            n = min([int(repeats[j]), *(int(left[i]) // row.count(i) for i in set(row))])
            if n > 0:
                for i in row:
                    left[i] -= n
                plan.append((tuple(int(lengths[i]) for i in row), n))
        plan += best_fit_runs({int(k): int(v) for k, v in zip(lengths, left, strict=True) if v}, capacity)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
    return best or []


def slots_by_length(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, offset, uses per sequence) of each
    stretch of ranks; all sequences of a pattern are numbered in a row."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            found.setdefault(length, []).append((first, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


def _place(slots: dict[int, tuple[np.ndarray, ...]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence = np.zeros(len(frame), np.int64)
            offset = np.zeros(len(frame), np.int64)
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                first, start, place = slots[int(value)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = start[k] + rank[at] - first[k]
                offset[at] = place[k]
            yield frame.assign(sequence_id=sequence, offset=offset).drop(columns="rank")

    return run


def ranked(pieces: DataFrame, buckets: int | None = None) -> DataFrame:
    """Adds ``rank``, 0 .. n-1 among the pieces of one length.

    Pieces of a length are dealt to hash buckets (by default as many as the
    square root of all pieces), ranked inside a bucket, and shifted by the sizes
    of the buckets before, so that one very frequent length is not one task."""
    buckets = buckets or max(1, math.isqrt(pieces.count()))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    return (
        dealt.withColumn("inner", F.row_number().over(inside) - 1)
        .join(shifts, ["length", "bucket"])
        .withColumn("rank", F.col("inner") + F.col("shift"))
        .drop("bucket", "inner", "shift")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32,
    sequence_id, offset``.

    Only documents longer than ``capacity`` ids are cut.  Repeated rows are
    packed as often as they occur; null ids are kept; further columns, also of
    clashing names, are not read, and the id may not be called like an added one.
    Null texts are empty and texts are read whole.  An empty table gives no rows.  The driver holds the length histogram (``capacity`` numbers) and the
    plan, whose size depends on ``capacity`` alone."""
    refuse_clashes([id_col], ("piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_by_length(pack_histogram(counts, capacity))
    rows = ranked(pieces).select("id", "piece", "start", "length", "ids_crc32", "rank")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns if c != "rank") + ", sequence_id long, offset long"
    return rows.mapInPandas(_place(slots), schema).withColumnRenamed("id", id_col)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
