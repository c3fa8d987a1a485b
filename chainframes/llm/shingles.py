"""Exact similarity of texts that something else has put into groups.

A text is its set of runs of five words.  A pair links if its whole sets have a
Jaccard similarity of LEAST or more.  Two steps find what the links of a group
connect.  First, texts meet where they share the smallest run of one of SEEDS
orders; of each such bucket the first and the last text (in an order of the
bucket's own) are compared with all others, which joins most of a large group at
a fixed number of comparisons per text.  Then all pairs that may link across the
parts found so far are compared: sets as similar as LEAST share one of their
rarest runs (a fifth of each set and one more), and differ in few enough runs for
their bitmaps to differ in no more bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

RUN_WORDS = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: Orders of runs; a pair of similarity 0.8 shares no smallest run in 0.2 ** SEEDS of all cases.
SEEDS = 16
#: Texts that a task looks at together.
ROWS_AT_ONCE = 256
#: 64-bit words of a set's bitmap.
BITMAP_WORDS = 8
_BITMAP = [f"b{i}" for i in range(BITMAP_WORDS)]

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(1, 1 << 63, SEEDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _rng.integers(0, 1 << 63, SEEDS, dtype=np.uint64)


def word_runs(text: str | None, k: int) -> list[bytes]:
    """All runs of ``k`` lower-cased words; a shorter text is one run."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if k == 1 or not words:
        return words
    return list(map(b" ".join, zip(*(words[i:] for i in range(k))))) if len(words) >= k else [b" ".join(words)]


def run_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs (no word: none)."""
    from xxhash import xxh64_intdigest

    runs = word_runs(text, RUN_WORDS)
    return np.unique(np.fromiter(map(xxh64_intdigest, runs, repeat(42)), dtype="<u8", count=len(runs)))


def smallest(runs: np.ndarray) -> np.ndarray:
    """The smallest of the runs in each of the orders (no run: zero)."""
    if not len(runs):
        return np.zeros(SEEDS, np.uint64)
    return np.array([((runs ^ m) * f).min() for f, m in zip(_FACTORS, _MASKS, strict=True)])


def bitmap(runs: np.ndarray) -> np.ndarray:
    """One bit per class of runs: set where the set holds an odd number of them.  A
    run that only one of two sets holds changes one bit, so that their bitmaps
    differ in no more bits than the sets in runs."""
    odd = np.bincount((runs >> np.uint64(7)) % np.uint64(64 * BITMAP_WORDS), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            sets = [run_set(t.as_py()) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(list(map(len, sets)), pa.int64()),
                    pa.array([smallest(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    *[pa.array(b) for b in np.stack([bitmap(s) for s in sets], axis=1)],
                ],
                ["node", "root", "n", "least", "runs", *_BITMAP],
            )


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per run."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            sets = [np.frombuffer(c.as_buffer(), "<i8") for c in part.column(2)]
            sizes = list(map(len, sets))
            named = [pa.array(np.repeat(part.column(i).to_numpy(), sizes)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*named, pa.array(np.concatenate(sets))], ["node", "root", "run"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    over, under = LEAST
    for batch in batches:
        hits = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(c.as_buffer(), "<u8") for c in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            hits.append(under * both >= over * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(hits, pa.bool_()))


def _links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``(u, v)`` whose sets are as similar as LEAST."""
    pairs = materialize(pairs)
    for c in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("runs").alias(f"runs_{c}")), c)
    return materialize(pairs.select("u", "v", "runs_u", "runs_v").mapInArrow(_verify, "u long, v long"))


def _hub_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of the first and the last text of each bucket with its other texts."""
    over, under = LEAST
    met = sets.select("node", "root", "n", F.posexplode("least").alias("seed", "run"))
    bucket = ["root", "seed", "run"]
    # the order differs from bucket to bucket
    place = F.struct(F.xxhash64("node", "seed", "run").alias("at"), "node", "n")
    hubs = met.groupBy(*bucket).agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low.node <> high.node")
    return (
        met.join(hubs, bucket)
        .select("node", "n", F.explode(F.array("low", "high")).alias("hub"))
        .where((F.col("node") != F.col("hub.node")) & (under * F.least("n", "hub.n") >= over * F.greatest("n", "hub.n")))
        .select(F.least("node", "hub.node").alias("u"), F.greatest("node", "hub.node").alias("v"))
        .distinct()
    )


def _rare_runs(sets: DataFrame) -> DataFrame:
    """``node, root, run``: of each text the runs that fewest texts of its root hold,
    so many that two sets as similar as LEAST share one; runs of a single text are
    left out at the end."""
    over, under = LEAST
    runs = sets.select("node", "root", "runs").mapInArrow(_spread, "node long, root long, run long")
    held = runs.groupBy("root", "run").agg(F.count("*").alias("texts")).where("texts > 1")
    ranked = runs.join(held, ["root", "run"], "left").select("node", "root", F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "run").alias("r"))
    by_node = ranked.groupBy("node", "root").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    # of n runs a similar set holds at least the share LEAST
    first = F.size("rs") - F.ceil(F.size("rs") * over / under).cast("int") + 1
    return by_node.select("node", "root", F.explode(F.slice("rs", F.lit(1), first)).alias("r")).where("r.texts > 1").select("node", "root", "r.run")


def _pairs_across(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """All pairs of one root and different parts (``node, part``; without a row a
    text is a part of its own) that may be as similar as LEAST."""
    over, under = LEAST
    named = sets.drop("least").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = named.groupBy("root").agg((F.min("part") != F.max("part")).alias("open")).where("open").select("root")
    named = materialize(named.join(several, "root", "left_semi"))
    rare = materialize(_rare_runs(named).join(named.select("node", "n", "part", *_BITMAP), "node"))
    own = ["node", "n", "part", *_BITMAP]
    a, b = (rare.select("root", "run", *[F.col(c).alias(f"{c}_{side}") for c in own]) for side in "ab")
    apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _BITMAP), F.lit(0))
    # with d runs that only one of two sets holds, their similarity is (n + m - d) / (n + m + d)
    near = ((over + under) * apart <= (under - over) * (F.col("n_a") + F.col("n_b"))) & (under * F.least("n_a", "n_b") >= over * F.greatest("n_a", "n_b"))
    met = a.join(b, ["root", "run"]).where((F.col("node_a") < F.col("node_b")) & (F.col("part_a") != F.col("part_b")) & near)
    return met.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct()


def similar_pairs(texts: DataFrame) -> DataFrame:
    """``node, root, text`` with one row per node -> edges ``(u, v)`` that connect
    what all pairs of nodes of one root connect whose sets are as similar as LEAST;
    two texts without a word are alike."""
    kinds = "node long, root long, n long, least array<long>, runs binary, " + ", ".join(f"{b} long" for b in _BITMAP)
    sets = materialize(texts.mapInArrow(_sets, kinds).dropDuplicates(["node"]))
    parts = materialize(connected_components(_links_of(_hub_pairs(sets), sets)).select("node", F.col("root").alias("part")))
    across = _links_of(_pairs_across(sets, parts), sets)
    return parts.select(F.col("node").alias("u"), F.col("part").alias("v")).unionByName(across)
