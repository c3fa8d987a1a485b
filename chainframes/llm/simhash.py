"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints link at three or fewer differing bits.  Leave out the
third of the bits that holds one of the differing ones: at most two differ in
what is left, so both fingerprints lie within one bit of a common value.  Every
distinct fingerprint therefore emits, for each third left out, all values
within half that radius (itself and its one-bit variants, 131 rows in all);
rows are shuffled on the variant (by bits of it, so that variants which share
them travel as one row), and fingerprints that meet are verified by their full
distance.  A random meeting needs 42 equal bits, so false candidates
stay rare at any size, and no row count depends on how alike the documents are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import mix64
from .common import documents, dropping_shuffles, fresh_name, materialize, scratch
from .components import connected_components
from .shingles import similar_pairs, word_runs

RADIUS = 3
_BITS = 64
_CUTS = (0, 21, 42, 64)
_SEED = 42


class Scheme(NamedTuple):
    """What a fingerprint is made of: runs of ``words`` words, each as often as
    it occurs or (``distinct``) once.  Runs are hashed by XXH64 with seed 42;
    another ``seed`` mixes that hash once more."""

    words: int = 3
    seed: int = 42
    distinct: bool = False


SHINGLES = Scheme()
#: Fingerprints of a text's set of words.  An edit changes fewer single words than
#: runs of them, so that near copies (0.8 and more of their runs of five words in
#: common) mostly differ in three bits or fewer in one of the eight.
WORD_SETS = tuple(Scheme(1, seed, True) for seed in range(42, 50))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def simhash(text: str | None, scheme: Scheme = SHINGLES) -> int:
    """The signed 64-bit fingerprint of one text (null or no word: 0)."""
    return simhashes(text, (scheme,))[0]


def simhashes(text: str | None, schemes: tuple[Scheme, ...]) -> list[int]:
    """A fingerprint per scheme; runs of words are made once for each kind."""
    from xxhash import xxh64_intdigest

    kinds: dict[tuple[int, bool], np.ndarray] = {}
    for s in schemes:
        if (s.words, s.distinct) not in kinds:
            runs = word_runs(text, s.words)
            runs = list(set(runs)) if s.distinct else runs
            kinds[s.words, s.distinct] = np.fromiter(map(xxh64_intdigest, runs, repeat(_SEED)), dtype="<u8", count=len(runs))
    return [_simhash(kinds[s.words, s.distinct], s) for s in schemes]


def _simhash(hashes: np.ndarray, scheme: Scheme) -> int:
    n = len(hashes)
    if not n:
        return 0
    if scheme.seed != _SEED:
        hashes = mix64(hashes + np.uint64(scheme.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    counts = np.zeros(_BITS, dtype=np.int64)
    for at in range(0, n, 4096):
        part = hashes[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", schemes: tuple[Scheme, ...] = (SHINGLES,)) -> DataFrame:
    """``id, fp0, fp1, ..``: a fingerprint per scheme."""
    names = [f"fp{i}" for i in range(len(schemes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhashes(t.as_py(), schemes) for t in batch.column(1)]
            columns = [pa.array([v[i] for v in values], pa.int64()) for i in range(len(schemes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} long" for c in names))


def _variants(home_bits: int) -> list[list[tuple[int, int]]]:
    """All 131 (and-mask, xor-value) pairs; the bits left out hold a constant.

    A group holds the pairs that give a fingerprint's variants one *home*: the
    lowest ``home_bits`` of each third (see ``_home_mask``)."""
    home, out = _home_mask(home_bits), []
    for q, (low, high) in enumerate(zip(_CUTS, _CUTS[1:], strict=False)):
        hole = ((1 << (high - low)) - 1) << low
        keep, tag = ~hole & ((1 << 64) - 1), (q + 1) << low
        flips = [1 << b for b in range(_BITS) if not hole >> b & 1]
        own = [[0] + [f for f in flips if not f & home]] + [[f] for f in flips if f & home]
        out += [[(_signed(keep), _signed(tag ^ f)) for f in group] for group in own]
    return out


def _home_mask(home_bits: int) -> int:
    return _signed(sum(((1 << home_bits) - 1) << low for low in _CUTS[:-1]))


#: Fingerprints of one bucket that are compared all with all; larger buckets are split.
_COMPARED = 1024
#: Two words that differ in three bits or fewer agree in one of four sets of bits.
_PARTS = RADIUS + 1


def _parts(fps: np.ndarray) -> list[np.ndarray]:
    """The bits in which members differ, dealt to four masks so that each gets its
    share of those that tell most members apart.  (The members of a bucket agree
    in most bits: a split by those would leave them together.)"""
    ones = np.array([np.count_nonzero(fps >> np.uint64(b) & np.uint64(1)) for b in range(_BITS)])
    told = np.minimum(ones, len(fps) - ones)
    order = [b for b in np.argsort(-told, kind="stable") if told[b]]
    return [np.bitwise_or.reduce(np.array([1 << int(b) for b in order[i::_PARTS]], dtype=np.uint64), initial=np.uint64(0)) for i in range(_PARTS)]


def _linked_stars(fps: np.ndarray, radius: int, names: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what links within one bucket: the names of (member,
    smallest of its part).  Members of one name are one part from the start; without
    names each goes by its fingerprint.  A large bucket is split, and split again,
    by sets of bits of which any two that link agree in one; what is small enough is
    compared all with all."""
    n = len(fps)
    names = fps if names is None else names
    _, first, same = np.unique(names, return_index=True, return_inverse=True)
    if len(first) == 1:
        return []
    label = first[same]

    def join(members: np.ndarray) -> None:
        found, own = fps[members], label[members]
        least = own.copy()
        for at in range(0, len(members), _COMPARED):
            near = np.bitwise_count(found[at : at + _COMPARED, None] ^ found[None, :]) <= radius
            i, j = np.nonzero(near)
            keep = own[at + i] != own[j]
            i, j = at + i[keep], j[keep]
            while len(i):  # smaller labels spread until both ends of every link have one
                low = np.minimum(least[i], least[j])
                before = least.copy()
                np.minimum.at(least, i, low)
                np.minimum.at(least, j, low)
                for old in np.flatnonzero(least != before):
                    least[own == own[old]] = np.minimum(least[own == own[old]], least[old])
                if (least == before).all():
                    break
        for old, new in {(int(a), int(b)) for a, b in zip(own, least, strict=True) if a != b}:
            label[label == old] = new

    def settle(members: np.ndarray) -> None:
        if label[members].min() == label[members].max():
            return
        if len(members) <= _COMPARED:
            join(members)
            return
        for mask in _parts(fps[members]):
            part = fps[members] & mask
            order = np.argsort(part, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
            if len(begins) == 1:  # nothing is told apart: compared in strips
                join(members)
                return
            for group in np.split(members[order], begins[1:]):
                if len(group) > 1:
                    settle(np.sort(group))

    settle(np.arange(n))
    return [(int(names[i]), int(names[r])) for i, r in zip(first, label[first], strict=True) if names[r] != names[i]]


def _meet(radius: int):
    """Streams rows in key order; a bucket holds at most the 44 variants' values
    times what the bits left out can be, and is handled as one array."""

    def edges(keys: np.ndarray, fps: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[begins, len(keys)])
        two = begins[sizes == 2]
        hit = two[(np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius) & (names[two] != names[two + 1])]
        u, v = [names[hit + 1]], [names[hit]]
        for at, size in zip(begins[sizes > 2], sizes[sizes > 2], strict=True):
            found = _linked_stars(fps[at : at + size], radius, names[at : at + size])
            if found:
                pairs = np.array(found, dtype=np.int64)
                u.append(pairs[:, 0])
                v.append(pairs[:, 1])
        both = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            # without a column of names, a fingerprint goes by itself
            new = [batch.column(i).to_numpy() for i in (0, 1, batch.num_columns - 1)]
            keys, fps, names = (np.concatenate(c) for c in zip(held, new, strict=True))
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], side="left"))  # the last bucket may go on
            held = [keys[cut:], fps[cut:], names[cut:]]
            yield edges(keys[:cut], fps[:cut].view(np.uint64), names[:cut])
        yield edges(held[0], held[1].view(np.uint64), held[2])

    return run


def met_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` as the buckets give them (one of several buckets repeats)
    among distinct fingerprints ``fp``, or among their long ``name`` where there is
    one: then fingerprints of one name are connected already and give no edge.

    A fingerprint's variants are dealt by their homes, and those of one home travel
    as one row, which is written out where it arrives: about 40 rows instead of
    131.  Homes are at least 96 times as many as partitions."""
    assert radius == RADIUS, "the variants are laid out for three bits"
    own = [c for c in ("fp", "name") if c in nodes.columns]
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    home_bits = min(20, -(-(partitions.bit_length() + 5) // 2))
    groups = _variants(home_bits)

    def pair(a: int, x: int) -> Column:
        return F.struct(F.lit(a).alias("a"), F.lit(x).alias("x"))

    def flipped(m: Column) -> Column:
        return F.col("fp").bitwiseAND(m["a"]).bitwiseXOR(m["x"])

    first = F.array(*[pair(*g[0]) for g in groups])
    every = F.array(*[F.array(*[pair(*p) for p in g]) for g in groups])
    emitted = nodes.select(*own, F.explode(F.array(*map(F.lit, range(len(groups))))).alias("group"))
    dealt = emitted.repartition(flipped(F.get(first, F.col("group"))).bitwiseAND(F.lit(_home_mask(home_bits))))
    keyed = dealt.select(F.explode(F.transform(F.get(every, F.col("group")), flipped)).alias("key"), *own)
    return keyed.sortWithinPartitions("key", "fp").mapInArrow(_meet(radius), "u long, v long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` among distinct fingerprints ``fp`` whose components are
    those of the full link graph (all pairs of at most ``radius`` differing bits)."""
    return met_pairs(nodes, radius).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SHINGLES) -> DataFrame:
    """One row per document: ``id_col, fp0, component`` with the component's
    smallest id.

    Null and word-free texts have fingerprint zero and link like any other.
    Copies share one node, so a text repeated without end costs one row.  Rows
    with a null id get a component like any other; a component of null ids only
    has a null name.  Further columns are not read; an empty table gives no rows."""
    with scratch(docs.sparkSession) as result:
        fps = result(fingerprints(docs, id_col, text_col, (scheme,)))
        texts = materialize(fps.groupBy("fp0").agg(F.min("id").alias("least_id")))
        roots = connected_components(links(texts.select(F.col("fp0").alias("fp"))))
        named = texts.join(roots, texts["fp0"] == roots["node"], "left").select("fp0", "least_id", F.coalesce("root", "fp0").alias("root"))
        components = named.groupBy("root").agg(F.min("least_id").alias("component"))
        by_text = result(named.join(components, "root").select("fp0", "component"))
    return fps.join(by_text, "fp0").select(F.col("id").alias(id_col), "fp0", "component")


def proposed_groups(texts: DataFrame, schemes: tuple[Scheme, ...]) -> DataFrame:
    """``node, root``: the groups that hold together all texts which one of the
    fingerprints ``fp0 ..`` links, each named by its smallest ``node``.

    The first scheme's links make groups; the others only add links between
    different groups, so that a large group of near copies gives its links once and
    not once for each scheme.  One scheme's variants are shuffled after the other,
    so that the disk never holds those of all."""
    named = texts.withColumn("root", F.col("node"))
    for batch in filter(len, (range(1), range(1, len(schemes)))):
        with scratch(texts.sparkSession) as result:
            made = [F.struct(F.lit(i).alias("scheme"), F.col(f"fp{i}").alias("fp")) for i in batch]
            each = named.select("root", F.explode(F.array(*made)).alias("f")).select("root", "f.*").distinct()
            lows = materialize(each.groupBy("scheme", "fp").agg(F.min("root").alias("name"), F.count("*").alias("n")))
            # groups that share a fingerprint are tied to the least of them
            edges = each.join(lows.where("n > 1"), ["scheme", "fp"]).where("root <> name").select(F.col("root").alias("u"), F.col("name").alias("v"))
            for i in batch:
                with dropping_shuffles(texts.sparkSession):
                    edges = edges.unionByName(materialize(met_pairs(lows.where(F.col("scheme") == i).select("fp", "name")).distinct()))
            merged = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
            named = result(named.join(merged, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to"))
    return named.select("node", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", schemes: tuple[Scheme, ...] = WORD_SETS) -> DataFrame:
    """The rows of ``docs`` whose id names their component, one of each; an id
    with several texts counts once for each of them.

    Fingerprints only propose: texts link if their sets of runs of five words
    have a Jaccard similarity of 0.8 or more.  A row without an id goes by a
    negative number made from its text's hash, so of such rows with one text one
    stays; before rows with ids it is the one.  All columns of ``docs`` come back,
    whatever their names.  Repeated rows are copies; an empty table stays empty."""
    key, node = (fresh_name(c, docs.columns) for c in ("__key", "__node"))
    own = F.coalesce(F.col(id_col), -1 - F.xxhash64(text_col).bitwiseAND((1 << 62) - 1))
    keyed = docs.withColumn(key, own).withColumn(node, F.xxhash64(text_col))
    names = [f"fp{i}" for i in range(len(schemes))]
    with dropping_shuffles(docs.sparkSession), scratch(docs.sparkSession) as result:
        # a node per distinct text
        fps = materialize(fingerprints(keyed.select(F.struct(F.col(key).alias("__key"), F.col(node).alias("__node")).alias("__row"), F.col(text_col).alias("text")), "__row", "text", schemes))
        texts = materialize(fps.groupBy(F.col("id.__node").alias("node"), *names).agg(F.min("id.__key").alias("least_id")))
        groups = proposed_groups(texts, schemes).where("node <> root")
        groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
        asked = materialize(groups.join(texts.select("node", "least_id"), "node"))
        rows = keyed.select(F.col(key).alias("__key"), F.col(node).alias("__node"), F.col(text_col).alias("text"))
        rows = rows.join(asked, (rows["__node"] == asked["node"]) & (rows["__key"] == asked["least_id"])).select("node", "root", "text")
        roots = connected_components(similar_pairs(rows))
        named = texts.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = named.groupBy("root").agg(F.min(F.struct("least_id", "node")).alias("row"))
        first = first.select(F.col("row.least_id").alias("__key"), F.col("row.node").alias("__node"))
        copies = fps.select("id.*").groupBy("__key", "__node").agg(F.count("*").alias("n"))
        first = result(first.join(copies, ["__key", "__node"]))
    # One plan at every size: texts are dealt by id and text once and not sorted.
    kept = keyed.join(first.select(F.col("__key").alias(key), F.col("__node").alias(node)).hint("shuffle_hash"), [key, node], "left_semi")
    if not first.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([key, node])
    return kept.drop(key, node)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
