"""Prefix trie of conversations, with totals rolled up band by band.

Every distinct sequence of first ``d`` turns is a node.  Totals of subtrees are
never found by walking the tree: a node is exploded to its ancestors inside a
band of ``BAND`` depths only, and the finished totals of band roots then go on to
the band above.  The band roots are themselves a trie that is ``BAND`` times less
deep, so the same step is taken on it; a trie of depth ``D`` needs about
``log(D) / log(BAND)`` rounds, and no node becomes more than ``BAND`` rows in any.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, word_count

#: Depths in a band, and how often bands are banded again (8 ** 9 turns).
BAND, LEVELS = 8, 9
#: A rebuilt conversation starts like the first one of its block of so many ids.
BLOCK = 20
#: Conversation ids per chunk of a node's list of ends.
CHUNK = 1024
ROOT = hashlib.sha256(b"").digest()[:16]

_MEMBERS = "key binary, parent binary, depth long, conv_id long, words long, last boolean, bands array<array<binary>>, over array<array<binary>>"


def turn_digest() -> Column:
    """Role and text of a turn as one hash; nulls count as empty."""
    role = text_or_empty("role")
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text_or_empty("text")), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Turns as hashes, dealt by block of conversations and sorted: the first
    conversation of a block stands before the others, turns by number (null
    first), equal numbers by their hash.  Texts stay where they are read."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", F.col("text"))
    rows = rows.select(
        (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("block"), "conv_id", "turn", turn_digest().alias("digest"), F.coalesce(word_count(F.col("text")), F.lit(0)).alias("words")
    )
    dealt = rows.repartition("block")
    return dealt.sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", F.col("turn").asc_nulls_first(), "digest")


class _Path:
    """The nodes from the root down to the turn read last, as far as bands need them."""

    def __init__(self, conv_id: int):
        self.conv_id, self.depth, self.key, self.words, self.parent = conv_id, 0, ROOT, 0, None
        self.stacks: list[list[bytes]] = [[] for _ in range(LEVELS)]
        self._bands()

    def _bands(self) -> None:
        """``bands[k]``: this node's ancestors, itself included, inside its band of
        level ``k``; ``over[k]``: the whole band above, where this node starts one."""
        self.bands, self.over, step = [], [], 1
        for k in range(LEVELS):
            if self.depth % step:
                break
            if self.depth // step % BAND == 0:
                if self.depth:
                    self.over.append(self.stacks[k])
                self.stacks[k] = []
            self.stacks[k].append(self.key)
            self.bands.append(list(self.stacks[k]))
            step *= BAND

    def row(self, last: bool) -> tuple:
        return self.key, self.parent, self.depth, self.conv_id, self.words, last, self.bands, self.over

    def down(self, digest: bytes, words: int) -> None:
        self.parent, self.words, self.depth = self.key, words, self.depth + 1
        self.key = hashlib.sha256(self.key + digest).digest()[:16]
        self._bands()


def head_turns(conv_id: int) -> int:
    """How many first turns a conversation takes from its block's first one."""
    return zlib.crc32(str(conv_id).encode()) % 4


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to one row per rebuilt conversation and depth.  One path is
    held at a time, whatever a conversation's length."""
    block, head, path, seen, rows = None, [], None, 0, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.list_(pa.binary())), pa.list_(pa.list_(pa.binary())))
        names = ("key", "parent", "depth", "conv_id", "words", "last", "bands", "over")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for of, conv_id, digest, words in zip(*(batch.column(c).to_pylist() for c in ("block", "conv_id", "digest", "words")), strict=True):
            if path is None or conv_id != path.conv_id:
                if path is not None:
                    rows.append(path.row(True))
                if of != block:
                    block, head = of, []
                path, seen, borrowed = _Path(conv_id), 0, 0 if conv_id == of else head_turns(conv_id)
                for turn in head[:borrowed]:
                    rows.append(path.row(False))
                    path.down(*turn)
            if conv_id == of and len(head) < 3:
                head.append((digest, words))
            if seen >= borrowed:
                rows.append(path.row(False))
                path.down(digest, words)
            seen += 1
            if len(rows) >= 4096:
                yield flush()
                rows = []
    if path is not None:
        rows.append(path.row(True))
    if rows:
        yield flush()


def prefixes(conversations: DataFrame) -> DataFrame:
    """One row per rebuilt conversation and depth, the root included; ``last``
    marks a conversation's whole sequence."""
    turns = ordered_turns(conversations).select("block", "conv_id", "digest", "words")
    return turns.mapInArrow(_prefixes, _MEMBERS)


def subtree_totals(nodes: DataFrame, measures: tuple[str, ...], deepest: int, level: int = 0) -> DataFrame:
    """Sums of ``measures`` over every node's subtree, itself included.

    ``nodes`` (``key, depth, bands, over`` and the measures) are those whose depth
    is a multiple of ``BAND ** level``."""
    step = BAND ** (level + 1)
    sums = [F.sum(m).alias(m) for m in measures]
    inside = nodes.select(F.explode(F.get("bands", F.lit(level))).alias("key"), *measures).groupBy("key").agg(*sums)
    if deepest < step:
        return inside
    inside = materialize(inside)
    roots = nodes.where(F.col("depth") % step == 0).drop(*measures).join(inside, "key")
    done = subtree_totals(roots, measures, deepest, level + 1)
    upward = roots.where("depth > 0").drop(*measures).join(done, "key")
    below = upward.select(F.explode(F.get("over", F.lit(level))).alias("key"), *measures)
    return materialize(inside.select("key", *measures).unionByName(below).groupBy("key").agg(*sums))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of id lists to one SHA-256 per node, fed chunk by chunk."""
    key, state, keys, out = None, None, [], []
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    keys.append(key)
                    out.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends_sha256"])
            keys, out = [], []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def end_digests(members: DataFrame) -> DataFrame:
    """Per node the hash of the ids that end there, in order.  Ids are first
    written out in chunks of ``CHUNK`` neighbouring ids, which no node can
    overfill; a popular node's chunks then stream through one hash."""
    ends = members.where("last").groupBy("key", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = ends.select("key", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations.

    ``conversations`` has ``conv_id, turn, role, text``; further columns, also of
    clashing names, are not read.  Null roles and texts count as empty, a null
    turn stands first, turns of one number stand by the hash of role and text, so
    that repeated rows are repeated turns.  Rows without a ``conv_id`` belong to
    no conversation and are left out.  An empty table has no node, not even the
    root.  A conversation may have ``BAND ** LEVELS`` turns and is never held
    whole."""
    members = materialize(prefixes(conversations))
    nodes = materialize(
        members.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"), F.max("words").alias("words"),
            F.first("parent").alias("parent"), F.first("bands").alias("bands"), F.first("over").alias("over"),
        )
    )
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = nodes.select(
        "key", "depth", "bands", "over", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    )
    totals = subtree_totals(own, ("n_leaves", "saved_tokens"), deepest)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.drop("bands", "over")
        .join(totals, "key")
        .join(end_digests(members), "key", "left")
        .join(above, "parent", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    )


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v FROM range(256) r(i))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
                      lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
rebuilt AS (
  SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.place <= h
  UNION ALL SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > h),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS path,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
members AS (
  SELECT conv_id, depth, path, words, last FROM steps
  UNION ALL SELECT conv_id, 0, [], 0, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS (
  SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM members GROUP BY path),
children AS (SELECT path[:-2] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
totals AS (
  SELECT CASE WHEN k = 0 THEN [] ELSE path[:k] END AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM own) GROUP BY 1)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN totals USING (path) LEFT JOIN nodes p ON o.depth > 0 AND p.path = o.path[:-2]
"""
