"""Chain reorganisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How far back an ancestor is looked for.
MAX_DEPTH = 64
SPAN = 1000


class ReorgTooDeep(RuntimeError):
    """No common block within MAX_DEPTH blocks."""


def common_ancestor(stored: DataFrame, canonical: DataFrame, last: int, depth: int = MAX_DEPTH) -> DataFrame:
    """One row ``ancestor``: the highest block of ``[last - depth, last]`` on
    which both agree, null if there is none."""
    near = F.col("block_number").between(last - depth, last)
    a = stored.where(near).select("block_number", "block_hash")
    b = canonical.where(near).select("block_number", "block_hash")
    return a.join(b, ["block_number", "block_hash"]).agg(F.max("block_number").alias("ancestor"))


def require_ancestor(stored: DataFrame, canonical: DataFrame, last: int, depth: int = MAX_DEPTH) -> int:
    found = common_ancestor(stored, canonical, last, depth).first()["ancestor"]
    if found is None:
        raise ReorgTooDeep(f"no common block in the {depth} before {last}")
    return found


def reorg_status(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """Per observed block: ``same``, ``reorg``, ``unknown`` (nothing stored) or
    ``inconclusive`` (nothing observed to compare with)."""
    s = stored.select("block_number", F.col("block_hash").alias("stored_hash"))
    o = observed.select("block_number", F.col("block_hash").alias("observed_hash"))
    status = (
        F.when(F.col("observed_hash").isNull(), "inconclusive")
        .when(F.col("stored_hash").isNull(), "unknown")
        .when(F.col("stored_hash") == F.col("observed_hash"), "same")
        .otherwise("reorg")
    )
    return o.join(s, "block_number", "left").select("block_number", status.alias("status"))


def chain_breaks(blocks: DataFrame) -> DataFrame:
    """Blocks whose parent hash is not the hash of the block one below, where
    that block is there.  A block meets its parent by number, so the check is
    one equi-join without any global order."""
    parent = blocks.select((F.col("block_number") + 1).alias("block_number"), F.col("block_hash").alias("expected"))
    return blocks.join(parent, "block_number").where(F.col("expected") != F.col("parent_hash")).select("block_number", "parent_hash", "expected")


def block_gaps(blocks: DataFrame, span: int = SPAN) -> DataFrame:
    """Missing stretches between the lowest and highest block: ``first_missing,
    last_missing``.

    A block starts a gap if its successor is missing.  Windows stay inside spans
    of block numbers; spans are tied together by their own first and last block,
    one row each."""
    spanned = blocks.select("block_number").distinct().withColumn("span", F.floor(F.col("block_number") / span))
    inside = spanned.withColumn("next", F.lead("block_number").over(Window.partitionBy("span").orderBy("block_number"))).where("next is not null")
    ends = spanned.groupBy("span").agg(F.min("block_number").alias("low"), F.max("block_number").alias("high"))
    across = ends.withColumn("next", F.lead("low").over(Window.orderBy("span"))).where("next is not null").select(F.col("high").alias("block_number"), "next")
    return (
        inside.select("block_number", "next")
        .unionByName(across)
        .where("next > block_number + 1")
        .select((F.col("block_number") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"))
    )


def head_gap(confirmed: DataFrame, progress: DataFrame) -> DataFrame:
    """Head, next block to do, gap, and whether the index is ready (gap <= 2)."""
    nothing = F.lit(None).cast("bigint")
    both = confirmed.select(F.col("block_number").alias("head"), nothing.alias("done")).unionByName(progress.select(nothing.alias("head"), F.col("max_block").alias("done")))
    found = both.agg(F.max("head").alias("head"), (F.coalesce(F.max("done"), F.lit(0)) + 1).alias("next_block"))
    gap = F.greatest(F.lit(0), F.col("head") - F.col("next_block") + 1)
    return found.select("head", "next_block", gap.alias("gap"), (gap <= 2).alias("ready"))
