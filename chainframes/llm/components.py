"""Connected components of a distributed graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` pairs of longs -> ``(node, root)``, the root being the smallest
    node reachable; roots themselves have no row.

    Every round connects each node's larger neighbours to its smallest one and
    then its smaller neighbours to its smallest one, which halves distances
    without ever gathering a neighbourhood in one task: a node's neighbours are
    only ever reduced to their minimum and joined back, and Spark splits the
    join of a node with very many neighbours.  Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the size."""
    current = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(current)
    if not before[0]:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        current = materialize(small)
        after = _state(current)
        if after == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
