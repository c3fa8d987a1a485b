"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a token budget.  Whole repeats of a source cover the whole
part of ``target / size``; the fractional part is a prefix of the source's
documents in hash order.  The prefix is found without sorting: sizes are summed
by (source, hash bucket), the bucket in which the budget is crossed is found by
a running sum over at most 4096 buckets, and only that bucket is split further
until it holds one hash value.  A plain filter then takes the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, word_count

HASH_BITS = 60
LEVEL_BITS = 12


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text; a null key counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``(source, source_size)`` -> plus ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share the
    total size.  A target stops at ``max_repeats`` times its source's size and
    the excess is shared again by weight: the level ``lam`` at which
    ``sum(min(cap, lam * weight))`` is the total.  One row per source goes
    through these windows, never a row per document.  All sizes zero: targets
    are zero."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    everything = Window.partitionBy()
    earlier = Window.orderBy("cap_ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (
        F.col("total_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    )
    return (
        totals.withColumn("rank", rank)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(max_repeats))
        .withColumn("cap_ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("total_weight", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("lam", F.max(F.when(F.col("level") <= F.col("cap_ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("lam") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def hash_thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Where each source's budget is crossed in hash order.

    ``sized(source, h, size)``, ``budgets(source, need)`` with ``need`` at most
    the source's size.  Returns ``source, edge, edge_in``: take ``h < edge``,
    and ``h = edge`` too if ``edge_in`` (the nearer of both sums).  A source
    whose budget is nothing or its whole size has no row."""
    edges = budgets.select("source", "need", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        rows = sized.join(
            edges,
            _same_source(sized, edges) & (F.shiftright(sized["h"], shift + LEVEL_BITS) == edges["prefix"]),
        ).select(sized["source"], sized["h"], sized["size"], "need", "before", F.shiftright(sized["h"], shift).alias("bucket"))
        buckets = rows.groupBy("source", "bucket").agg(
            F.first("need").alias("need"),
            F.first("before").alias("before"),
            F.sum("size").alias("inside"),
            F.min("h").alias("low"),
            F.max("h").alias("high"),
        )
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        crossing = (
            buckets.withColumn("before", F.col("before") + F.coalesce(F.sum("inside").over(running), F.lit(0)))
            .where((F.col("before") <= F.col("need")) & (F.col("before") + F.col("inside") > F.col("need")))
            .select("source", "need", "before", F.col("bucket").alias("prefix"), "inside", "low", "high")
        )
        edges = materialize(crossing)
        if edges.where("low <> high").isEmpty():
            break
    return edges.select(
        "source",
        F.col("low").alias("edge"),
        (2 * F.col("before") + F.col("inside") <= 2 * F.col("need")).alias("edge_in"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: Sequence[int] = (1, 2, 3),
    max_repeats: int = 3,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, copies, taken``.

    ``size`` is the number of words.  ``copies`` (0 .. ``max_repeats``) is how
    often the mix holds the document, ``taken = size * copies``.  Null texts
    have size 0; null sources form one source, last in order; null ids share
    one hash.  Repeated rows of one id are taken or left together.  An empty
    table gives an empty result.  ``keep`` names further columns, which come back
    as fields of one struct ``kept``, so that their names clash with none; all
    other columns are not read."""
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        hash60(F.col(id_col)).alias("h"),
        word_count(text_or_empty(text_col)).alias("size"),
    )
    sized = materialize(base)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, max_repeats))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("whole", whole)
    edges = hash_thresholds(
        sized.select("source", "h", "size"),
        plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need")).where("need > 0"),
    )
    plan = materialize(
        plan.join(edges, _same_source(plan, edges), "left").select(plan["source"], "source_size", "target", "whole", "edge", "edge_in")
    )
    extra = F.when((F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("edge_in")), F.lit(1)).otherwise(F.lit(0))
    rows = sized
    if keep:
        rows = docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            hash60(F.col(id_col)).alias("h"),
            word_count(text_or_empty(text_col)).alias("size"),
            F.struct(*[F.col(c) for c in keep]).alias("kept"),
        )
    joined = rows.join(plan, _same_source(rows, plan)).withColumn("copies", F.col("whole") + extra)
    return joined.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
        *([F.col("kept")] if keep else []),
    )


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
tot AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS rnk FROM tot),
weighed AS (
  SELECT *, 1 + (rnk - 1) % 3 AS weight, 3 * source_size AS cap,
         CAST(3 * source_size AS DOUBLE) / (1 + (rnk - 1) % 3) AS cap_ratio FROM ranked),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM tot)
                 - coalesce(sum(cap) OVER (ORDER BY cap_ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST((SELECT sum(weight) FROM weighed)
                 - coalesce(sum(weight) OVER (ORDER BY cap_ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS lvl
  FROM weighed),
targets AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), (SELECT max(lvl) FROM levels WHERE lvl <= cap_ratio) * weight) AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
running AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
         CAST(sum(size) OVER (PARTITION BY s.source, h) AS BIGINT) AS peers
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
edge AS (
  SELECT source, min(h) AS edge, arg_min(2 * (upto - peers) + peers <= 2 * need, h) AS edge_in
  FROM running WHERE upto > need GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       r.size * (r.whole + CASE WHEN r.h < e.edge OR (r.h = e.edge AND e.edge_in) THEN 1 ELSE 0 END) AS taken
FROM running r LEFT JOIN edge e ON r.source IS NOT DISTINCT FROM e.source
"""
