"""Document fingerprints: threshold-scaled sketches.

A sketch holds every shingle hash below a fixed fraction of the hash space.
Whether a hash is kept depends on the hash alone, so sketches of very unequal
documents can be compared.  A text none of whose hashes is below the fraction
holds its smallest one instead; as that lies above the fraction, it is told
apart from kept ones, and ``merge`` gives exactly the sketch of the union of the
shingles.  Only a text without words has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted_broadcast, documents, materialize, text_or_empty, words

HASH_BITS = 48
SHINGLE_WORDS = 3
#: One hash in so many is kept.
SCALE = 2


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, k: int = SHINGLE_WORDS) -> Column:
    """48-bit hashes of all runs of ``k`` words; a shorter text is one shingle."""
    long = F.transform(
        F.sequence(F.lit(1), F.size(hashes) - (k - 1)),
        lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(hashes, i + (j - 1)) for j in range(k)]), 64 - HASH_BITS),
    )
    short = F.array(F.shiftrightunsigned(F.xxhash64(hashes), 64 - HASH_BITS))
    return F.when(F.size(hashes) >= k, long).when(F.size(hashes) > 0, short).otherwise(F.array().cast("array<bigint>"))


def below(scale: int) -> int:
    """The fraction's upper end: kept hashes are smaller."""
    return (1 << HASH_BITS) // scale


def sketch(shingles: Column, kept: Column) -> Column:
    """The sketch from all hashes and the kept ones (both plain columns)."""
    return (
        F.when(F.size(shingles) == 0, shingles)
        .when(F.size(kept) > 0, F.array_sort(F.array_distinct(kept)))
        .otherwise(F.array(F.array_min(shingles)))
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; two empty sketches: 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; an empty ``a``: 1.  The
    documents may differ in size without end, as both sketches keep the same
    hashes.  Of an ``a`` without a kept hash only its smallest one is looked up."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts taken together (but for shingles across their
    seam): the union, where it holds a kept hash without those above the
    fraction, else the smaller of the smallest hashes."""
    both = F.array_sort(F.array_union(a, b))
    kept = F.filter(both, lambda h: h < below(scale))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(both, 1, 1))


def as_text(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), HASH_BITS // 4, "0")), "")


def fingerprint_documents(docs: DataFrame, text_col: str = "text", out: str = "sketch", k: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Adds the sketch column ``out`` to every row; null texts count as empty.

    No shuffle: texts of any length are hashed whole where they are read.
    Repeated rows get equal sketches; an empty table gives no rows.  A column
    that is called like ``out`` is replaced; other columns stay as they are,
    unless their names begin with ``__fp_``."""
    return (
        docs.withColumn("__fp_words", word_hashes(text_or_empty(text_col)))
        .withColumn("__fp_shingles", shingle_hashes(F.col("__fp_words"), k))
        .withColumn("__fp_kept", F.filter("__fp_shingles", lambda h: h < below(scale)))
        .withColumn(out, sketch(F.col("__fp_shingles"), F.col("__fp_kept")))
        .drop("__fp_words", "__fp_shingles", "__fp_kept")
    )


def _rank_zones(rows: DataFrame, n: int, rows_per_bucket: int, fan: int) -> tuple[DataFrame, int]:
    """Adds ``__zone``: numbers of buckets of about ``rows_per_bucket``
    consecutive ``__id`` by rank, growing with the id; and how many zones there
    can be.

    Each level cuts every zone at up to ``fan`` approximate quantiles of its own
    ids, so that gaps between ids leave the buckets even."""
    rows, zones, size = rows.withColumn("__zone", F.lit(0).cast("long")), 1, n
    while size > rows_per_bucket:
        parts = min(fan, -(-size // rows_per_bucket))
        cuts = F.percentile_approx("__id", [i / parts for i in range(1, parts + 1)], 10_000).alias("__cuts")
        table = materialize(rows.groupBy("__zone").agg(cuts))
        if zones == 1:  # one row: a literal, so that no join is needed
            rows = rows.withColumn("__cuts", F.array(*[F.lit(int(c)).cast("long") for c in table.first()["__cuts"]]))
        else:
            rows = rows.join(counted_broadcast(table), "__zone")
        part = F.least(F.size(F.filter("__cuts", lambda c: c < F.col("__id"))), F.lit(parts - 1))
        rows = rows.withColumn("__zone", F.col("__zone") * fan + part).drop("__cuts")
        zones, size = zones * fan, -(-size // parts)
    return rows, zones


def with_next(docs: DataFrame, id_col: str, carried: list[str], rows_per_bucket: int = 1000, fan: int = 256) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: the row that follows in
    descending ``id_col`` order (nulls last; ties by the carried columns), and
    the first row after the last one.  Columns ``id_col``, ``carried`` and
    ``next_<c>`` come back.

    Rows are dealt to buckets of about ``rows_per_bucket`` consecutive ids by
    rank.  The windows work inside a bucket, and the first row of each bucket
    also visits the bucket before it.  Buckets only steer the work; whatever the
    ids, the result is the same.  Ids are whole numbers; rows of one single id
    share a bucket.  One row follows itself; an empty table gives no rows."""
    stats = docs.agg(F.count("*").alias("n"), F.min(id_col).alias("low")).first()
    lowest = stats["low"] if stats["low"] is not None else 0
    rows = docs.select(id_col, *carried).withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(lowest - 1).cast("long")))
    dealt, zones = _rank_zones(rows, stats["n"], rows_per_bucket, fan)
    buckets = materialize(dealt.groupBy("__zone").agg(F.max("__id").alias("__top")).withColumn("__high", F.floor(F.col("__zone") / fan)))
    # The bucket that comes before in descending order is the next one upwards:
    # inside a stretch of ``fan`` zones, else the first of the next stretch.
    inside = Window.partitionBy("__high").orderBy("__zone")
    across = Window.orderBy("__high")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stretches = buckets.groupBy("__high").agg(F.min("__zone").alias("__first"))
    stretches = stretches.select("__high", F.lead("__first").over(across).alias("__above"), F.first("__first").over(whole).alias("__lowest"))
    hosts = buckets.withColumn("__up", F.lead("__zone").over(inside)).join(stretches, "__high")
    hosts = materialize(hosts.select(F.col("__top").alias("__id"), F.coalesce("__up", "__above", "__lowest").alias("__host")))
    # One narrow row per bucket, so that no text is shuffled to find first rows.
    guests = dealt.join(counted_broadcast(hosts), "__id").select(
        id_col, *carried, "__id", F.col("__host").alias("__zone"), F.lit(1).alias("__guest")
    )
    everyone = dealt.select(id_col, *carried, "__id", "__zone", F.lit(0).alias("__guest")).unionByName(guests)
    order = Window.partitionBy("__zone").orderBy("__guest", F.col("__id").desc(), F.col(id_col).isNull(), *[F.xxhash64(c) for c in carried])
    return (
        everyone.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
        .where("__guest = 0")
        .drop("__id", "__zone", "__guest")
    )


def op5_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = with_next(docs, "doc_id", ["text"]).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    )
    rows = fingerprint_documents(fingerprint_documents(fingerprint_documents(edited), "edited", "edited_sketch"), "next_text", "next_sketch")
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
