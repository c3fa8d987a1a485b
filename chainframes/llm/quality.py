"""Quality rules with robust multivariate outlier detection.

Base rules look at one document.  The learned rule compares a document's
transformed statistics with its own language and source: a minimum covariance
determinant (MCD) estimate per group, and the Mahalanobis distance from it.

There are three levels of groups: all documents, languages, and sources inside a
language.  Every estimate adds PRIOR_ROWS rows' worth of the moments of the level
above to its own sums, whatever the size of the group: a large group hardly
notices, a tiny one is judged by its language.

The MCD is found by concentration steps from two deterministic starts, until no
determinant moves any more.  Each step is one aggregation over the statistics (never over texts): the distance of
every document under the current estimate, the group's quantile of it, then
mean and covariance of the documents within.  The covariance is factored by a
written-out Cholesky decomposition of four columns, so every step is plain
column arithmetic.  Group sums are combined map-side: a group with a third of
all rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_ROWS, documents, materialize, text_or_empty, words

SYMBOLS = r"[^#*$%&|<>]"
REPEAT_WINDOW = 8

#: The four transformed statistics.
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats")
#: Smallest spread that a statistic may have in a group, so that one which is
#: constant over clean text gives a distance in these units and not infinity.
FLOORS = (0.35, 0.08, 0.12, 0.08)
#: Share of a group that the estimate rests on.
CORE_SHARE = 0.75
#: For four dimensions: the chi-squared quantile at CORE_SHARE is 5.385, and the
#: covariance of the core is widened by 0.75 / P(chi2_6 <= 5.385) = 1.484.
CONSISTENCY = 1.484
#: Concentration ends when no logarithm of a determinant moves by more than this.
SETTLED = 0.05
#: Steps after which estimates that have not settled are an error.
MAX_STEPS = 60
#: The key of the group of all documents.
ALL = "*"
#: Rows' worth of the level above that each estimate takes in.
PRIOR_ROWS = 30
#: Reject beyond this squared distance.  Statistics of texts have heavier tails
#: than a normal law, whose quantile at 1 - 1e-9 is 48.
CUT = 64.0


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` per row.

    No shuffle.  A null text has no words.  Windows are compared by 64-bit hash
    of their eight words' hashes, inside one document."""
    k = REPEAT_WINDOW
    staged = (
        docs.select(F.col(id_col), *keep, text_or_empty(text_col).alias("__text"))
        .withColumn("__words", words(F.col("__text")))
        .withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
        .withColumn(
            "__windows",
            F.when(
                F.size("__hashes") > k,
                F.transform(
                    F.sequence(F.lit(0), F.size("__hashes") - k),
                    lambda i: F.xxhash64(*[F.get(F.col("__hashes"), i + j) for j in range(k)]),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    )
    # Only a text with a repeated window is sorted: (hash, position) in order,
    # then positions whose neighbour has the same hash.
    ordered = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    has_repeat = F.size(F.array_distinct("__windows")) < F.size("__windows")
    staged = staged.withColumn("__ordered", F.when(has_repeat, ordered))
    at = F.col("__ordered")
    starts = F.array_sort(
        F.transform(
            F.filter(
                at,
                lambda x, i: (F.get(at, i - 1)["h"] == x["h"]) | (F.get(at, i + 1)["h"] == x["h"]),
            ),
            lambda x: x["i"],
        )
    )
    staged = staged.withColumn("__starts", starts)
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(k), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return staged.select(
        id_col,
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("__text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_length() -> Column:
    return F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))


def transformed(stats: DataFrame) -> DataFrame:
    """Adds FEATURES: each is of similar spread for short and long texts.

    The logarithm of the mean word length, less its median in the group
    (``center``), is multiplied by the square root of the number of words (up to
    400), as a mean of n words spreads like 1 / sqrt(n); counts are taken as
    square roots of their rates."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        stats.withColumn("f_length", (log_length() - F.col("center")) * F.sqrt(F.least(n, F.lit(400.0))))
        .withColumn("f_symbols", F.sqrt(F.col("n_symbols") / n))
        .withColumn("f_lines", F.sqrt(F.col("n_dup_lines") / F.sqrt(n)))
        .withColumn("f_repeats", F.sqrt(F.col("n_repeat_words") / n))
    )


def _squared_distance(mean: str, chol: str) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    d, solved = len(FEATURES), []
    for i in range(d):
        value = F.col(FEATURES[i]) - F.col(f"{mean}{i}")
        for j in range(i):
            value = value - F.col(f"{chol}{i}{j}") * solved[j]
        solved.append(value / F.col(f"{chol}{i}{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def _with_estimate(sums: DataFrame, scale: float) -> DataFrame:
    """From sums over a core (n, s<i>, p<i><j>): mean m<i>, Cholesky factor
    c<i><j> of the widened and floored covariance, and its log determinant."""
    d = range(len(FEATURES))
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in d})
    covariance = {}
    for i in d:
        for j in range(i + 1):
            cov = (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(scale)
            covariance[f"c{i}{j}"] = F.greatest(cov, F.lit(0.0)) + F.lit(FLOORS[i] ** 2) if i == j else cov
    out = out.withColumns(covariance)
    for j in d:  # column by column, in place
        rest = {i: sum((-F.col(f"c{i}{k}") * F.col(f"c{j}{k}") for k in range(j)), F.col(f"c{i}{j}")) for i in d if i >= j}
        out = out.withColumn(f"c{j}{j}", F.sqrt(F.greatest(rest[j], F.lit(1e-12))))
        if j + 1 < len(FEATURES):
            out = out.withColumns({f"c{i}{j}": rest[i] / F.col(f"c{j}{j}") for i in d if i > j})
    return out.withColumn("logdet", sum((F.log(F.col(f"c{i}{i}")) for i in range(1, len(FEATURES))), F.log(F.col("c00"))))


ESTIMATE = [f"m{i}" for i in range(len(FEATURES))] + [f"c{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)]


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    d = range(len(FEATURES))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.sum(FEATURES[i]).alias(f"s{i}") for i in d],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i in d for j in range(i + 1)],
    )


SUMS = ["n"] + [f"s{i}" for i in range(len(FEATURES))] + [f"p{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)]


def _with_ancestors(table: DataFrame, groups: DataFrame, on: list[str], values: list[str], small: bool) -> DataFrame:
    """Each row of ``table`` with the ``values`` of its language (``l_``) and of
    all documents (``g_``) beside it; of the levels that it has."""
    hint = F.broadcast if small else (lambda df: df)
    placed = table.join(hint(groups), "group_key")
    rest = [c for c in on if c != "group_key"]
    of_language = table.select(F.col("group_key").alias("parent"), *rest, *[F.col(c).alias(f"l_{c}") for c in values])
    of_all = table.where(F.col("group_key") == ALL).select(F.col("group_key").alias("root"), *rest, *[F.col(c).alias(f"g_{c}") for c in values])
    placed = placed.join(hint(of_language), ["parent", *rest], "left")
    return placed.withColumn("root", F.when(F.col("level") >= 0, ALL)).join(F.broadcast(of_all), ["root", *rest])


def _leaning(value: str, count: str) -> Column:
    """A value that leans on the level above by PRIOR_ROWS rows' weight, which
    itself leans on the one above it."""
    m = F.lit(float(PRIOR_ROWS))
    language = (F.col(f"l_{count}") * F.col(f"l_{value}") + m * F.col(f"g_{value}")) / (F.col(f"l_{count}") + m)
    upper = F.when(F.col("level") == 2, language).otherwise(F.col(f"g_{value}"))
    own = (F.col(count) * F.col(value) + m * upper) / (F.col(count) + m)
    return F.when(F.col("level") == 0, F.col(value)).otherwise(own)


def _with_prior(sums: DataFrame, groups: DataFrame, starts: tuple[int, ...], small: bool) -> DataFrame:
    """Adds PRIOR_ROWS rows' worth of the moments of the level above to the sums
    of each group and start.  A group without a row in its core has the moments
    of the level above."""
    every = groups.select("group_key", F.explode(F.array(*[F.lit(s) for s in starts])).alias("start"))
    filled = every.join(F.broadcast(sums) if small else sums, ["group_key", "start"], "left").na.fill(0, SUMS)
    rows = _with_ancestors(filled, groups, ["group_key", "start"], SUMS, small)
    m = F.lit(float(PRIOR_ROWS))

    def with_prior(c: str) -> Column:
        of_all = F.col(f"g_{c}") / F.col("g_n")
        language = (F.col(f"l_{c}") + m * of_all) / (F.col("l_n") + m)
        upper = F.when(F.col("level") == 2, language).otherwise(of_all)
        return F.when(F.col("level") == 0, F.col(c).cast("double")).otherwise(F.col(c) + m * upper)

    return rows.select("group_key", "start", *[with_prior(c).alias(c) for c in SUMS])


def mcd_estimates(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """One robust estimate per group: ``group_key`` and the ESTIMATE columns.

    ``rows`` has FEATURES and ``group_key``, once for each level; ``groups`` has
    ``group_key``, ``level`` (0, 1, 2) and ``parent``; ``small`` tells that it is
    counted to be small, and tables of its size are sent to the rows instead of
    dealing the rows by group.  Starts: coordinatewise median and median absolute
    deviation; classical mean and covariance.  After the concentration steps the
    start with the smaller determinant wins.  Quantiles are ``percentile_approx``
    with relative rank error 1/2000, so a core may miss ``CORE_SHARE`` by that
    much."""
    hint = F.broadcast if small else (lambda df: df)
    key, d = "group_key", range(len(FEATURES))
    middle = materialize(rows.groupBy(key).agg(*[F.percentile_approx(FEATURES[i], 0.5, 2000).alias(f"m{i}") for i in d]))
    spread = (
        rows.join(hint(middle), key)
        .groupBy(key)
        .agg(
            *[F.first(f"m{i}").alias(f"m{i}") for i in d],
            *[F.percentile_approx(F.abs(F.col(FEATURES[i]) - F.col(f"m{i}")), 0.5, 2000).alias(f"a{i}") for i in d],
        )
    )
    nothing = F.lit(None).cast("double")
    median_start = spread.select(
        key,
        F.lit(0).alias("start"),
        nothing.alias("logdet"),
        *[f"m{i}" for i in d],
        *[
            (F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
            for i in d
            for j in range(i + 1)
        ],
    )
    classical = materialize(_sums(rows, [key]).withColumn("start", F.lit(1)))
    mean_start = _with_estimate(_with_prior(classical, groups, (1,), small), 1.0).select(key, "start", nothing.alias("logdet"), *ESTIMATE)
    current = materialize(median_start.unionByName(mean_start))
    for _ in range(MAX_STEPS):
        measured = rows.join(hint(current), key).withColumn("d2", _squared_distance("m", "c")).select(key, "start", "d2", *FEATURES)
        edges = materialize(measured.groupBy(key, "start").agg(F.percentile_approx("d2", CORE_SHARE, 2000).alias("edge"), F.count("*").alias("rows")))
        # The edge leans like the moments, so that a lone outlier is no core of its own.
        edge = _with_ancestors(edges, groups, [key, "start"], ["edge", "rows"], small).select(key, "start", _leaning("edge", "rows").alias("edge"))
        core = materialize(_sums(measured.join(hint(edge), [key, "start"]).where("d2 <= edge"), [key, "start"]))
        before = current.select(key, "start", F.col("logdet").alias("before"))
        fitted = _with_estimate(_with_prior(core, groups, (0, 1), small), CONSISTENCY)
        current = materialize(fitted.join(hint(before), [key, "start"]).select(key, "start", "logdet", "before", *ESTIMATE))
        if current.where(F.coalesce(F.abs(F.col("logdet") - F.col("before")) > SETTLED, F.lit(True))).isEmpty():
            break
    else:
        raise RuntimeError(f"estimates have not settled after {MAX_STEPS} steps")
    best = F.min_by(F.struct(*ESTIMATE), F.struct("logdet", "start")).alias("best")
    return current.groupBy(key).agg(best).select(key, "best.*")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base statistics, ``base_failed``, ``distance2`` and ``kept`` per row.

    The estimates rest on documents that pass the base rules; those that fail
    are never kept, whatever their distance (null).  Null languages and sources
    are groups of their own.  Small groups lean on their language and all
    documents (see above).  Repeated rows are judged alike.  An empty table
    gives no rows."""
    base = base_statistics(
        docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")),
        "id",
        "text",
        ("lang", "source"),
    )
    stats = materialize(base.withColumn("base_failed", base_failed()))
    lang = F.concat(F.lit("l"), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")))
    fine = F.concat(F.lit("s"), lang, F.lit("\n"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    everything = F.lit(ALL)
    passed = stats.where(~F.col("base_failed"))
    levels = F.explode(
        F.array(
            F.struct(F.lit(0).alias("level"), everything.alias("key"), everything.alias("parent")),
            F.struct(F.lit(1).alias("level"), lang.alias("key"), everything.alias("parent")),
            F.struct(F.lit(2).alias("level"), fine.alias("key"), lang.alias("parent")),
        )
    ).alias("g")
    placed = passed.select(log_length().alias("length"), levels).select(F.col("g.key").alias("group_key"), "g.level", "g.parent", "length")
    medians = materialize(
        placed.groupBy("group_key", "level", "parent").agg(F.percentile_approx("length", 0.5, 2000).alias("center"), F.count("*").alias("rows"))
    )
    groups = medians.select("group_key", "level", "parent")
    small = groups.count() <= SMALL_ROWS
    hint = F.broadcast if small else (lambda df: df)
    # The median word length of a group leans on the level above, too.
    leaning = _with_ancestors(medians.select("group_key", "center", "rows"), groups, ["group_key"], ["center", "rows"], small)
    centers = materialize(leaning.select("group_key", _leaning("center", "rows").alias("center")))
    of_rows = passed.select("word_chars", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", F.explode(F.array(everything, lang, fine)).alias("group_key"))
    rows = materialize(transformed(of_rows.join(hint(centers), "group_key")).select("group_key", *FEATURES))
    estimates = materialize(centers.join(mcd_estimates(rows, groups, small), "group_key"))
    wide = transformed(stats.withColumn("group_key", F.when(~F.col("base_failed"), fine)).join(hint(estimates), "group_key", "left"))
    distance = F.when(~F.col("base_failed"), _squared_distance("m", "c"))
    return wide.withColumn("distance2", distance).select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUT, F.lit(True))).alias("kept"),
        "distance2",
        F.col("lang").alias("lang"),
        F.col("source").alias("source"),
    )


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
