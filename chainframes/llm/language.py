"""Language identification by error-correcting output codes.

Each language gets a codeword of bits.  For every bit a binary classifier over
hashed byte n-grams separates the languages with a one from those with a zero.
A text's bits are decoded to the language whose codeword costs the least
logistic loss, each bit weighted by how well its classifier did on the learning
texts; a small lead over the second codeword marks the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import utf8
from .common import counted_broadcast, documents, materialize, refuse_clashes

#: Hash buckets of n-grams (orders 1 to 3 together).
BUCKETS = 8192
UNKNOWN = "und"
#: A text is ambiguous if the winner's probability is below this.
CLEAR = 0.6
#: About so many learning documents, evenly spread over the languages, fit the bit
#: weights and the temperature.
CALIBRATION_ROWS = 4000
#: With more languages, balanced bits are taken as they are drawn: they are far
#: apart anyway, and comparing candidates costs the square of the languages.
SEARCHED_LANGUAGES = 64
#: Texts that a task looks at together.
ROWS_AT_ONCE = 256

_FOLD = np.arange(256, dtype=np.uint8)
for _b in range(256):
    if 0x41 <= _b <= 0x5A:
        _FOLD[_b] = _b + 32
    elif _b < 0x80 and not 0x61 <= _b <= 0x7A:
        _FOLD[_b] = 0x20  # digits, punctuation and white space part words


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the two-byte Latin-1 capitals; blanks for other ASCII."""
    out = _FOLD[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    capital = (raw[after] >= 0x80) & (raw[after] <= 0x9E) & (raw[after] != 0x97)
    out[after[capital]] += 0x20
    return out


def gram_buckets(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the 1-, 2- and 3-gram that ends at each byte (the first n-1 of
    an order are not valid)."""
    x = folded.astype(np.uint32)
    two = x.copy()
    two[1:] |= x[:-1] << np.uint32(8)
    three = two.copy()
    three[2:] |= x[:-2] << np.uint32(16)
    mul, shift = np.uint32(2654435761), np.uint32(32 - BUCKETS.bit_length() + 1)
    return x, ((two + np.uint32(1 << 24)) * mul) >> shift, ((three + np.uint32(2 << 24)) * mul) >> shift


def gram_counts(raw: np.ndarray) -> np.ndarray:
    """Counts of a text's n-grams by bucket; runs of blanks count as they are,
    grams of blanks only are left out."""
    if not len(raw):
        return np.zeros(BUCKETS)
    folded = fold(raw)
    one, two, three = gram_buckets(folded)
    letter = folded != 0x20
    some = letter.copy()
    out = np.bincount(one[letter], minlength=BUCKETS).astype(float)
    some[1:] |= letter[:-1]
    out += np.bincount(two[1:][some[1:]], minlength=BUCKETS)
    some[2:] |= letter[:-2]
    out += np.bincount(three[2:][some[2:]], minlength=BUCKETS)
    return out


def has_letter(raw: np.ndarray) -> bool:
    if (((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)).any():
        return True
    return bool((raw >= 0x80).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """Codewords (rows) of plus and minus one: one bit per language against the
    rest, and balanced bits chosen one by one to keep codewords far apart."""
    if n < 2:
        return np.ones((n, 1))
    rng = np.random.default_rng(seed)
    bits = [np.where(np.arange(n) == i, 1, -1) for i in range(n)] if n <= 12 else []
    extra = max(4, int(np.ceil(4 * np.log2(n))))
    for _ in range(extra):
        best, most = None, -1.0
        for _ in range(40 if n <= SEARCHED_LANGUAGES else 1):
            bit = np.where(rng.permutation(n) < n // 2, 1, -1)
            if n > SEARCHED_LANGUAGES:
                best = bit
                continue
            trial = np.stack([*bits, bit], axis=1)
            apart = (trial[:, None, :] != trial[None, :, :]).sum(axis=2)[np.triu_indices(n, 1)]
            fresh = not any((bit == b).all() or (bit == -b).all() for b in bits)
            score = apart.min() + apart.mean() / 1000 + fresh
            if score > most:
                best, most = bit, score
        bits.append(best)
    return np.stack(bits, axis=1).astype(float)


@dataclass
class LanguageModel:
    """BUCKETS x bits weights and languages x bits signs; the number of bits
    grows with the logarithm of the number of languages."""

    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds of a gram
    bit_weights: np.ndarray
    scale: float

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """Mean log odds per gram of each bit, for rows of counts."""
        return counts @ self.weights / np.maximum(counts.sum(axis=1, keepdims=True), 1)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword (rows x languages)."""
        z = self.scale * margins[:, None, :] * self.codes[None, :, :]
        return (np.logaddexp(0.0, -z) * self.bit_weights).sum(axis=2)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its probability, and how well it fits:
        1 for no loss, 0 for the loss of bits that say nothing."""
        losses = self.losses(margins)
        low = losses.min(axis=1, keepdims=True)
        share = np.exp(low - losses)
        share /= share.sum(axis=1, keepdims=True)
        best = losses.argmin(axis=1)
        return best, share[np.arange(len(best)), best], 1.0 - low[:, 0] / (np.log(2.0) * self.bit_weights.sum())


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language and non-empty bucket of each task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        raw, at = utf8(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            sums[lang] = sums.get(lang, 0) + gram_counts(raw[at[i] : at[i + 1]])
    for lang, counts in sums.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(counts[some])], ["lang", "bucket", "n"]
        )


def _margin_rows(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                raw, at = utf8(part.column(2))
                counts = np.stack([gram_counts(raw[at[i] : at[i + 1]]) for i in range(part.num_rows)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(list(model.margins(counts)), pa.list_(pa.float64()))], ["lang", "h", "margins"]
                )

    return run


def _bit_weights_of_grams(counted: DataFrame, totals: DataFrame, languages: list[str], codes: np.ndarray, floor: float) -> np.ndarray:
    """Log odds of every gram and bit: the mean rate over the languages with a one
    against that over those with a zero.  Rates are added up per bucket in Spark;
    BUCKETS x bits sums come to the driver, whatever the number of languages."""
    n, width = codes.shape
    ones = (codes > 0).sum(axis=0)
    code = counted.sparkSession.createDataFrame(
        [(lang, [bool(x) for x in row]) for lang, row in zip(languages, codes > 0, strict=True)], "lang string, code array<boolean>"
    )
    rate = counted.join(counted_broadcast(totals), "lang").select("lang", "bucket", (F.col("n") / F.greatest("total", F.lit(1.0))).alias("rate"))
    sums = rate.join(F.broadcast(code) if n <= 20_000 else code, "lang").groupBy("bucket").agg(
        F.sum("rate").alias("all"), *[F.sum(F.when(F.get("code", F.lit(b)), F.col("rate")).otherwise(0.0)).alias(f"b{b}") for b in range(width)]
    )
    weights = np.zeros((BUCKETS, width))
    for r in sums.toLocalIterator():
        with_one = np.array(r[2:])
        zeros = np.maximum(r["all"] - with_one, 0.0) / np.maximum(n - ones, 1)
        weights[r["bucket"]] = np.log(with_one / np.maximum(ones, 1) + floor) - np.log(zeros + floor)
    weights[:, (ones == 0) | (ones == n)] = 0.0
    return weights


def learn_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Fits a model to all rows with a text and a language; every language that
    occurs is learned.

    Gram counts are summed per language where the texts are read and then
    added up, so that only languages x BUCKETS numbers travel; the driver holds
    the languages, their codewords and BUCKETS x bits weights.  Bit weights and
    the temperature are fitted on about CALIBRATION_ROWS documents, as many of
    each language, those of lowest text hash; copies count once.  Without any
    labelled row the model has no language and every text is unknown."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    counted = materialize(rows.mapInArrow(_sum_counts, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    totals = materialize(
        sizes.join(counted.groupBy("lang").agg(F.sum("n").alias("grams")), "lang", "left").select("lang", "rows", F.coalesce("grams", F.lit(0.0)).alias("total"))
    )
    found = sorted((r["lang"], r["total"]) for r in totals.collect())
    languages = [lang for lang, _ in found]
    n = len(languages)
    if not n:
        return LanguageModel([], np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.ones(1), 1.0)
    index = {lang: i for i, lang in enumerate(languages)}
    codes = code_matrix(n)
    floor = smoothing / np.mean([max(total, 1.0) for _, total in found])
    weights = _bit_weights_of_grams(counted, totals, languages, codes, floor)
    model = LanguageModel(languages, codes, weights, np.ones(codes.shape[1]), 1.0)
    if n == 1:
        return model
    bounds = totals.select("lang", (F.lit(float(1 << 30) * CALIBRATION_ROWS / n) / F.col("rows")).alias("bound"))
    sample = (
        rows.withColumn("h", F.xxhash64("text"))
        .join(F.broadcast(bounds) if n <= 20_000 else bounds, "lang")
        .where(F.pmod("h", F.lit(1 << 30)) <= F.col("bound"))
        .select("lang", "h", "text")
    )
    seen = sample.mapInArrow(_margin_rows(model), "lang string, h long, margins array<double>").groupBy("lang", "h").agg(F.first("margins").alias("margins"))
    seen = sorted(seen.collect(), key=lambda r: (r["lang"], r["h"]))
    if seen:
        margins = np.array([r["margins"] for r in seen])
        truth = np.array([index[r["lang"]] for r in seen], dtype=int)
        right = (np.sign(margins) == codes[truth]).mean(axis=0)
        gain = np.log(np.clip(right, 0.05, 0.995) / np.clip(1 - right, 0.005, 0.95))
        model.bit_weights = np.maximum(gain, 0.05) / np.maximum(gain, 0.05).mean()
        best = None
        for scale in (1, 2, 4, 8, 16, 32, 64):
            model.scale = float(scale)
            cost = 0.0
            for at in range(0, len(truth), ROWS_AT_ONCE):
                losses = model.losses(margins[at : at + ROWS_AT_ONCE])
                own = losses[np.arange(len(losses)), truth[at : at + ROWS_AT_ONCE]]
                low = losses.min(axis=1)
                cost += float((own - low + np.log(np.exp(low[:, None] - losses).sum(axis=1))).sum())
            if best is None or cost < best[0]:
                best = (cost, float(scale))
        model.scale = best[1]
    return model


def _predict(model: LanguageModel, text_at: int, n_keep: int):
    """Reads the text from column ``text_at`` and passes the first ``n_keep`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                raw, at = utf8(part.column(text_at))
                spans = [raw[at[i] : at[i + 1]] for i in range(part.num_rows)]
                known = [bool(model.languages) and has_letter(s) for s in spans]
                names, scores, fits = [UNKNOWN] * len(spans), [0.0] * len(spans), [0.0] * len(spans)
                if any(known):
                    counts = np.stack([gram_counts(s) if k else np.zeros(BUCKETS) for s, k in zip(spans, known, strict=True)])
                    best, share, fit = model.decode(model.margins(counts))
                    for j in np.flatnonzero(known).tolist():
                        names[j], scores[j], fits[j] = model.languages[best[j]], float(share[j]), float(fit[j])
                unclear = [n == UNKNOWN or s < CLEAR for n, s in zip(names, scores, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n_keep], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64()), pa.array(unclear, pa.bool_())],
                    [*part.schema.names[:n_keep], "lang_pred", "score", "fit", "ambiguous"],
                )

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``lang_pred, score, fit, ambiguous`` for every row.

    ``score`` is the winner's share among all codewords; ``fit`` tells how well
    it explains the bits at all (1: without loss, 0 or less: no better than
    bits that say nothing), whatever its rivals.  Only the text decides.  Null
    texts and texts without a letter are ``und`` with score and fit 0 and
    ambiguous.  Repeated rows are judged alike; an empty table
    gives no rows.  Texts are read whole, in Arrow batches.  ``keep`` may not hold
    a name of the added columns."""
    refuse_clashes(keep, ("lang_pred", "score", "fit", "ambiguous"))
    rows = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("__text"))
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["lang_pred string", "score double", "fit double", "ambiguous boolean"])
    return rows.mapInArrow(_predict(model, text_at, len(keep)), schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn_languages(docs.where(~held_out()))
    found = identify_languages(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
