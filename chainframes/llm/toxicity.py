"""Toxicity by maximum-scoring segments.

Learning: features are lower-cased tokens and their prefixes.  Their log-odds
between toxic and other documents are shrunk by a Dirichlet prior that follows
the features' overall frequency.  A feature whose likelihood-ratio statistic is
large enough counts, for or against: a token scores by its strongest feature for
toxicity, else by its own log-odds against it; every token costs a small gap.

Scoring: one linear pass over a whole text finds all maximal scoring segments.
For a text of n tokens and a segment of score S, the number of segments that
clean text would give by chance is E = K n exp(-lambda S).  The largest segment
scores of clean texts follow exp(-K n exp(-lambda s)); lambda and K maximise that
likelihood over clean learning documents that no feature was chosen by.  A
document's evidence is the sum of -log E over its segments of E < MAX_E; a
logistic fit turns its logarithm into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh_name, materialize, refuse_clashes, text_or_empty
from .fingerprint import shingle_hashes, word_hashes
from .language import held_out

TOKEN = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 5, 6, 7)
#: At most about so many documents of either class are learned from.
MAX_ROWS = 6000
#: One learning document in so many is kept from the choice of features, for the
#: constants of the extreme values.
APART = 4
MIN_DOCUMENTS = 4
MIN_STATISTIC = 4.2
MIN_LOG_ODDS = 1.5
PRIOR = 10.0
#: Cost of a token that is no feature.
GAP = 0.05
MAX_E = 0.1


def token_features(token: str) -> list[str]:
    return ["=" + token, *(token[:k] for k in PREFIXES if len(token) > k)]


@dataclass
class ToxicityModel:
    """Scores of features, as many as the bounded sample supports, and four
    numbers."""

    scores: dict[str, float]
    lam: float = 1.0
    k: float = 1e-4
    slope: float = 0.0
    intercept: float = 0.0

    def token_score(self, token: str) -> float:
        get = self.scores.get
        own, *prefixes = token_features(token)
        best = max([get(own, 0.0), *[get(f, 0.0) for f in prefixes]])
        return best if best > 0 else get(own, 0.0)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, list[float]]:
        """Sum of -log E over significant segments, and all E values."""
        logs = [math.log(self.k * max(n, 1)) - self.lam * s for _, _, s in segments]
        return sum(-x for x in logs if x < math.log(MAX_E)), [math.exp(x) for x in logs]

    def probability(self, evidence: float) -> float:
        z = self.slope * math.log1p(evidence) + self.intercept
        return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


def maximal_segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence in which the tokens at
    ``hits`` have scores and every other costs ``gap``, as (first token, one
    after the last, score), in linear time: candidates are kept with
    their running sums left and right, and one that a later candidate extends
    is joined with it."""
    kept: list[tuple[int, int, float, float]] = []  # first, end, left sum, right sum
    links: list[int] = []  # last earlier candidate with a smaller left sum
    total, at = 0.0, 0
    for i, score in hits:
        left = total - gap * (i - at)
        total, at = left + score, i + 1
        if score <= 0:
            continue
        first, end, right = i, i + 1, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = links[j]
            if j < 0 or kept[j][3] >= right:
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:], links[j:]
        kept.append((first, end, left, right))
        links.append(j)
    return [(first, end, right - left) for first, end, left, right in kept]


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found: set[str] = set()
            for token in set(TOKEN.findall(text.as_py().lower())):
                found.update(token_features(token))
            counts[toxic].update(found)
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)],
            ["feature", "clean", "toxic"],
        )


def _scan(model: ToxicityModel, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    tokens = [TOKEN.findall(t.lower()) for t in texts]
    scores = {}
    for token in set().union(*tokens):
        score = model.token_score(token)
        if score:
            scores[token] = score - GAP
    for found in tokens:
        hits = [(i, scores[t]) for i, t in enumerate(found) if t in scores]
        yield len(found), maximal_segments(hits, GAP)


def _scored(model: ToxicityModel, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(0).to_pylist()]
                evidence, ns, segments = [], [], []
                for text, (n, found) in zip(texts, _scan(model, texts), strict=True):
                    value, e_values = model.evidence(found, n)
                    evidence.append(value)
                    ns.append(n)
                    if spans:
                        # the places of tokens are looked up only where one was found
                        places = [m.span() for m in TOKEN.finditer(text.lower())] if found else []
                        segments.append(
                            [
                                {"start": places[a][0], "end": places[b - 1][1], "score": s, "e_value": e}
                                for (a, b, s), e in zip(found, e_values, strict=True)
                                if e < MAX_E
                            ]
                        )
                    else:
                        segments.append([s for _, _, s in found])
                out = [*part.columns[1:], pa.array(ns, pa.int64()), pa.array(evidence, pa.float64())]
                names = [*part.schema.names[1:], "n_tokens", "evidence"]
                if spans:
                    out += [pa.array([model.probability(v) for v in evidence], pa.float64()), pa.array(segments, kind)]
                    names += ["score", "segments"]
                else:
                    out += [pa.array(segments, pa.list_(pa.float64()))]
                    names += ["segment_scores"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def fit_extreme_values(n: np.ndarray, largest: np.ndarray, unit: float) -> tuple[float, float]:
    """Maximum-likelihood lambda and K of P(M <= s) = exp(-K n exp(-lambda s)) from
    texts of ``n`` tokens and their largest segment scores (0: no segment, which
    counts as M <= 0).  One text of mean length and of score ``unit`` is added, so
    that both are finite where clean texts have no segment at all.

    For a given lambda, K is the number of texts with a segment over the sum of
    n exp(-lambda s); lambda is where the likelihood along that curve is flat."""
    n = np.r_[n, max(float(n.mean()), 1.0) if len(n) else 1.0].astype(float)
    s = np.r_[largest, unit].astype(float)
    some = s > 0
    count, total = float(some.sum()), float(s[some].sum())

    def slope(lam: float) -> float:
        w = n * np.exp(-lam * s)
        return count / lam - total + count * float((w * s).sum() / w.sum())

    low, high = 1e-3, 64.0
    for _ in range(80):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return low, count / float((n * np.exp(-low * s)).sum())


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by damped Newton steps; smoothed targets and a small
    ridge keep both finite where the classes are apart."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    w = np.array([0.0, math.log((up + 1) / (down + 1))])
    design = np.stack([x, np.ones(len(x))], axis=1)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - target) + ridge @ w
        hess = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(max(w[0], 0.0)), float(w[1])


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits a model on up to about MAX_ROWS labelled documents of each class,
    those of lowest id hash.  Rows with a null id, text or label are left out;
    an id with several labels counts as toxic if one says so.  Near copies are
    learned from once (texts with the same smallest shingle hash), as features
    would otherwise be counted by how often a text was copied.  Without labels
    of both kinds every text scores the share of toxic labels (or 0).  The same
    rows give the same model, in whatever order they come."""
    marked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    limits = [min(1 << 30, int((1 << 30) * MAX_ROWS / max(1, sizes.get(t, 0)))) for t in (0, 1)]
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = marked.where(share < F.when(F.col("toxic") == 1, limits[1]).otherwise(limits[0]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    sample = (
        rows.join(F.broadcast(chosen), "id")
        .withColumn("hashes", word_hashes(text_or_empty()))
        .withColumn("family", F.array_min(shingle_hashes(F.col("hashes"))))
        .groupBy("toxic", "family")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("toxic", "text", (F.pmod(F.xxhash64("family", F.lit(3)), F.lit(APART)) == 0).alias("apart"))
    )
    sample = materialize(sample)
    counted_by = sample.where(~F.col("apart"))
    n = {r["toxic"]: r["count"] for r in counted_by.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    model = ToxicityModel({})
    if not n0 or not n1:
        model.intercept = -40.0 if not n1 else 40.0
        return model
    y0, y1 = F.col("clean").cast("double"), F.col("toxic").cast("double")
    e1 = (y0 + y1) * (n1 / (n0 + n1))
    e0 = (y0 + y1) * (n0 / (n0 + n1))
    part = lambda y, e: F.when(y > 0, y * F.log(y / e)).otherwise(F.lit(0.0))
    prior = (y0 + y1 + 1) * (PRIOR / (n0 + n1))
    odds = F.log((y1 + prior) / (n1 + PRIOR - y1 - prior)) - F.log((y0 + prior) / (n0 + PRIOR - y0 - prior))
    counted = counted_by.select("toxic", "text").mapInArrow(_feature_counts, "feature string, clean long, toxic long")
    features = (
        counted.groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.greatest("clean", "toxic") >= MIN_DOCUMENTS)
        .withColumn("statistic", F.sqrt(F.greatest(2 * (part(y1, e1) + part(y0, e0)), F.lit(0.0))))
        .withColumn("odds", odds)
        .where((F.col("statistic") >= MIN_STATISTIC) & (F.abs(F.col("odds")) >= MIN_LOG_ODDS))
        .where((F.col("odds") > 0) & (F.col("toxic") >= MIN_DOCUMENTS) | (F.col("odds") < 0) & F.col("feature").startswith("="))
        .select("feature", "odds")
        .collect()
    )
    model.scores = {r["feature"]: float(r["odds"]) for r in features}
    seen = (
        sample.select("text", "toxic", "apart")
        .mapInArrow(_scored(model, False), "toxic int, apart boolean, n_tokens long, evidence double, segment_scores array<double>")
        .select("toxic", "apart", "n_tokens", "segment_scores")
        .collect()
    )
    clean = [r for r in seen if r["apart"] and not r["toxic"]]
    unit = float(np.median([v for v in model.scores.values() if v > 0] or [1.0]))
    model.lam, model.k = fit_extreme_values(
        np.array([r["n_tokens"] for r in clean], dtype=float), np.array([max(r["segment_scores"], default=0.0) for r in clean]), unit
    )
    seen = sorted(seen, key=lambda r: (r["toxic"], r["n_tokens"], r["segment_scores"]))
    x = np.array([model.evidence([(0, 0, s) for s in r["segment_scores"]], r["n_tokens"])[0] for r in seen])
    model.slope, model.intercept = _fit_logistic(np.log1p(x), np.array([r["toxic"] for r in seen], dtype=float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``n_tokens, evidence, score, segments``.

    ``segments`` are the significant passages in order of place: start and end
    (code points of the lower-cased text), score and E value.  Null and empty
    texts have no segment and the score of no evidence.  Texts are read whole;
    repeated rows are judged alike; an empty table gives no rows.  ``keep`` may not
    hold a name of the added columns."""
    refuse_clashes(keep, ("n_tokens", "evidence", "score", "segments"))
    rows = docs.select(F.col(text_col).alias(fresh_name("__text", keep)), *keep)
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join(
        [f"`{c}` {kinds[c]}" for c in keep]
        + ["n_tokens long, evidence double, score double, segments array<struct<start:int,end:int,score:double,e_value:double>>"]
    )
    return rows.mapInArrow(_scored(model, True), schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    found = score_toxicity(docs, learn_toxicity(docs, labels))
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.size("segments").alias("n_segments"),
    )
