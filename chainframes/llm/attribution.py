"""Token counts by offset-mapped attribution.

Every document is encoded once, whole.  The tokens' character spans are joined
with the document's sections (sorted, disjoint stretches of characters), and a
token that crosses a border is given to sections by an explicit rule:

* ``first`` / ``last``: the section of its first / last character;
* ``most``: the section that holds most of its characters, the first of equals;
* ``share``: every section gets the share of its characters.

Characters of a token in no section count as outside; under ``first``, ``last``
and ``most`` the outside takes part like a section.  The sections' tokens and
those outside always add up to the document's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, refuse_clashes, text_or_empty
from .packing import worker_tokenizer

RULES = ("first", "last", "most", "share")


def attribute(spans: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per stretch between consecutive ``borders`` (which tile the text),
    and how many tokens cross a border.  An empty span counts where it starts."""
    n = len(borders) - 1
    start, end = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.clip(np.searchsorted(borders, start, side="right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(borders, end - 1, side="right") - 1, 0, n - 1)
    crossing = np.flatnonzero(first != last)
    counts = np.bincount(last if rule == "last" else first, minlength=n).astype(float)
    if rule in ("most", "share"):
        for k in crossing.tolist():
            a, b = int(first[k]), int(last[k])
            own = np.minimum(borders[a + 1 : b + 2], end[k]) - np.maximum(borders[a : b + 1], start[k])
            counts[a] -= 1
            if rule == "most":
                counts[a + int(own.argmax())] += 1
            else:
                counts[a : b + 1] += own / (end[k] - start[k])
    return counts, len(crossing)


def tile(sections: np.ndarray, n_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of stretches that tile ``n_chars`` characters, and which stretch
    each section is (-1: an empty section).  Sections must be in order and not
    overlap; they are cut to the text."""
    borders, where, at = [0], np.full(len(sections), -1), 0
    for i, (start, end) in enumerate(np.clip(sections, 0, n_chars).tolist()):
        if start < at:
            raise ValueError("sections overlap or are out of order")
        if end <= start:
            continue
        if start > at:
            borders.append(start)
        where[i] = len(borders) - 1
        borders.append(end)
        at = end
    if at < max(n_chars, 1):
        borders.append(max(n_chars, 1))
    return np.array(borders, dtype=np.int64), where


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    sections: Column,
    *,
    rule: str = "most",
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep`` columns plus ``n_tokens, n_crossing, outside, sections`` per row.

    ``sections`` is a column of array<struct<start int, end int>> in code
    points, in order and disjoint, or of array<int>, the lengths of sections
    that follow each other from the first character on.  It comes back as
    starts and ends with each section's ``tokens``.
    Null texts count as empty and have no tokens; null or missing sections leave
    all tokens outside; empty sections have none.  Repeated rows are counted
    each; an empty table gives no rows.  ``keep`` may not hold a name of the added
    columns."""
    refuse_clashes(keep, ("n_tokens", "n_crossing", "outside", "sections"))
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                totals, crossings, outside, values, counts_out, lengths = [], [], [], [], [], [0]
                for value, own in zip(part.column(0), part.column(1), strict=True):
                    text = value.as_py() or ""
                    spans = encoder.spans(text)
                    if not own.is_valid or not len(own.values):
                        places = np.zeros((0, 2), np.int64)
                    elif consecutive:
                        ends = np.cumsum(own.values.to_numpy().astype(np.int64))
                        places = np.stack([np.r_[0, ends[:-1]], ends], axis=1)
                    else:
                        flat = own.values
                        places = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1).astype(np.int64)
                    borders, where = tile(places, len(text))
                    counts, n = attribute(spans, borders, rule)
                    mine = np.where(where >= 0, counts[where], 0.0)
                    totals.append(len(spans))
                    crossings.append(n)
                    outside.append(float(len(spans) - mine.sum()))
                    values.append(places)
                    counts_out.append(mine)
                    lengths.append(len(places))
                flat = np.concatenate(values)
                structs = pa.StructArray.from_arrays(
                    [pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1].astype(np.int32)), pa.array(np.concatenate(counts_out))], fields=list(kind.value_type)
                )
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[2:], pa.array(totals, pa.int64()), pa.array(crossings, pa.int64()), pa.array(outside, pa.float64()), listed],
                    [*part.schema.names[2:], "n_tokens", "n_crossing", "outside", "sections"],
                )

    rows = docs.select(F.col(text_col).alias("__text"), sections.alias("__sections"), *keep)
    consecutive = dict(rows.dtypes)["__sections"] == "array<int>"
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join(
        [f"`{c}` {kinds[c]}" for c in keep]
        + ["n_tokens long, n_crossing long, outside double, sections array<struct<start:int,end:int,tokens:double>>"]
    )
    return rows.mapInArrow(run, schema)


def line_lengths(text: Column) -> Column:
    """The lengths of a text's lines; each holds its line break, so that lines
    tile the text.  An empty text has one empty line, a null text none.  Lines
    are only counted here and added up where the tokens are: linear in the text."""
    return F.transform(F.split(text, "\n"), lambda line: F.char_length(line) + 1)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", text_or_empty().alias("text"))
    found = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), line_lengths(F.col("text")), rule="most")
    return found.select("doc_id", "n_tokens", "n_crossing", F.posexplode("sections").alias("line", "s")).select(
        "doc_id", "line", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.tokens").cast("long").alias("tokens"), "n_tokens", "n_crossing"
    )
