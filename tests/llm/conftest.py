import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text) or full tuples as a documents table."""

    def make(rows, extra=False):
        full = [(*r, None, None, None)[:5] if len(r) < 5 else r for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:  # names that operators use for themselves
            from pyspark.sql import functions as F

            for name in ("id", "h", "size", "rank", "fp", "component", "chunk", "rid", "bucket", "toxic", "score", "words", "text_1"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """A small corpus with copies, near copies, shared passages and odd texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "té", "Sa"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = text(60)
    rows = [(i, text(rng.randint(1, 160))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]  # copies
    for i in range(10):  # near copies
        words = rows[20 + i][1].split()
        words[len(words) // 2] = "changed"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, f"{text(10)}\n{shared}\t{text(12)}") for i in range(5)]
    rows += [(400, "ja " * 300), (401, None), (402, ""), (403, " \n\t "), (404, "one"), (405, text(6000)), (None, text(50)), (406, "É! #$ 123")]
    rows += [(407, text(90))] * 3  # repeated rows
    return rows
