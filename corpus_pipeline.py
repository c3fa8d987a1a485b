"""From raw documents to packed training sequences.

Five stages, each written as Parquet to the shared folder and reread as the
next one's input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainframes.llm.common import materialize, small_batches
from chainframes.llm.language import UNKNOWN, identify_languages, learn_languages
from chainframes.llm.mixing import mix_sources
from chainframes.llm.packing import pack_documents
from chainframes.llm.simhash import keep_one
from chainframes.llm.substrings import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document that no learned language explains better than this is rejected; a
#: share among alike languages says nothing about that and rejects nothing.
MIN_FIT = 0.05


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null texts among them) or that no
    learned language fits; a missing language is filled in with the predicted
    one.  Repeated rows stay; an empty table stays empty.  Of further columns
    none comes back."""
    small_batches(spark)
    model = learn_languages(docs)
    found = identify_languages(docs, model, keep=COLUMNS)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("fit") >= MIN_FIT)).select(
        "doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars"
    )


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id.
    Of repeated rows one stays; null texts count as one empty text; of rows
    without an id those with one text count as copies."""
    small_batches(spark)
    return keep_one(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur elsewhere; documents of nothing else go.  Texts
    without a word stay, null ones as empty texts.  Repeated rows are copies of each
    other: long ones lose all their words and go.  An empty table stays empty; of
    further columns none comes back."""
    small_batches(spark)
    found = remove_repeats(docs, keep=("doc_id", "lang", "source"))
    return found.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words"))).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars")
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it.  Null sources are one source,
    the last; repeated rows of one id are taken or left together; a table without a
    word, and an empty one, gives no rows; of further columns none comes back."""
    mixed = mix_sources(docs, keep=("text", "lang", "source", "n_chars"))
    return (
        mixed.where("copies > 0")
        .select("doc_id", "kept.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select(*COLUMNS)
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences.  Repeated rows are packed as often as they
    occur, null texts as empty ones; an empty table gives no rows."""
    import public_tokenizers

    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language identification", language_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("substring removal", substring_stage),
    ("source mixing", mixing_stage),
    ("sequence packing", packing_stage),
]

#: Learned models and a tokenizer decide the rows; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
