"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; Java and Python agree on this class.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for an empty text.

    ``text`` must be a plain column (it is used twice)."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def refuse_clashes(keep: Iterable[str], added: Iterable[str]) -> None:
    """Kept columns may not be called like those that an operator adds, nor twice
    alike."""
    keep = list(keep)
    if clash := sorted({c for c in keep if keep.count(c) > 1} | set(keep) & set(added)):
        raise ValueError(f"keep holds a name twice, or names of added columns: {clash}")


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """A column name that the caller's table does not have (in any case of letters)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a
    session on one machine (as in tests) gets a temporary folder; on a cluster
    that is an error, as executors would not see each other's files."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Folders written by the innermost ``scratch`` that is open.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back.

    Used where a result is read by several jobs, so that a lost executor costs
    a reread and not a recomputation of everything before."""
    path = shared_dir(df.sparkSession)
    if (folders := _written.get()) is not None:
        folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are materialized inside go when it ends, but for those written
    by the function it gives; those belong to the surrounding ``scratch``, if any.

    For steps whose outcome no longer reads what led to it."""
    outer, mine = _written.get(), []

    def result(df: DataFrame) -> DataFrame:
        token = _written.set(outer)
        try:
            return materialize(df)
        finally:
            _written.reset(token)

    token = _written.set(mine)
    try:
        yield result
    finally:
        _written.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for folder in map(hadoop, mine):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Tables of one narrow row per group are sent to every executor up to so many rows.
SMALL_ROWS = 20_000


def counted_broadcast(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is counted to be small;
    beyond that Spark chooses the join, and splits a skewed one."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when the query ends.

    For queries that end in ``materialize``, whose shuffles nobody reads again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Whole texts travel to and from Python in batches of so many rows.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches hold BATCH_ROWS rows at most; a
    smaller limit of the caller's stays.

    A batch is held outside the heap in the executor and once more in Python, and
    at Spark's 10 000 rows of whole texts or run sets that is tens of MB for each
    task.  No result depends on it.  It is not set back: a query that is returned
    reads it when it runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
