"""What several operators of this subpackage need: a shared work folder, lineage cuts and chunk keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: U+0020 and U+0009 to U+000D; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode a temporary one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-siftlog-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table of one run, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/siftlog/{name}-{uuid.uuid4().hex}"


_BATCH, _OWN = "spark.sql.execution.arrow.maxBytesPerBatch", "siftlog.arrow.ownBytesPerBatch"


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on the session's Arrow batches have about ``size`` bytes, until ``free_batches``: for a table that is written by somebody else.

    Ten thousand whole texts in a batch are tens of MB, which a task holds in the JVM and in Python at once. Rows and
    results stay the same. Not for groups: a task puts a group's batches together, which copies them.
    """
    if spark.conf.get(_OWN, None) is None:
        spark.conf.set(_OWN, spark.conf.get(_BATCH, None) or "")
    spark.conf.set(_BATCH, str(size))


def free_batches(spark: SparkSession) -> None:
    """The session's own bound holds again; without ``bound_batches`` before it nothing changes."""
    own = spark.conf.get(_OWN, None)
    if own is not None:
        spark.conf.set(_BATCH, own) if own else spark.conf.unset(_BATCH)
        spark.conf.unset(_OWN)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """``bound_batches`` for what is written inside."""
    bound_batches(spark, size)
    try:
        yield
    finally:
        free_batches(spark)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns and clashing names never meet them."""
    return df.select(*[df[c].alias(name) for name, c in columns.items()])


def chunks_for(total_bytes: int, chunk_bytes: int) -> int:
    return max(1, -(-int(total_bytes or 0) // chunk_bytes))


def chunk_of(*key: Column | str, chunks: int) -> Column:
    """The chunk of a document: a hash of its key, so that no source or group of copies gathers in one chunk."""
    return F.pmod(F.xxhash64(*key), F.lit(chunks)).cast("int")


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores behind it as make it a column of none of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
