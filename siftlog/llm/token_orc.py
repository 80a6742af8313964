"""Token ids as ORC files: integer run lengths, row indexes and Bloom filters on document ids.

Rows are dealt by ranges of doc_id and sorted in each, so files follow one another in id order, row-group
minima and maxima prune reads by id, and stripes are read in parallel. Files hold about ``file_bytes`` of text, so their
number grows with the input and the work on one doesn't. Starts come from sums of files and prefix
sums inside each file, never from one task for all rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.llm.bytetext import give_back, spans, text_buffers
from siftlog.llm.shared import chunks_for, picked, saved, small_batches
from siftlog.llm.tokens import pieces


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20, file_bytes: int = 128 << 20) -> None:
    """Write doc_id and its token ids (ids array<int>, with the end id) in ascending doc_id order; null ids first.

    A null or empty text holds the end id alone. Repeated rows are each written; equal ids go by text, and equal rows
    are spread over several files by the task that read them. An empty table writes files without rows. Ids are below
    2**31. There are as many files as the texts fill, but one for each shuffle partition at least.
    """
    docs = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks_for(held, file_bytes))

    def encode(batches):
        give_back()  # what tasks of other operators left in this worker
        coder = pieces(tokenizer_path)
        for b in batches:
            data, offsets = text_buffers(b["text"])
            for i, j in spans(offsets, 1 << 18):
                ids, n = coder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, np.cumsum(n), np.int32(end_id))
                ends = np.concatenate(([0], np.cumsum(n + 1)))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["doc_id", "ids"])
        give_back()

    docs = docs.withColumn("reader", F.spark_partition_id())
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = docs.repartitionByRange(n, *order, "reader").sortWithinPartitions(*order)
    out = ordered.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>").write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
    out = out.option("orc.create.index", "true").option("orc.row.index.stride", 1000).option("orc.stripe.size", stripe_bytes).option("compression", "zstd")
    with small_batches(docs.sparkSession):
        out.orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids; filters on doc_id reach the files' Bloom filters and row indexes."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), read from the files."""

    def digest(batches):
        for b in batches:
            ids = b["ids"]
            ends = np.asarray(ids.offsets, np.int64)
            values = np.asarray(ids.values, np.int32).astype("<u4")
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b["file"], b["place"], b["doc_id"], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["file", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_token_orc(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids").withColumn("place", F.monotonically_increasing_id())
    rows = rows.select("file", "place", "doc_id", "ids").mapInArrow(digest, "file string, place long, doc_id long, n_tokens long, ids_crc32 long")
    with small_batches(spark):
        rows = saved(rows, "orc-index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("held"), F.bool_or(F.col("doc_id").isNull()).alias("null_ids"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    by_id = W.orderBy(F.col("null_ids").desc(), F.col("least").asc_nulls_first(), F.col("most").asc_nulls_first(), "file")  # one row for each file
    files = files.withColumn("base", F.coalesce(F.sum("held").over(by_id.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(files.select("file", "base"), "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
