"""Token counts through a digest cache.

A cache table holds, by the digest of normalised content and the digest of the tokenizer file, the token count.
Counting joins documents to it, encodes each distinct content that misses once, appends those counts, and joins
again. Runs of ASCII spaces and line feeds become one space and those at the ends go: the tokenizer drops them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm.bytetext import spans, text_buffers
from siftlog.llm.shared import picked, saved, small_batches
from siftlog.llm.tokens import pieces

CACHE = "content binary, tokenizer string, n_tokens long"


def version_of(path: str) -> str:
    """Digest of the tokenizer file, read where it is configured: on the driver."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """content, n_tokens of one tokenizer version; empty where no table is yet. Twice appended contents count once."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], "content binary, n_tokens long")
    rows = spark.read.schema(CACHE).parquet(path)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, most_broadcast: int = 1 << 17) -> DataFrame:
    """Return doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit); whole texts, no special tokens added.

    A null text is empty and has 0 tokens. Repeated rows are each returned. A null id stays null. An empty table
    gives an empty result and leaves the cache as it is. A second run over the same contents encodes nothing. Up to
    ``most_broadcast`` missing digests go to the tasks, so texts that hit aren't shuffled; if more are missing, copies meet first
    and the distinct texts are joined to them, with equal results.
    """
    spark, version = docs.sparkSession, version_of(tokenizer_path)
    docs = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    content = F.unhex(F.sha2(F.trim(F.regexp_replace("text", "[ \n]+", " ")), 256))
    docs = docs.withColumn("content", content)
    rows = saved(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "tokens-contents")
    cached = read_cache(spark, cache_path, version)
    distinct = lambda df: df.groupBy("content").agg(F.first("text").alias("text"))  # noqa: E731  # copies meet in each task before the shuffle
    if cached.limit(1).count():
        missing = saved(rows.select("content").distinct().join(cached, "content", "left_anti"), "tokens-missing")
        few = missing.count() <= most_broadcast
        texts = distinct(docs.join(F.broadcast(missing), "content", "left_semi")) if few else distinct(docs).join(missing, "content", "left_semi")
    else:
        texts = distinct(docs)

    def encode(batches):
        coder = pieces(tokenizer_path)
        for b in batches:
            data, offsets = text_buffers(b["text"])
            n = [coder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], counts_only=True)[1] for i, j in spans(offsets)]
            yield pa.RecordBatch.from_arrays([b["content"], pa.array(np.concatenate([np.zeros(0, np.int64), *n]))], ["content", "n_tokens"])

    new = texts.mapInArrow(encode, "content binary, n_tokens long")
    with small_batches(spark):
        new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    out = rows.join(read_cache(spark, cache_path, version), "content")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
