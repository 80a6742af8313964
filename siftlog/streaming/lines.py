"""A stream of text lines with addresses: files that come chunk by chunk, numbered on as one file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.streaming.jobs import drain

LINES = "path string, line_no long, text string, tick long"


def tail_lines(spark: SparkSession, root: str, out: str, files_each: int = 100) -> DataFrame:
    """path, line_no, text, tick of all lines that have come to ``root``; a later call with the same ``out`` reads what is new.

    A path is a folder in ``root``; its files, also in folders of their own, are chunks that follow each other by name, none of
    which may come after a later one was read. Lines are numbered inside each split of a chunk, moved by the splits before it and by what earlier ticks brought of
    the path, so numbers are those of the file that the chunks make up. A tick that failed is read and written anew.
    """
    below = rf".*/{re.escape(root.rstrip('/').rsplit('/', 1)[-1])}/([^/]+)/(.+)$"
    path, chunk = (F.regexp_extract("_metadata.file_path", below, g) for g in (1, 2))
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", files_each).option("recursiveFileLookup", True).load(root)
    stream = stream.select(path.alias("path"), chunk.alias("chunk"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def sink(rows: DataFrame, tick: int) -> None:
        own = rows.sparkSession
        came = rows.withColumn("at", F.monotonically_increasing_id())
        raw = f"{out}/raw/tick={tick}"
        came.write.mode("overwrite").parquet(raw)  # read once: numbers and totals are of the same rows
        came = own.read.schema(came.schema).parquet(raw)
        held = came.groupBy("path", "chunk", "block").agg(F.count("*").alias("n"))
        inside = W.partitionBy("path").orderBy("chunk", "block").rowsBetween(W.unboundedPreceding, -1)  # a row a split
        earlier = own.read.schema("path string, n long, tick long").parquet(f"{out}/counts").where(F.col("tick") < tick) if tick else own.createDataFrame([], "path string, n long, tick long")
        earlier = earlier.groupBy("path").agg(F.sum("n").alias("earlier"))
        before = held.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(earlier, "path", "left").select("path", "chunk", "block", (F.col("inside") + F.coalesce("earlier", F.lit(0))).alias("before"))
        numbered = came.withColumn("i", F.row_number().over(W.partitionBy("path", "chunk", "block").orderBy("at"))).join(before, ["path", "chunk", "block"])
        numbered.select("path", (F.col("i") + F.col("before")).alias("line_no"), "text").write.mode("overwrite").parquet(f"{out}/data/tick={tick}")
        held.groupBy("path").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/counts/tick={tick}")

    drain(stream, sink, f"{out}/cursor")
    return spark.read.schema(LINES).parquet(f"{out}/data")
