"""Reading text collections as addressed lines, and guards on what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders of version control and caches.
SKIPPED = ("node_modules", "__pycache__", r"\.git", r"\.hg", r"\.svn", r"\.venv")


def scan_files(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Distinct paths outside version-control and cache folders."""
    return paths.select(F.col(path_col).alias("path")).distinct().where(~F.col("path").rlike(f"(^|/)({'|'.join(SKIPPED)})(/|$)"))


def read_lines(spark: SparkSession, root: str, skip_binary: bool = True, within: int = 8192) -> DataFrame:
    """path, line_no (from 1, in the decompressed stream), text of all text files below ``root``; gzip is read through.

    Numbers are counted inside each split and moved by the splits before it, so a large file is read in parallel. A file
    with a NUL in its first ``within`` bytes is no text and left out, unless ``skip_binary`` is off; only its first split is asked.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(root)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    own = raw.withColumn("n", F.row_number().over(W.partitionBy("path", "block").orderBy("at")))
    held = raw.groupBy("path", "block").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select("path", "block", before.alias("before"))
    kept = scan_files(held).select("path")
    if skip_binary:
        head = own.where((F.col("block") == 0) & (F.col("n") <= within)).select("path", F.col("n").alias("line_no"), "text")  # a line has a byte at least
        kept = kept.join(binary_files(head, within).where("binary").select("path"), "path", "left_anti")
    return own.join(held, ["path", "block"]).join(kept, "path", "left_semi").select("path", (F.col("n") + F.col("before")).alias("line_no"), "text")


def strip_ansi(text):
    """Without terminal colour sequences; texts without the escape character are left alone."""
    return F.when(F.contains(text, F.lit("\x1b")), F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")).otherwise(text)


def binary_files(lines: DataFrame, within: int = 8192) -> DataFrame:
    """path, binary: whether a NUL lies in the first ``within`` bytes of a file; lines behind its first ``within`` aren't looked at."""
    files = lines.select("path").distinct()
    head = lines.where(F.col("line_no") <= within)
    start = F.coalesce(F.sum(F.octet_length("text") + 1).over(W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # ``within`` rows a file
    near = head.withColumn("start", start).where(F.col("start") < within)
    seen = F.contains(F.substr("text", F.lit(1), F.greatest(F.lit(within) - F.col("start"), F.lit(0)).cast("int")), F.lit("\x00"))
    sealed = near.groupBy("path").agg(F.coalesce(F.max(seen), F.lit(False)).alias("binary"))
    return files.join(sealed, "path", "left").select("path", F.coalesce("binary", F.lit(False)).alias("binary"))


def small_files(lines: DataFrame, most_bytes: int = 4096, cut: int = 300) -> DataFrame:
    """Lines of files below ``most_bytes``, cut at ``cut`` characters, with a flag."""
    sizes = lines.groupBy("path").agg(F.sum(F.octet_length("text") + 1).alias("size")).where(F.col("size") < most_bytes).select("path")
    return lines.join(sizes, "path", "left_semi").select("path", "line_no", F.substring("text", 1, cut).alias("text"), (F.length("text") > cut).alias("cut"))


def fetch_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The requested (path, line_no) only."""
    return lines.join(wanted.select("path", "line_no").distinct(), ["path", "line_no"])


def host_index(lines: DataFrame, depth: int = 1) -> DataFrame:
    """host, files, rows: the path's first ``depth`` parts are the host."""
    host = F.substring_index("path", "/", depth)
    return lines.groupBy(host.alias("host")).agg(F.count_distinct("path").alias("files"), F.count("*").alias("rows"))


def host_bill(files: DataFrame, rows: DataFrame, cap: int) -> DataFrame:
    """host, files, rows, rate, truncated, folded, withheld: what each host's part of a report holds and leaves out; no host is left out.

    ``files``: host, path, kind (stream or state), groups (how many could be shown) and cost in bytes; ``rows``: host, path, axis of the rows
    shown. truncated counts groups without a row. A file with a row keeps its block; of the others, streams before states, the
    cheapest keep theirs as long as the host's blocks fit into ``cap`` bytes, the rest are folded; withheld is their bytes.
    """
    shown = rows.groupBy("host", "path").agg(F.count("*").alias("rows"), F.count_if(F.col("axis") == "rate").alias("rate"))
    f = files.join(shown, ["host", "path"], "left").fillna(0, ["rows", "rate"]).withColumn("earned", F.col("rows") > 0)
    free = ~F.col("earned")
    # A row a file. Costs rise inside a kind, so what fits is the beginning of each kind.
    spent = F.coalesce(F.sum(F.when(F.col("earned"), F.col("cost"))).over(W.partitionBy("host")), F.lit(0))
    upto = F.sum(F.when(free, F.col("cost")).otherwise(0)).over(W.partitionBy("host", "kind").orderBy("cost", "path").rowsBetween(W.unboundedPreceding, 0))
    f = f.withColumns({"spent": spent, "upto": upto})
    stream = (F.col("kind") == "stream") & free & (F.col("spent") + F.col("upto") <= cap)
    f = f.withColumn("streams", F.coalesce(F.max(F.when(stream, F.col("upto"))).over(W.partitionBy("host")), F.lit(0)))
    kept = F.col("earned") | stream | (F.col("kind") != "stream") & (F.col("spent") + F.col("streams") + F.col("upto") <= cap)
    out = f.withColumn("kept", kept).groupBy("host").agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("rate").alias("rate"), F.sum(F.greatest(F.col("groups") - F.col("rows"), F.lit(0))).alias("truncated"),
        F.count_if(~F.col("kept")).alias("folded"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("cost"))), F.lit(0)).alias("withheld"))
    return out


def write_worklist(rows: DataFrame, path: str) -> None:
    """A tab-separated worklist, one folder for each host."""
    rows.write.mode("overwrite").partitionBy("host").option("sep", "\t").option("header", True).csv(path)
