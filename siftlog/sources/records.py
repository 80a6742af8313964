"""Structured sources and sinks: JSON lines, delimited tables, line labels, answer keys, tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how the title of a decoy begins.
DECOY = "RED HERRING"
_SPAN = "struct<file:string,line_start:long,line_end:long>"
_DEFECT = f"struct<id:string,title:string,proof_locations:array<{_SPAN}>,alternate_proof_locations:array<{_SPAN}>,anchor:string>"
_BROKEN = "broken_row_"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; lines that are no JSON object, or whose values don't fit the schema, are left out."""
    rows = spark.read.schema(f"{schema}, {_BROKEN} string").option("columnNameOfCorruptRecord", _BROKEN).option("recursiveFileLookup", True).json(path)
    return rows.where(F.col(_BROKEN).isNull()).drop(_BROKEN)


def read_table(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None) -> DataFrame:
    """A delimited table with a header, all columns as text: missing cells of short rows are null, further cells of long rows are left out.

    With ``schema``, its columns in their order; then a folder without files is a table without rows.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).csv(path)


def write_table(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """A delimited table with a header in each file."""
    rows.write.option("header", True).option("sep", sep).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, label of JSON lines {line, labels}: one row for each label of a line; ``path`` is the label file's."""
    rows = spark.read.schema(f"line long, labels array<string>, {_BROKEN} string").option("columnNameOfCorruptRecord", _BROKEN).option("recursiveFileLookup", True).json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "line", "labels", _BROKEN).where(F.col(_BROKEN).isNull() & F.col("line").isNotNull())
    return rows.select("path", F.col("line").alias("line_no"), F.explode("labels").alias("label"))


def _anchor(anchor: Column) -> Column:
    """``path:line`` as a span."""
    line = F.regexp_extract(anchor, r":(\d{1,12})$", 1).try_cast("long")
    return F.when(line.isNotNull(), F.struct(F.regexp_replace(anchor, r":\d{1,12}$", "").alias("file"), line.alias("line_start"), line.alias("line_end")))


def truth_spans(keys: DataFrame, key: str = "value") -> DataFrame:
    """dataset, defect_id, is_decoy, path, lo, hi of answer keys as JSON texts: one row for each place that proves a defect.

    ``defects`` is a list, or an object by id. A defect without places is proved at its anchor, ``path:line``; without either it has
    a row with nulls. A place without an end is one line. Keys that are no JSON give nothing.
    """
    raw = F.get_json_object(key, "$.defects")
    listed = F.from_json(raw, f"array<{_DEFECT}>")
    by_id = F.transform(F.map_entries(F.from_json(raw, f"map<string,{_DEFECT}>")), lambda e: e["value"].withField("id", F.coalesce(e["value"]["id"], e["key"])))
    d = keys.select(F.get_json_object(key, "$.dataset").alias("dataset"), F.explode(F.when(raw.startswith("["), listed).otherwise(by_id)).alias("d"))
    spans = F.concat(F.coalesce("d.proof_locations", F.array().cast(f"array<{_SPAN}>")), F.coalesce("d.alternate_proof_locations", F.array().cast(f"array<{_SPAN}>")))
    spans = F.when(F.size(spans) > 0, spans).otherwise(F.array_compact(F.array(_anchor(F.col("d.anchor")))))
    d = d.select("dataset", F.col("d.id").alias("defect_id"), F.coalesce(F.upper("d.title").startswith(DECOY), F.lit(False)).alias("is_decoy"), F.explode_outer(spans).alias("s"))
    return d.select("dataset", "defect_id", "is_decoy", F.col("s.file").alias("path"), F.col("s.line_start").alias("lo"), F.coalesce("s.line_end", "s.line_start").alias("hi"))


def read_truth(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``truth_spans`` of answer keys on disk: one to a line, or one to a file."""
    return truth_spans(spark.read.text(path, wholetext=whole_files, recursiveFileLookup=True))
