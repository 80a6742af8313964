"""Five stages from raw documents to token files; each reads what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm.decontaminate import decontaminated
from siftlog.llm.jaccard_join import jaccard_classes
from siftlog.llm.langid import fit, known_languages
from siftlog.llm.mixing import mixed
from siftlog.llm.queries import TOKENIZER
from siftlog.llm.shared import bound_batches, free_batches, saved, unused, work_path
from siftlog.llm.token_orc import token_index, write_token_orc

#: A document whose best language has less than this share is rejected.
LEAST_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters, or without a language that outweighs the rest, go.

    Null and empty texts go. Rows are judged alone, so repeated rows stay or go together; ties go to the first language by
    name. Rows without a language teach nothing; where no row has one, all go. An empty table stays empty. The table is written
    by the caller, so the session's Arrow batches stay small until the next stage.
    """
    bound_batches(spark)
    return known_languages(docs, fit(docs), LEAST_SCORE)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that near-duplicate links join, the one with the least id, null last; five-word shingles, similarity 0.8.

    Rows are told apart by a number of their own, so copies under one id or without an id are found and dropped, too, and
    different texts under one id stay. Ties of ids go to the first row. Texts without words, null ones included, link with
    nothing and stay. An empty table stays empty.
    """
    free_batches(spark)
    row, other = unused("stage_row", docs), unused("stage_other", docs)
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    classes = jaccard_classes(rows, id_col=row).select(F.col("doc_id").alias("row"), "component_id")
    classes = saved(classes.join(rows.select(F.col(row).alias("row"), rows["doc_id"].alias("id")), "row"), "pipeline-classes")
    first = classes.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    rest = classes.join(first.select("first.row"), "row", "left_anti")
    rest = saved(rest.select(F.col("row").alias(other)), "pipeline-rest")  # Spark knows its size: broadcast only if it is small
    return rows.join(rest, rows[row] == rest[other], "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 0.8 of the template windows of a benchmark item.

    Rows are judged by their texts, so rows without an id or under one id are each judged; repeated rows stay or go together.
    Null and empty texts stay. An empty table stays empty; without benchmark items all stay.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it, 0 to 3 times.

    A null source is a source of its own, the last. Repeated rows are taken one by one, all or none of those at which a
    budget ends. Texts without words, null ones included, count nothing. An empty table stays empty.
    """
    return mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns their index: doc_id, start, n_tokens, ids_crc32 of each row, read from the files.

    Null and empty texts hold the end id alone; null ids come first; repeated rows each have their place, equal ids go by
    text. An empty table has an empty index.
    """
    write_token_orc(docs, path := work_path(spark, "pipeline-orc"), public_tokenizers.path(TOKENIZER))
    return token_index(spark, path)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_class),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_to_weights),
    ("token_orc", write_tokens),
]

#: Tokenizing and n-gram language models can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again; the last one's index comes back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
