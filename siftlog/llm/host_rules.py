"""Quality rules at the level of hosts, with DataFrame functions only.

Each document is measured and judged by base rules; failures are summed by host (for documents: their source),
each host's rate is shrunk towards an empirical beta prior (moments of the hosts' rates), and a host whose shrunk
rate is above ``host_limit`` loses all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.shared import saved

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = r"[\x20\x09-\x0D]+"


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from ``words``: words inside 8-word windows found twice or more in the text.

    Windows are compared by 64-bit hashes, made by doubling (1, 2, 4, 8 words). Texts whose windows are all different
    stop there; else the windows are sorted by hash, neighbours with equal hashes give the repeated positions, and
    the words that these cover are summed in order of position.
    """
    span = 8

    def doubled(step: int) -> Column:
        return F.transform("g", lambda x, i: F.xxhash64(x, F.get(F.col("g"), i + step)))

    df = df.withColumn("g", F.transform("words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        df = df.withColumn("g", doubled(step))
    df = df.withColumn("g", F.slice("g", 1, F.greatest(F.col("n_words") - (span - 1), F.lit(0)).cast("int")))
    some = F.size(F.array_distinct("g")) < F.size("g")
    pairs = F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("s", F.when(some, F.array_sort(pairs)))
    twice = lambda e, i: (F.get(F.col("s"), i - 1)["h"] == e["h"]) | (F.get(F.col("s"), i + 1)["h"] == e["h"])
    marked = F.transform("s", lambda e, i: F.when(twice(e, i), e["i"]))
    df = df.withColumn("p", F.array_sort(F.filter(marked, lambda x: x.isNotNull())))
    steps = F.transform("p", lambda x, i: F.least(F.lit(span), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(span))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("g", "s", "p")


def measured(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts; a null text has none of them."""
    df = docs.select(*keep, F.coalesce(text, F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"words": F.filter(F.split("text", SPACES, -1), lambda w: w != ""), "lines": lines})
    df = df.select(
        *df.columns[: len(keep)],
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return _repeat_words(df).drop("words")


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 20, repeat_percent: int = 30, host_limit: float = 0.5) -> DataFrame:
    """Return doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate and kept.

    Base rules: fewer than ``min_words`` words, or more than ``repeat_percent`` percent repeated words. kept is false if
    the base rules fail or the host's shrunk failure rate exceeds ``host_limit``. A null host is a host of its own.
    Hosts all alike (no variance, or a single host) get the prior of one document at the common rate. Repeated rows
    are each counted and returned; a null text has no words and fails. An empty table gives an empty result.
    """
    base = measured(docs, docs[text_col], [docs[id_col].alias("doc_id"), docs[host_col].cast("string").alias("host")])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    base = saved(base.withColumn("base_failed", failed), "host-base")
    hosts = base.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failures"))
    rate = F.col("failures") / F.col("n")
    mean, spread = hosts.agg(F.sum("failures") / F.sum("n"), F.var_samp(rate)).first()
    mean = mean or 0.0
    strength = max(mean * (1 - mean) / spread - 1, 1.0) if spread else 1.0
    verdicts = hosts.select(F.col("host").alias("of"), ((F.col("failures") + mean * strength) / (F.col("n") + strength)).alias("host_rate"))
    verdicts = saved(verdicts, "host-verdicts")  # its size is known: few hosts are broadcast, and no document is shuffled by its host
    out = base.join(verdicts, base["host"].eqNullSafe(verdicts["of"])).drop("of")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= host_limit))
