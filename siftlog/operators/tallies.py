"""Grouped counts, profiles, scores and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.functions.clock import raw_stamp
from siftlog.functions.fields import severity_words, vocabulary
from siftlog.functions.masking import shape


def file_profile(lines: DataFrame, words: int = 12) -> DataFrame:
    """path, bytes, lines, first_stamp, last_stamp (as written), shapes (distinct), severities (word=n in order) and the ``words`` most frequent capital words."""
    text, stamp = F.col("text"), raw_stamp(F.col("text"))
    own = lines.groupBy("path").agg(F.sum(F.octet_length("text") + 1).cast("long").alias("bytes"), F.count("*").alias("lines"), F.min_by(stamp, F.when(stamp.isNotNull(), F.col("line_no"))).alias("first_stamp"), F.max_by(stamp, F.when(stamp.isNotNull(), F.col("line_no"))).alias("last_stamp"))
    shapes = lines.groupBy("path", shape(text).alias("shape")).agg(F.lit(1)).groupBy("path").agg(F.count("*").alias("shapes"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: F.concat(x["word"], F.lit("="), x["n"])), ",")

    def counted(found: Column) -> DataFrame:
        return lines.select("path", F.explode(found).alias("word")).groupBy("path", "word").agg(F.count("*").alias("n"))

    severities = counted(severity_words(text)).groupBy("path").agg(listed(F.struct("word", "n")).alias("severities"))
    top = counted(vocabulary(text)).withColumn("r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), "word"))).where(F.col("r") <= words)
    top = top.groupBy("path").agg(listed(F.struct("r", "word", "n")).alias("vocabulary"))
    out = own.join(shapes, "path", "left").join(severities, "path", "left").join(top, "path", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("severities", "vocabulary")})


def top_and_rare(counts: DataFrame, keys: list[str], value: str, top: int, rare: int) -> DataFrame:
    """The ``top`` most frequent values of each key and, of the rest, the ``rare`` least frequent; kind says which."""
    by = W.partitionBy(*keys)
    c = counts.withColumn("t", F.row_number().over(by.orderBy(F.desc("n"), value)))
    rest = c.where(F.col("t") > top).withColumn("r", F.row_number().over(by.orderBy("n", value))).where(F.col("r") <= rare)
    return c.where(F.col("t") <= top).select(*keys, value, "n", F.lit("top").alias("kind")).unionByName(rest.select(*keys, value, "n", F.lit("rare").alias("kind")))


def seen_under(df: DataFrame, keys: list[str], kind: str, least: int = 2) -> DataFrame:
    """keys, kinds: pairs seen under ``least`` kinds of event or more, comma-separated in order."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), F.count_distinct(kind).alias("n")).where(F.col("n") >= least)


def fan_out(df: DataFrame, src: str, dst: str, least: int = 50) -> DataFrame:
    """src, n: sources with ``least`` distinct destinations or more."""
    return df.groupBy(src).agg(F.count_distinct(dst).alias("n")).where(F.col("n") >= least)


def line_runs(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """keys, lo, hi: maximal runs of consecutive line numbers."""
    d = lines.select(*keys, line).distinct()
    d = d.withColumn("g", F.col(line) - F.row_number().over(W.partitionBy(*keys).orderBy(line)))
    return d.groupBy(*keys, "g").agg(F.min(line).alias("lo"), F.max(line).alias("hi")).drop("g")


def card_hits(lines: DataFrame, cards: list[tuple[str, str]], keep: int = 3) -> DataFrame:
    """card, n, first: hits of each (name, pattern) and the first ``keep`` addresses, in one pass over the lines."""
    hit = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in cards]), lambda c: c.isNotNull())
    rows = lines.select("path", "line_no", F.explode(hit).alias("card"))
    n = rows.groupBy("card").agg(F.count("*").alias("n"))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("card").orderBy("path", "line_no"))).where(F.col("r") <= keep)
    shown = first.groupBy("card").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line_no"))), lambda p: F.concat(p["path"], F.lit(":"), p["line_no"])), " ").alias("first"))
    return n.join(shown, "card")


def baseline_ratio(df: DataFrame, arm: str, value: str, base: str) -> DataFrame:
    """arm, mean, ratio to the mean of the baseline arm."""
    means = df.groupBy(arm).agg((F.sum(value) / F.count(value)).alias("m"))
    own = F.max(F.when(F.col(arm) == base, F.col("m"))).over(W.partitionBy())  # one row for each arm
    return means.select(arm, F.round("m", 6).alias("mean"), F.round(F.col("m") / own, 6).alias("ratio"))


def spend_rollup(df: DataFrame, by: str, reason: str, amount: str, wasted: Column) -> DataFrame:
    """by, reason, spent, burned, and their sums for each ``by`` and over all (nulls)."""
    out = df.rollup(by, reason).agg(F.sum(amount).alias("spent"), F.sum(F.when(wasted, F.col(amount)).otherwise(0)).alias("burned"))
    return out.withColumn("wasted_pct", F.round(100 * F.col("burned") / F.col("spent"), 4))


def strongest(df: DataFrame, key: str, outcome: str, ranks: dict[str, int]) -> DataFrame:
    """key, outcome: the outcome of the highest rank."""
    rank = F.coalesce(*[F.when(F.col(outcome) == k, F.lit(v)) for k, v in ranks.items()], F.lit(-1))
    return df.groupBy(key).agg(F.max_by(outcome, F.struct(rank, outcome)).alias(outcome))


def host_depth(paths: DataFrame, most: int = 3) -> DataFrame:
    """depth, roots: the shallowest depth, up to ``most``, at which one set of children repeats below two roots and half of all."""
    out = None
    for depth in range(1, most + 1):
        parts = F.split("path", "/")
        p = paths.where(F.size(parts) > depth).select(F.array_join(F.slice(parts, 1, depth), "/").alias("root"), F.get(parts, F.lit(depth)).alias("child"))
        sets = p.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("child")), "\n").alias("sig"))
        n = sets.groupBy("sig").agg(F.count("*").alias("same")).select(F.lit(depth).alias("depth"), "same", F.sum("same").over(W.partitionBy()).alias("roots"))
        ok = n.where((F.col("same") >= 2) & (2 * F.col("same") >= F.col("roots"))).select("depth", "roots").distinct()
        out = ok if out is None else out.unionByName(ok)
    return out.orderBy("depth").limit(1)


def truth_phases(labels: DataFrame) -> DataFrame:
    """path, phase, lo, hi of (path, line_no, label): runs of labelled lines of each phase; a phase whose lines another, larger one of the file holds goes."""
    labels = labels.distinct()
    sizes = labels.groupBy("path", "label").agg(F.count("*").alias("n"))
    other = labels.withColumnRenamed("label", "other")
    both = labels.join(other, ["path", "line_no"]).where("label <> other").groupBy("path", "label", "other").agg(F.count("*").alias("shared"))
    both = both.join(sizes, ["path", "label"]).join(sizes.select("path", F.col("label").alias("other"), F.col("n").alias("other_n")), ["path", "other"])
    inside = both.where((F.col("shared") == F.col("n")) & ((F.col("n") < F.col("other_n")) | (F.col("label") > F.col("other"))))
    kept = labels.join(inside.select("path", "label").distinct(), ["path", "label"], "left_anti")
    return line_runs(kept, ["path", "label"], "line_no").withColumnRenamed("label", "phase")
