"""A battery of observations on each host: what was seen, how often, by whom, where, and what is missing.

Every line is marked by the rules that it meets, in one pass; grouping sets then count the marks by file, source and
bucket at once. Counts of different days or corpora merge by addition, so a battery can be kept and carried on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.operators.trace import firsts
from siftlog.work import saved

MOST_SHOWN = 5


@dataclass(frozen=True)
class Rule:
    """``when`` marks a line of the files that ``within`` matches; ``source`` and ``bucket`` are told apart and counted.

    ``parts`` count further lines of any file beside it. ``opens`` and ``closes`` pair lines by ``key``: an opening is closed by a
    closing that comes before the key's next opening.
    """

    when: Column
    within: str = ""
    source: Column | None = None
    bucket: Column | None = None
    parts: dict[str, Column] = field(default_factory=dict)
    key: Column | None = None
    opens: Column | None = None
    closes: Column | None = None


def _marks(lines: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    none = lambda: F.lit(None).cast("string")

    def mark(name: str, part: str, when: Column, source: Column | None, bucket: Column | None) -> Column:
        text = lambda c: none() if c is None else F.nullif(c.cast("string"), F.lit(""))
        return F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(part).alias("part"), text(source).alias("source"), text(bucket).alias("bucket")))

    every = []
    for name, r in rules.items():
        every.append(mark(name, "", r.when & F.col("path").rlike(r.within), r.source, r.bucket))
        every += [mark(name, part, when, None, None) for part, when in r.parts.items()]
    return lines.select("host", "path", "sec", F.explode(F.array_compact(F.array(*every))).alias("m")).select("host", "path", "sec", "m.*")


def unclosed(lines: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """host, rule, opened, open of the rules that pair lines; keys are dealt over tasks, each key's openings and closings are ordered by time and line."""
    turns = [F.when(r.key.isNotNull() & (r.opens | r.closes), F.struct(F.lit(n).alias("rule"), r.key.cast("string").alias("key"), r.opens.alias("opens"))) for n, r in rules.items() if r.key is not None]
    if not turns:
        return lines.sparkSession.createDataFrame([], "host string, rule string, opened long, open long")
    rows = lines.select("host", "path", "sec", "line_no", F.explode(F.array_compact(F.array(*turns))).alias("t")).select("host", "path", "sec", "line_no", "t.*")
    after = F.lead("opens").over(W.partitionBy("host", "rule", "key").orderBy("sec", "path", "line_no"))
    rows = rows.withColumn("closed", F.coalesce(~after, F.lit(False)))
    return rows.where("opens").groupBy("host", "rule").agg(F.count("*").alias("opened"), F.count_if(~F.col("closed")).alias("open"))


def battery(lines: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """A row for each host and rule, also where nothing was seen: host, rule, n, files, sources, top, buckets, parts, first, last, hours, quiet_hours, share_bp, opened, open.

    ``lines`` has host, path, line_no, sec and what the rules read. files and parts are ``name=n`` by name, top and buckets the five most frequent sources
    and buckets, ties by name; sources counts all. hours lie between first and last, quiet_hours between last and the newest line of
    all hosts. share_bp is in hundredths of a percent of the lines of the host's files that the rule looks at.
    """
    marks = _marks(lines, rules)
    sets = [["host", "rule", "part", "path"], ["host", "rule", "part", "source"], ["host", "rule", "part", "bucket"]]
    # Which set a row is of: a null source or bucket is no grain, so those rows go.
    grains = marks.groupingSets([[F.col(c) for c in s] for s in sets], "host", "rule", "part", "path", "source", "bucket")
    grains = saved(grains.agg(F.grouping("path").alias("no_path"), F.grouping("source").alias("no_source"), F.grouping("bucket").alias("no_bucket"), F.count("*").alias("n"), F.min("sec").alias("first"), F.max("sec").alias("last")), "battery")
    by_path = grains.where("no_path = 0")
    main = by_path.where("part = ''")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "n"))), lambda x: F.concat(x[c], F.lit("="), x["n"])), " ")
    seen = main.groupBy("host", "rule").agg(F.sum("n").alias("n"), listed("path").alias("files"), F.min("first").alias("first"), F.max("last").alias("last"))
    parts = by_path.where("part <> ''").groupBy("host", "rule", "part").agg(F.sum("n").alias("n")).groupBy("host", "rule").agg(listed("part").alias("parts"))

    def top(grain: str) -> DataFrame:
        rows = grains.where(f"no_{grain} = 0 and {grain} is not null and part = ''").withColumn("less", -F.col("n"))
        few = firsts(rows.select("host", "rule", grain, "n", "less"), ["host", "rule"], ["less", grain], MOST_SHOWN)
        shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("less", grain, "n"))), lambda x: F.concat(x[grain], F.lit("="), x["n"])), " ")
        return few.groupBy("host", "rule").agg(shown.alias(grain)).join(rows.groupBy("host", "rule").agg(F.count("*").alias(f"{grain}s")), ["host", "rule"])

    held = saved(lines.groupBy("host", "path").agg(F.count("*").alias("lines"), F.max("sec").alias("newest")), "battery-files")  # a row a file
    names = lines.sparkSession.createDataFrame([(n, r.within) for n, r in rules.items()], "rule string, within string")
    looked = held.join(F.broadcast(names), F.expr("rlike(path, within)"), "inner").groupBy("host", "rule").agg(F.sum("lines").alias("looked"))
    newest = held.agg(F.max("newest").alias("newest"))
    every = held.select("host").distinct().join(F.broadcast(names.select("rule"))).join(F.broadcast(newest))  # a row a rule; one row
    out = every
    for table in (seen, parts, top("source"), top("bucket"), looked, unclosed(lines, rules)):
        out = out.join(table, ["host", "rule"], "left")
    number, text = (lambda c: F.coalesce(c, F.lit(0)).alias(c)), (lambda c, n: F.coalesce(c, F.lit("")).alias(n))
    return out.select(
        "host", "rule", number("n"), text("files", "files"), F.coalesce("sources", F.lit(0)).alias("sources"), text("source", "top"), text("bucket", "buckets"), text("parts", "parts"), "first", "last",
        F.floor((F.col("last") - F.col("first")) / 3600).alias("hours"), F.floor((F.col("newest") - F.col("last")) / 3600).alias("quiet_hours"),
        F.round(10000.0 * F.coalesce("n", F.lit(0)) / F.col("looked")).cast("long").alias("share_bp"), "opened", "open",
    )
