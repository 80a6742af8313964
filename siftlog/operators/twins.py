"""The same events in different renderings of one host: which lines of other files say what a line says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.work import saved

#: Lines that hold one event each: stamp, offset, host and text; stamp, host and text.
ISO_LINE = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.\d+)?(Z|[+-]\d\d:?\d\d)[ \t](\S+)[ \t](.*)$"
BSD_LINE = r"^([A-Z][a-z]{2}\s+\d{1,2} \d\d:\d\d:\d\d) (\S+) (.*)$"


def rendered(text: Column) -> Column:
    """struct<base, at, host, body> of a line in one of three renderings, null for others.

    Dated lines and journal objects have seconds since 1970 (base ``epoch``); a stamp without a year has a base of its own
    and is kept as it is written.
    """
    iso = lambda g: F.regexp_extract(text, ISO_LINE, g)
    bsd = lambda g: F.regexp_extract(text, BSD_LINE, g)
    zone = F.when(iso(2) == "Z", 0).otherwise(F.when(iso(2).startswith("-"), -1).otherwise(1) * (F.substring(iso(2), 2, 2).cast("int") * 3600 + F.right(iso(2), F.lit(2)).cast("int") * 60))
    sec = F.unix_timestamp(F.try_to_timestamp(F.concat(iso(1), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))) - zone
    member = lambda n: F.get_json_object(text, f"$.{n}")
    name = F.coalesce(member("SYSLOG_IDENTIFIER"), member("_COMM"), F.lit(""))
    body = F.concat(name, F.when(member("_PID").isNotNull(), F.concat(F.lit("["), member("_PID"), F.lit("]"))).otherwise(""), F.lit(": "), member("MESSAGE"))
    row = lambda base, at, host, said: F.struct(F.lit(base).alias("base"), at.cast("string").alias("at"), host.alias("host"), said.alias("body"))
    journal = text.startswith("{") & member("__REALTIME_TIMESTAMP").isNotNull() & member("MESSAGE").isNotNull() & ~member("MESSAGE").startswith("[")
    return (
        F.when(text.rlike(ISO_LINE), row("epoch", sec, iso(3), iso(4)))
        .when(text.rlike(BSD_LINE), row("bsd", bsd(1), bsd(2), bsd(3)))
        .when(journal, row("epoch", F.floor(member("__REALTIME_TIMESTAMP").try_cast("long") / 1_000_000), member("_HOSTNAME"), body))
    )


def timebases(keys: DataFrame) -> DataFrame:
    """path, base of the files half of whose lines that aren't blank are in a rendering, all of one base; others are left out."""
    n = keys.groupBy("path").agg(F.count("*").alias("seen"), F.count("k").alias("read"), F.count_distinct("k.base").alias("bases"), F.max("k.base").alias("base"))
    return n.where((F.col("bases") == 1) & (2 * F.col("read") >= F.col("seen"))).select("path", "base")


def rendering_twins(lines: DataFrame, spans: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, line_no, twin_path, twin_line; path, twin_path, reason, keys) of files below one first folder.

    Two lines are twins if base, second, host and text are equal, each file has that key equally often, and they have
    the same rank among the key's lines. Pairs of files that aren't compared are told with the reason ``timebase``; ``multiplicity``
    counts the keys that two files share unequally often. ``spans`` (path, lo, hi) keeps twins of the lines that they cover,
    and the refused pairs of their files. Lines are dealt by their key, so no pair of files meets in one task.
    """
    keys = lines.where(F.trim("text") != "").select("path", "line_no", rendered(F.col("text")).alias("k"))
    keys = saved(keys.withColumn("home", F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1))), "renderings")
    bases = saved(timebases(keys), "timebases")  # a row a file
    known = keys.where("k is not null and home is not null").join(bases, "path").where("k.base = base").select("home", "path", "line_no", "base", "k.at", "k.host", "k.body")
    what = ["home", "base", "at", "host", "body"]
    ranked = known.withColumn("k", F.row_number().over(W.partitionBy("path", *what).orderBy("line_no")))
    counts = saved(known.groupBy("path", *what).agg(F.count("*").alias("c")), "rendering-counts")
    same = lambda a, b, more=(): [a[c].eqNullSafe(b[c]) for c in what] + [a[c] == b[c] for c in more]
    ranked = ranked.join(counts, [*same(ranked, counts), ranked["path"] == counts["path"]]).select(*[ranked[c] for c in ranked.columns], "c")
    other = ranked.toDF(*[f"o_{c}" for c in ranked.columns])
    meet = [ranked[c].eqNullSafe(other[f"o_{c}"]) for c in what] + [ranked["k"] == other["o_k"], ranked["c"] == other["o_c"], ranked["path"] != other["o_path"]]
    twins = ranked.join(other, meet).select("path", "line_no", F.col("o_path").alias("twin_path"), F.col("o_line_no").alias("twin_line"))
    files = keys.where("home is not null").select("home", "path").distinct().join(bases, "path", "left")
    o = files.select(*[F.col(c).alias(f"o_{c}") for c in ("home", "path", "base")])
    pairs = files.join(o, (F.col("home") == F.col("o_home")) & (F.col("path") != F.col("o_path")))
    apart = pairs.where(F.col("base").isNull() | F.col("o_base").isNull() | (F.col("base") != F.col("o_base"))).select("path", F.col("o_path").alias("twin_path"), F.lit("timebase").alias("reason"), F.lit(None).cast("long").alias("keys"))
    oc = counts.toDF(*[f"o_{c}" for c in counts.columns])
    uneven = counts.join(oc, [counts[c].eqNullSafe(oc[f"o_{c}"]) for c in what] + [counts["path"] != oc["o_path"], counts["c"] != oc["o_c"]])
    uneven = uneven.groupBy("path", F.col("o_path").alias("twin_path")).agg(F.lit("multiplicity").alias("reason"), F.count("*").alias("keys"))
    refused = apart.unionByName(uneven)
    if spans is not None:
        bucket = lambda c: F.floor(c / 64)
        covered = spans.select("path", "lo", "hi", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))).alias("b"))
        twins = twins.withColumn("b", bucket(F.col("line_no"))).join(covered.withColumnRenamed("path", "s_path").withColumnRenamed("b", "s_b"), (F.col("path") == F.col("s_path")) & (F.col("b") == F.col("s_b")) & F.col("line_no").between(F.col("lo"), F.col("hi")), "left_semi").drop("b")
        refused = refused.join(spans.select("path").distinct(), "path", "left_semi")
    return twins, refused
