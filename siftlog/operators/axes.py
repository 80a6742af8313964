"""Anomaly axes over records: rarity, category, outcome, rate, newcomers, excursions and the floor.

All counts are aggregated before any window runs, so windows see one row for each group and not for each record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.operators.scan import along


def floor_quantiles(df: DataFrame, keys: list[str], value: str, **quantiles: float) -> DataFrame:
    """keys, n and for each name the element ``min(n - 1, floor(q * n))`` of the sorted values.

    Equal values are counted first; a running sum over distinct values then finds the ranks, so no group is held whole.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumns({"upto": upto, "n": F.sum("c").over(W.partitionBy(*keys))})
    rank = lambda q: F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))
    return counts.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > rank(q), F.col(value))).alias(name) for name, q in quantiles.items()])


def template_counts(records: DataFrame) -> DataFrame:
    """path, template, n, first_line, exemplar of records with path, line_no, text, template."""
    return records.groupBy("path", "template").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.min_by("text", "line_no").alias("exemplar"))


def axis_rarity(counts: DataFrame, most: int = 5) -> DataFrame:
    """Templates of ``most`` records or fewer, numbered rarest first in each file."""
    order = W.partitionBy("path").orderBy("n", "first_line")
    return counts.where(F.col("n") <= most).withColumn("rank", F.row_number().over(order).cast("long"))


def level_axes(bag: DataFrame, sizes: DataFrame, keep: int = 3) -> DataFrame:
    """path, axis, rank: fields present in 60 % of the records, with 2 to 40 values, one of them on 25 %, that look like words."""
    values = bag.groupBy("path", "axis", "value").agg(F.count("*").alias("c"))
    wordish = F.sum(F.when(~F.col("value").rlike("^[0-9]") & (F.length("value") <= 12), F.col("c")).otherwise(0))
    axes = values.groupBy("path", "axis").agg(F.sum("c").alias("total"), F.count("*").alias("card"), F.max("c").alias("top"), wordish.alias("w")).join(sizes, "path")
    ok = F.col("card").between(2, 40) & (4 * F.col("top") >= F.col("total")) & (10 * F.col("total") >= 6 * F.col("n"))
    score = F.round(F.col("total") / F.col("n") * (1 - (F.col("card") - 2) / 40) * (0.25 + 0.75 * F.col("w") / F.col("total")), 9)
    best = axes.where(ok).withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "axis")).cast("long"))
    return best.where(F.col("rank") <= keep).select("path", "axis", "rank")


def axis_category(counts: DataFrame, most: int = 200, share: float = 0.01) -> DataFrame:
    """Of (path, value, n): values of at most ``most`` records and less than ``share`` of their file."""
    out = counts.withColumn("all", F.sum("n").over(W.partitionBy("path")))
    return out.where((F.col("n") <= most) & (F.col("n") < share * F.col("all"))).drop("all")


def status_axis(bag: DataFrame, sizes: DataFrame) -> DataFrame:
    """path, axis: the field of three-digit codes 100 to 599 on 90 % of the records, 16 codes at most; several classes go first."""
    code = F.col("value").rlike("^[1-5][0-9]{2}$")
    values = bag.groupBy("path", "axis", "value").agg(F.count("*").alias("c"))
    axes = values.groupBy("path", "axis").agg(F.sum("c").alias("total"), F.sum(F.when(code, F.col("c")).otherwise(0)).alias("coded"), F.count_if(code).alias("card"), F.max(F.when(code, F.col("c"))).alias("top"), F.count_distinct(F.when(code, F.substring("value", 1, 1))).alias("classes")).join(sizes, "path")
    ok = (F.col("total") >= 20) & (10 * F.col("total") >= 9 * F.col("n")) & F.col("card").between(1, 16) & (10 * F.col("coded") >= 9 * F.col("total")) & (4 * F.col("top") >= F.col("coded"))
    score = F.struct((F.col("classes") > 1).cast("int"), "coded", -F.col("card"), "axis")
    return axes.where(ok).groupBy("path").agg(F.max_by("axis", score).alias("axis"))


def outcome_series(df: DataFrame, keys: list[str], value: str, seconds: str, bucket: int = 600) -> DataFrame:
    """keys, value, total, hot (buckets with any), buckets, peak, peak_at, quiet (upper median) over a dense series with zeros.

    Empty buckets are never materialised: the median of the dense series follows from the counts and their number.
    """
    b = df.withColumn("b", F.floor(F.col(seconds) / bucket))
    span = b.groupBy(*keys).agg((F.max("b") - F.min("b") + 1).alias("buckets"))
    per = b.groupBy(*keys, value, "b").agg(F.count("*").alias("c"))
    total = per.groupBy(*keys, value).agg(F.sum("c").alias("total"), F.count("*").alias("hot"), F.max("c").alias("peak"), F.min_by("b", F.struct(-F.col("c"), "b")).alias("peak_b"))
    of = W.partitionBy(*keys, value)
    held = per.join(span, keys).withColumns({"upto": F.row_number().over(of.orderBy("c")), "h": F.count("*").over(of)})
    at = F.floor(F.col("buckets") / 2) - (F.col("buckets") - F.col("h"))
    quiet = held.groupBy(*keys, value).agg(F.coalesce(F.min(F.when(F.col("upto") > at, F.when(at >= 0, F.col("c")))), F.lit(0)).alias("quiet"))
    out = total.join(quiet, [*keys, value]).join(span, keys)
    return out.select(*keys, value, "total", "hot", F.col("buckets").cast("long"), "peak", (F.col("peak_b") * bucket).cast("long").alias("peak_at"), F.col("quiet").cast("long"))


def axis_outcome(series: DataFrame, keys: list[str], value: str, least_peak: int = 5, factor: float = 3) -> DataFrame:
    """Classes other than the dominant one whose peak is ``least_peak`` or more and ``factor`` times the quiet level."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("total"), value))
    out = series.withColumn("r", first).where((F.col("r") > 1) & (F.col("peak") >= least_peak) & (F.col("peak") >= factor * F.greatest("quiet", F.lit(1))))
    return out.drop("r")


def metric_axes(bag: DataFrame, sizes: DataFrame, keep: int = 2, distinct: int = 20) -> DataFrame:
    """path, axis, rank: fields on 60 % of the records with many values, 95 % numbers, none on 25 %; levels before identifiers."""
    values = bag.groupBy("path", "axis", "value").agg(F.count("*").alias("c"))
    number = F.sum(F.when(F.col("value").rlike(r"^-?\d+(\.\d+)?$"), F.col("c")).otherwise(0))
    axes = values.groupBy("path", "axis").agg(F.sum("c").alias("total"), F.count("*").alias("card"), F.max("c").alias("top"), number.alias("num")).join(sizes, "path")
    ok = (10 * F.col("total") >= 6 * F.col("n")) & (F.col("card") >= distinct) & (100 * F.col("num") >= 95 * F.col("total")) & (4 * F.col("top") < F.col("total"))
    order = W.partitionBy("path").orderBy(F.desc("total"), F.round(F.col("card") / F.col("total"), 9), "axis")
    return axes.where(ok).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep).select("path", "axis", "rank")


def slot_verdict(slots: DataFrame, least: int = 40) -> DataFrame:
    """path, slot, n, verdict of (path, line_no, slot, value, glued): why a numeric place measures nothing, or ``metric``."""
    s = along(slots, before={"prev": F.struct("value")}, by=("path", "slot"))
    v = s.groupBy("path", "slot", "value").agg(F.count("*").alias("n"), F.max("glued").alias("glued"), F.min("line_no").alias("came"), F.count_if(F.col("value") > F.col("prev.value")).alias("up"))
    same = F.coalesce(F.min_by(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0), "came"), F.lit(0))  # as the first value
    a = v.groupBy("path", "slot").agg(F.sum("n").alias("n"), F.max("glued").alias("glued"), F.count("value").alias("d"), same.alias("f"), F.sum("up").alias("up"))
    why = F.when(F.col("glued"), "name").when(F.col("n") < least, "few").when(F.col("d") < 3, "flag").when(100 * F.col("f") >= 99 * F.col("n"), "constant").when((F.col("d") > 64) & (100 * F.col("up") >= 98 * (F.col("n") - 1)), "counter")
    return a.select("path", "slot", "n", why.otherwise("metric").alias("verdict"))


def comparable_hours(hours: DataFrame, least: int = 100) -> DataFrame:
    """path, h0, h1: first and last hour with at least ``least`` records and a quarter of the upper median hour."""
    mid = floor_quantiles(hours.withColumnRenamed("n", "held"), ["path"], "held", mid=0.5).select("path", "mid")
    ok = hours.join(mid, "path").where((F.col("n") >= least) & (4 * F.col("n") >= F.col("mid")))
    return ok.groupBy("path").agg(F.min("hour").alias("h0"), F.max("hour").alias("h1"))


def _deviation(ratio: Column) -> Column:
    return F.coalesce(F.when(ratio > 0, F.greatest(ratio, 1 / ratio)), F.lit(0.0))


def axis_rate(counts: DataFrame, hours: DataFrame, levels: DataFrame, low: float = 1 / 3, high: float = 3.0, least: int = 5) -> DataFrame:
    """path, grp, n0, n1, ratio, slot, slot_ratio, factor, driver, moved: what changed from the first comparable hour to the last.

    ``counts``: path, grp, hour, n; ``hours``: path, h0, h1; ``levels``: path, grp, hour, slot, level (a high percentile of a
    numeric place). ratio is that of a group's shares, null below ``least`` records in either hour; slot is the place whose level
    changed most. A group has moved if either ratio is ``low`` or less, or ``high`` or more; driver says which one is farther off.
    """
    all_ = counts.groupBy("path", "hour").agg(F.sum("n").alias("all"))
    ends = (F.col("hour") == F.col("h0")) | (F.col("hour") == F.col("h1"))
    hours = hours.where("h0 <> h1")
    c = counts.join(hours, "path").where(ends).join(all_, ["path", "hour"])
    at = lambda v, h: F.sum(F.when(F.col("hour") == F.col(h), F.col(v)))
    p = c.groupBy("path", "grp").agg(F.coalesce(at("n", "h0"), F.lit(0)).alias("n0"), F.coalesce(at("n", "h1"), F.lit(0)).alias("n1"), at("all", "h0").alias("a0"), at("all", "h1").alias("a1"))
    p = p.withColumn("ratio", F.when((F.col("n0") >= least) & (F.col("n1") >= least), F.round((F.col("n1") / F.col("a1")) / (F.col("n0") / F.col("a0")), 6)))
    v = levels.join(hours, "path").where(ends).groupBy("path", "grp", "slot").agg(at("level", "h0").alias("v0"), at("level", "h1").alias("v1")).where("v0 <> 0 and v1 is not null")
    v = v.withColumn("slot_ratio", F.round(F.col("v1") / F.col("v0"), 6))
    v = v.groupBy("path", "grp").agg(F.min(F.struct((-F.abs(F.col("slot_ratio") - 1)).alias("off"), "slot", "slot_ratio")).alias("v")).select("path", "grp", "v.slot", "v.slot_ratio")
    r = p.join(v, ["path", "grp"], "left").where("ratio is not null or slot_ratio is not null")
    beyond = lambda x: F.coalesce((F.col(x) >= high) | (F.col(x) <= low), F.lit(False))
    share, level = _deviation(F.col("ratio")), _deviation(F.col("slot_ratio"))
    return r.select("path", "grp", "n0", "n1", "ratio", "slot", "slot_ratio", F.round(F.greatest(share, level), 6).alias("factor"), F.when(share >= level, "share").otherwise("slot").alias("driver"), (beyond("ratio") | beyond("slot_ratio")).alias("moved"))


def axis_background(rates: DataFrame, least: int = 800) -> DataFrame:
    """Groups of ``least`` records in both hours together whose share stays within a fifth down and a quarter up."""
    return rates.where((F.col("n0") + F.col("n1") >= least) & F.col("ratio").between(0.8, 1.25)).select("path", "grp", "n0", "n1", "ratio")


def axis_excursion(df: DataFrame, key: str, hour: str, value: str, factor: float = 3.0, back: float = 1.5) -> DataFrame:
    """key, hour, level, typical: an interior hour whose upper median is ``factor`` times the typical hour and that returns to ``back`` times on both sides."""
    levels = floor_quantiles(df, [key, hour], value, level=0.5).select(key, hour, "level")
    typical = floor_quantiles(levels, [key], "level", typical=0.5).where("n >= 4").select(key, "typical")
    order = W.partitionBy(key).orderBy(hour)
    low = (F.col("level") <= back * F.col("typical")).cast("int")
    l = levels.join(typical, key).withColumn("low", low)  # noqa: E741
    l = l.withColumns({"before": F.max("low").over(order.rowsBetween(W.unboundedPreceding, -1)), "after": F.max("low").over(order.rowsBetween(1, W.unboundedFollowing))})  # noqa: E741
    return l.where((F.col("level") >= factor * F.col("typical")) & (F.col("before") == 1) & (F.col("after") == 1)).select(key, hour, "level", "typical")


def axis_newcomer(df: DataFrame, key: str, order: str, actor: str, most_actors: int = 64, least: int = 60, most_new: int = 3) -> DataFrame:
    """key, actor, first, n: actors first seen after half of a file's records, latest first; files with many of them have none."""
    seen = along(df, sums={"at": F.lit(1)}, by=(key,), order=order)
    size = seen.groupBy(key).agg(F.count("*").alias("all"), F.count_distinct(actor).alias("actors"))
    firsts = seen.groupBy(key, actor).agg(F.min("at").cast("long").alias("first"), F.count("*").alias("n")).join(size, key)
    late = firsts.where((F.col("all") >= least) & (F.col("actors") <= most_actors) & (2 * F.col("first") > F.col("all")))
    late = late.withColumn("new", F.count("*").over(W.partitionBy(key))).where(F.col("new") <= most_new)
    return late.select(key, actor, "first", "n")


def axis_floor(records: DataFrame, most: int = 6) -> DataFrame:
    """path, line_no, why: what every file shows: its first and last record, a record of its rarest values and of its fullest hour.

    ``records``: path, line_no, value, hour. The stronger reason keeps a shared record.
    """
    ends = records.groupBy("path").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"))
    first = ends.select("path", F.col("a").alias("line_no"), F.lit("first").alias("why"), F.lit(3).alias("strength"))
    last = ends.select("path", F.col("b").alias("line_no"), F.lit("last").alias("why"), F.lit(4).alias("strength"))
    values = records.groupBy("path", "value").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    rare = values.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy("n", "line_no"))).where("r <= 2").select("path", "line_no", F.lit("rare").alias("why"), F.lit(1).alias("strength"))
    hours = records.groupBy("path", "hour").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    full = hours.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), "hour"))).where("r = 1").select("path", "line_no", F.lit("fullest").alias("why"), F.lit(2).alias("strength"))
    return merge_axes(rare.unionByName(full).unionByName(first).unionByName(last), most)


def floor_rows(records: DataFrame, levels: DataFrame, most: int = 6, most_codes: int = 3, most_levels: int = 2) -> DataFrame:
    """path, line_no, why of what a file shows when no axis ranks its records, ``most`` records at most, the strongest reason of each.

    ``records``: path, line_no, template, code (null without one), hour; ``levels``: path, line_no, axis, value. In order: ``code``, the first
    records of the rarest codes but the file's most frequent one; ``level``, for the first axes by name with two values or more, where the
    template that is most frequent with the axis's rarest value first stands; ``burst``, the first record of the fullest hour; the ``first`` record
    and the ``last``. Of equally frequent codes and templates the one that came first counts as more frequent.
    """
    pick = lambda rows, order, keep, keys=("path",): rows.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= keep)
    claim = lambda rows, why, strength: rows.select("path", "line_no", F.lit(why).alias("why"), (strength if isinstance(strength, Column) else F.lit(strength)).cast("int").alias("strength"))
    codes = records.where("code is not null").groupBy("path", "code").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    codes = codes.withColumn("place", F.row_number().over(W.partitionBy("path").orderBy(F.desc("n"), "line_no"))).where("place > 1")
    code = claim(pick(codes, ["n", "code"], most_codes), "code", 10 + F.col("r"))
    values = levels.groupBy("path", "axis", "value").agg(F.count("*").alias("n"))
    values = values.withColumn("card", F.count("*").over(W.partitionBy("path", "axis"))).where("card > 1")
    rarest = pick(pick(values, ["n", "value"], 1, ("path", "axis")).drop("r"), ["axis"], most_levels).select("path", "axis", "value", F.col("r").alias("place"))
    templates = records.groupBy("path", "template").agg(F.min("line_no").alias("line_no"))
    with_value = levels.join(rarest, ["path", "axis", "value"]).join(records.select("path", "line_no", "template"), ["path", "line_no"])
    with_value = with_value.groupBy("path", "axis", "place", "template").agg(F.count("*").alias("n"), F.min("line_no").alias("came"))
    level = claim(pick(with_value, [F.desc("n"), "came"], 1, ("path", "axis")).join(templates, ["path", "template"]), "level", 20 + F.col("place"))
    hours = records.where("hour is not null").groupBy("path", "hour").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    burst = claim(pick(hours, [F.desc("n"), "hour"], 1), "burst", 30)
    ends = records.groupBy("path").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"))
    first, last = claim(ends.select("path", F.col("a").alias("line_no")), "first", 40), claim(ends.select("path", F.col("b").alias("line_no")), "last", 41)
    return merge_axes(code.unionByName(level).unionByName(burst).unionByName(first).unionByName(last), most)


def merge_axes(rows: DataFrame, most: int | None = None) -> DataFrame:
    """path, line_no, why: the strongest (least ``strength``) claim of each record; ``most`` records of a file."""
    one = rows.withColumn("r", F.row_number().over(W.partitionBy("path", "line_no").orderBy("strength", "why"))).where("r = 1")
    if most is not None:
        one = one.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy("strength", "line_no"))).where(F.col("r") <= most)
    return one.select("path", "line_no", "why")


def rare_field(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of (keys, value, n): rare values of a field with 2 to 50: at most max(2, 0.5 %), or 15 % of a field with 8 values or fewer."""
    by = W.partitionBy(*keys)
    v = values.withColumns({"all": F.sum("n").over(by), "card": F.count("*").over(by)})
    rare = (F.col("n") <= F.greatest(F.lit(2.0), 0.005 * F.col("all"))) | ((F.col("card") <= 8) & (100 * F.col("n") <= 15 * F.col("all")))
    return v.where(F.col("card").between(2, 50) & rare).select(*keys, value, "n")


def state_change(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, value, first, n: values of a field with 2 to 8 that first appear after 30 % of the records and stay below half."""
    seen = along(df, sums={"at": F.lit(1)}, by=(key,), order=order)
    v = seen.groupBy(key, value).agg(F.min("at").cast("long").alias("first"), F.count("*").alias("n"))
    by = W.partitionBy(key)
    v = v.withColumns({"all": F.sum("n").over(by), "card": F.count("*").over(by)})
    return v.where(F.col("card").between(2, 8) & (10 * F.col("first") > 3 * F.col("all")) & (2 * F.col("n") < F.col("all"))).select(key, value, "first", "n")


def numeric_outlier(df: DataFrame, columns: list[str], factor: int = 10, least: int = 8) -> DataFrame:
    """col, n, top, mid: numeric columns whose largest value is ``factor`` times the upper median or more."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in columns])).alias("u")).select("u.*")
    top = long.groupBy("col").agg(F.max("v").alias("top"))
    out = floor_quantiles(long, ["col"], "v", mid=0.5).join(top, "col")
    return out.where((F.col("n") >= least) & (F.col("top") >= factor * F.col("mid"))).select("col", "n", "top", "mid")


def onset(series: DataFrame, keys: list[str], hour: str, level: str, factor: float = 3.0) -> DataFrame:
    """keys, opening, onset: the first hour whose level leaves the opening one by ``factor`` either way; null if none does."""
    opening = F.first(level).over(W.partitionBy(*keys).orderBy(hour))
    s = series.withColumn("opening", opening)
    left = (F.col(level) >= factor * F.col("opening")) | (factor * F.col(level) <= F.col("opening"))
    return s.groupBy(*keys).agg(F.max("opening").alias("opening"), F.min(F.when(left, F.col(hour))).alias("onset"))

