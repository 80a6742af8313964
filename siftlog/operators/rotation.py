"""Rotated files as the one stream that they were: gates on a family's slices, and their statistics merged in stream order.

A slice's statistics are kept so that those of neighbours can be merged without its records being read again: counts of templates and
of their hours add up, first places are those of the earlier slice, bounds and sums of numeric places join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.functions import masking as M
from siftlog.operators.timing import clock_readings
from siftlog.work import saved

#: A rotated file's name (base, number, perhaps gzip), and how many seconds neighbours may overlap.
ROTATED = r"^(.+?)\.\d{1,10}(?:\.gz)?$"
MOST_OVERLAP = 2
#: What keeps a family apart, in the order in which it is asked; the last is none of them.
GATES = ("empty", "undated", "framing", "shape", "overlap", "hour", "stitched")


def stream_of(path: Column) -> Column:
    """The folder and base name of a file, without a rotation's number."""
    name = F.element_at(F.split(path, "/"), -1)
    base = F.regexp_extract(name, ROTATED, 1)
    return F.concat(F.substr(path, F.lit(1), F.length(path) - F.length(name)), F.when(base == "", name).otherwise(base))


def readings(records: DataFrame) -> DataFrame:
    """The clock readings of ``framed`` records, by the lines that they begin at."""
    return clock_readings(records.select("path", F.col("line_start").alias("line_no"), "text"))


def slices(records: DataFrame, paths: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """path, stream, framing, records, shape, dated, lo, hi, hours of each file of ``framed`` records; ``at``: their ``readings``.

    ``paths`` adds files without a record. A file without a clock has no shape; ``dated`` holds if each reading has a date.
    """
    at = readings(records) if at is None else at
    clocks = at.groupBy("path").agg(F.first("shape").alias("shape"), F.bool_and("dated").alias("dated"), F.min("reading").alias("lo"), F.max("reading").alias("hi"), F.array_sort(F.collect_set("hour")).alias("hours"))
    held = records.groupBy("path").agg(F.first("framing").alias("framing"), F.count("*").alias("records"))
    if paths is not None:
        held = paths.select("path").distinct().join(held, "path", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return held.join(clocks, "path", "left").withColumn("stream", stream_of(F.col("path")))


def families(of: DataFrame) -> DataFrame:
    """stream, gate, slices, members, lo, hi of each family of two files or more: its members in order of their clocks, and the gate that decides.

    ``empty``: a slice has no records; ``undated``: no clock, or one without dates; ``framing`` and ``shape`` differ;
    ``overlap``: a slice begins more than two seconds before its neighbour ends; ``hour``: an hour of the day lies in two
    slices, so rates by hour couldn't tell them apart. The order is the clocks', never the numbers'.
    """
    before = W.partitionBy("stream").orderBy("lo", "path")  # a row a file
    rows = of.withColumn("back", F.lag("hi").over(before) - F.col("lo"))
    member = F.transform(F.array_sort(F.collect_list(F.struct("lo", "path"))), lambda m: m["path"])
    shared = F.sum(F.size("hours")) > F.size(F.array_distinct(F.flatten(F.collect_list("hours"))))
    found = rows.groupBy("stream").agg(
        F.count("*").alias("slices"), member.alias("members"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("records").alias("least"), F.bool_and(F.coalesce("dated", F.lit(False))).alias("dated"),
        F.count_distinct("framing").alias("framings"), F.count_distinct("shape").alias("shapes"), F.max("back").alias("back"), shared.alias("shared"),
    ).where("slices > 1")
    asked = (F.col("least") == 0, ~F.col("dated"), F.col("framings") > 1, F.col("shapes") > 1, F.col("back") > MOST_OVERLAP, F.col("shared"))
    gate = F.coalesce(*[F.when(c, name) for name, c in zip(GATES, asked)], F.lit(GATES[-1]))
    return found.select("stream", gate.alias("gate"), "slices", "members", "lo", "hi")


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    """Statistics of slices, by ``keys``: ``at`` orders the slices of a stream."""
    hours = F.aggregate(F.collect_list("hours"), F.array_repeat(F.lit(0).cast("long"), 24), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min_by(F.struct("path", "line"), F.struct("at", "path", "line")).alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), hours.alias("hours"))


def slice_templates(records: DataFrame, template: Column | None = None, at: DataFrame | None = None) -> DataFrame:
    """path, template, n, line (the first), lo, hi and hours (an array of 24 counts) of the records of each file; ``at``: their ``readings``."""
    at = (readings(records) if at is None else at).select("path", F.col("line_no").alias("line_start"), "hour", "reading")
    rows = records.select("path", "line_start", (M.template(F.col("text")) if template is None else template).alias("template")).join(at, ["path", "line_start"], "left")
    by_hour = F.array(*[F.count_if(F.col("hour") == h) for h in range(24)])
    return rows.groupBy("path", "template").agg(F.count("*").alias("n"), F.min("line_start").alias("line"), F.min("reading").alias("lo"), F.max("reading").alias("hi"), by_hour.alias("hours"))


def slice_places(records: DataFrame, template: Column | None = None) -> DataFrame:
    """path, template, place, n, least, most, total of the numbers at each of the first ten places of a template."""
    rows = records.select("path", (M.template(F.col("text")) if template is None else template).alias("template"), F.posexplode(M.slots(F.col("text"))).alias("place", "value"))
    return rows.groupBy("path", "template", "place").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("total"))


def _dealt(found: DataFrame) -> DataFrame:
    """path, stream, at: the stitched families' members and their places in the stream."""
    return found.where(F.col("gate") == GATES[-1]).select("stream", F.posexplode("members").alias("at", "path"))


def stitched(templates: DataFrame, found: DataFrame) -> DataFrame:
    """stream, template, n, path, line, lo, hi, hours of ``slice_templates``, slices of a stitched family merged; other files are streams of their own.

    path and line are where the template stands first in the stream: in its earliest slice that has it.
    """
    rows = templates.join(_dealt(found), "path", "left")
    rows = rows.withColumns({"stream": F.coalesce("stream", "path"), "at": F.coalesce("at", F.lit(0))})
    out = _merged(rows, "stream", "template")
    return out.select("stream", "template", "n", "first.path", "first.line", "lo", "hi", "hours")


def stitched_places(places: DataFrame, found: DataFrame) -> DataFrame:
    """stream, template, place, n, least, most, total of ``slice_places``, merged as ``stitched`` does."""
    rows = places.join(_dealt(found), "path", "left").withColumn("stream", F.coalesce("stream", "path"))
    return rows.groupBy("stream", "template", "place").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"))


def stitch(records: DataFrame, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(families, templates, numeric places) of ``framed`` records of rotated and other files."""
    at = readings(records)
    found = saved(families(slices(records, paths, at)), "families")  # a row a family
    return found, stitched(slice_templates(records, at=at), found), stitched_places(slice_places(records), found)
