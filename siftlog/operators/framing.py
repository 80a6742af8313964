"""Records: which physical lines form one, by five framings.

What a line needs of the lines before it comes from ``along``, so a file's lines are spread over tasks; every framing
gives path, line_start, line_end, text. ``framed`` deals each file of a mixed corpus to its framing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.functions.clock import TIME_SHAPES, order_key
from siftlog.operators.scan import along
from siftlog.operators.timing import clock_residue
from siftlog.work import saved

#: Line shapes.
CRI = r"^\S+Z (stdout|stderr) [PF] "
CRI_TAG = r"^\S+Z (?:stdout|stderr) ([PF]) "
BLOCK_KEY = r"^[A-Za-z_][A-Za-z0-9_.-]*[:=]"
LEADING_STAMP = (
    r"^\W{0,3}(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}|[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}"
    r"|\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}|\d{8}\|\d{6}\.\d{3}\||\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}|\{\s*\"?[A-Za-z_])"
)
REQUEST_LINE = r'^\S+ \S+ \S+ \[\d{2}/[A-Za-z]{3}/\d{4}(?::\d{2}){3} [-+]\d{4}\] "[^"]*" \d{3} (?:\d+|-)'


def frame_choice(lines: DataFrame, probe: int = 4000) -> DataFrame:
    """path, framing from shares over a file's first ``probe`` lines: cri 0.90; blank 0.02 and key 0.50: block; leading stamp 0.55: anchor; else line."""
    some = lines.where(F.col("line_no") <= probe)
    full = F.trim("text") != ""
    rate = lambda c: F.count_if(full & c) / F.greatest(F.count_if(full), F.lit(1))
    shares = some.groupBy("path").agg(rate(F.col("text").rlike(CRI)).alias("cri"), (F.count_if(~full) / F.count("*")).alias("blank"), rate(F.col("text").rlike(BLOCK_KEY)).alias("key"), rate(F.col("text").rlike(LEADING_STAMP)).alias("lead"), rate(F.col("text").rlike(REQUEST_LINE)).alias("request"))
    pick = F.when(F.col("cri") >= 0.9, "cri").when((F.col("blank") >= 0.02) & (F.col("key") >= 0.5), "block").when(F.col("lead") >= 0.55, "anchor")
    return shares.select("path", pick.otherwise("line").alias("framing"), (F.col("request") >= 0.9).alias("one_line_grammar"))


def frame_line(lines: DataFrame) -> DataFrame:
    """Each line that isn't blank."""
    return lines.where(F.trim("text") != "").select("path", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "text")


def _grouped(lines: DataFrame, start: Column, glue: str, text: Column | None = None) -> DataFrame:
    """Runs that begin where ``start`` holds, their lines joined in order."""
    runs = along(lines, sums={"run": start.cast("int")})
    parts = F.array_sort(F.collect_list(F.struct("line_no", (text if text is not None else F.col("text")).alias("text"))))
    return runs.groupBy("path", "run").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.array_join(F.transform(parts, lambda p: p["text"]), glue).alias("text")).drop("run")


def frame_anchor(lines: DataFrame, start: str = LEADING_STAMP) -> DataFrame:
    """A line matching ``start`` begins a record; others continue it, joined by a space; blank lines end nothing and are left out."""
    full = lines.where(F.trim("text") != "")
    return _grouped(full, F.col("text").rlike(start), " ", F.trim("text"))


def frame_block(lines: DataFrame) -> DataFrame:
    """Paragraphs between blank lines, joined by line feeds."""
    blank = F.trim("text") == ""
    marked = along(lines, before={"was": blank}).where(~blank)
    return _grouped(marked, F.coalesce("was", F.lit(True)), "\n")


def frame_cri(lines: DataFrame, partial: Column, body: Column) -> DataFrame:
    """Lines whose ``partial`` flag holds go on in the next; the first keeps its text, others add ``body``."""
    lines = along(lines, before={"was": F.struct(partial.alias("partial"))}).withColumn("opens", F.coalesce(~F.col("was.partial"), F.lit(True)))
    return _grouped(lines, F.col("opens"), "", F.when(F.col("opens"), F.col("text")).otherwise(body))


def frame_key(lines: DataFrame, key: Column) -> DataFrame:
    """Consecutive lines that share ``key`` are one record, joined by line feeds."""
    lines = along(lines.withColumn("key", key), before={"was": F.struct("key")})
    return _grouped(lines, F.coalesce(F.col("was.key") != F.col("key"), F.lit(True)), "\n")


def framing_of(lines: DataFrame, fields: dict[str, Column] | None = None) -> DataFrame:
    """path, framing, field: ``frame_choice``, and ``key`` where nothing else claims a file and ``detect_key`` finds one of ``fields``."""
    choice = frame_choice(lines)
    if not fields:
        return choice.select("path", "framing", F.lit(None).cast("string").alias("field"))
    open_ = choice.where("framing = 'line' and not one_line_grammar").select("path")
    keys = detect_key(lines.join(open_, "path", "left_semi"), fields).select("path", "field")
    return choice.join(keys, "path", "left").select("path", F.when(F.col("field").isNotNull(), "key").otherwise(F.col("framing")).alias("framing"), "field")


def framed(lines: DataFrame, fields: dict[str, Column] | None = None, choice: DataFrame | None = None) -> DataFrame:
    """path, framing, line_start, line_end, text of the records of a mixed corpus, each file read by its own framing, all in one pass.

    ``choice`` (path, framing, field) is that of ``framing_of`` unless it is given. ``line``: each line that isn't blank.
    ``anchor``: leading stamps begin records, the rest joins by a space. ``block``: paragraphs. ``cri``: a line whose last tag
    before it is partial goes on, also one without a tag; the first keeps its prefix. ``key``: neighbours of one value of the file's field; lines
    without it join each other. A file without a line that isn't blank has no records.
    """
    choice = saved(framing_of(lines, fields) if choice is None else choice, "framing")  # a row a file; its size is known
    rows = lines.select("path", "line_no", "text").join(choice, "path")
    key = F.coalesce(*[F.when(F.col("field") == n, c.cast("string")) for n, c in (fields or {}).items()], F.lit(None).cast("string"))
    full, of = F.trim("text") != "", F.col("framing")
    rows = rows.withColumns({"full": full, "key": key, "tag": F.nullif(F.regexp_extract("text", CRI_TAG, 1), F.lit(""))})
    rows = along(rows, before={"blank": ~F.col("full"), "tag_was": F.col("tag"), "key_was": F.when(F.col("full"), F.struct("key"))})
    goes_on = F.coalesce(F.col("tag_was") == "P", F.lit(False))
    opens = F.when(of == "line", True).when(of == "anchor", F.col("text").rlike(LEADING_STAMP)).when(of == "block", F.coalesce("blank", F.lit(True))).when(of == "cri", ~goes_on)
    opens = opens.otherwise(F.col("key_was").isNull() | ~F.col("key_was.key").eqNullSafe(F.col("key")))
    rows = rows.withColumn("opens", opens).where(F.col("full") | (of == "cri") & goes_on)
    part = F.when(of == "anchor", F.trim("text")).when((of == "cri") & ~F.col("opens"), F.regexp_replace("text", CRI, "")).otherwise(F.col("text"))
    runs = along(rows.select("path", "framing", "line_no", part.alias("text"), "opens"), sums={"run": F.col("opens").cast("int")})
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda p: p["text"])
    out = runs.groupBy("path", "framing", "run").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), parts.alias("parts"))
    text = F.when(of == "anchor", F.array_join("parts", " ")).when(of == "cri", F.array_join("parts", "")).otherwise(F.array_join("parts", "\n"))
    return out.select("path", "framing", "line_start", "line_end", text.alias("text"))


def _stamp(text: Column) -> Column:
    """The first shape's name and reading, as one value; null without a clock."""
    keys = F.array(*[F.struct(F.lit(s).alias("shape"), order_key(text, s).alias("at")) for s in TIME_SHAPES])
    return F.get(F.filter(keys, lambda k: k["at"].isNotNull()), F.lit(0))


def detect_key(lines: DataFrame, fields: dict[str, Column], least_lines: int = 20) -> DataFrame:
    """path, field, runs, n, distinct: the field, if any, whose value holds a file's consecutive lines together as records.

    Files of whole JSON objects, and those with a clock on less than half of their lines, have none. A field is on 90 % of
    the lines; its runs of equal values have 1.5 lines on average; its values are 5 % of the lines or more, with and
    without the clock in them; 95 % of the values form a single run, and 90 % of the runs lie at one instant. Of several
    fields the one with the most values wins, then the one with longer runs.
    """
    full = lines.where(F.trim("text") != "")
    whole = (F.col("text").startswith("{") & F.expr("try_parse_json(text)").isNotNull()).cast("int")
    files = full.select("path", _stamp(F.col("text")).alias("stamp"), whole.alias("whole")).groupBy("path").agg(F.count("*").alias("lines"), F.count("stamp").alias("clocked"), F.sum("whole").alias("whole"))
    files = files.where((F.col("lines") >= least_lines) & (2 * F.col("clocked") >= F.col("lines")) & (10 * F.col("whole") < 9 * F.col("lines"))).select("path", "lines")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])).alias("p")
    rows = full.withColumn("stamp", _stamp(F.col("text"))).select("path", "line_no", "stamp", pairs).select("path", "line_no", "stamp", "p.field", "p.value").join(files.select("path"), "path", "left_semi")
    rows = along(rows, before={"was": F.struct("value")}, by=("path", "field"))
    opens = F.col("was").isNull() | ~F.col("was.value").eqNullSafe(F.col("value"))
    rows = along(rows, sums={"run": opens.cast("int")}, by=("path", "field"))
    instants = F.count_distinct("stamp") + F.max(F.col("stamp").isNull().cast("int"))
    runs = rows.groupBy("path", "field", "run").agg(F.first("value").alias("value"), F.count("*").alias("n"), (instants <= 1).cast("int").alias("at_once"))
    values = runs.groupBy("path", "field", "value").agg(F.count("*").alias("runs"), F.sum("n").alias("n"), F.sum("at_once").alias("at_once"))
    out = values.groupBy("path", "field").agg(F.sum("runs").alias("runs"), F.sum("n").alias("all"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("n"), F.count("*").alias("distinct"), F.count_distinct(clock_residue(F.coalesce("value", F.lit("")))).alias("residues"), F.count_if(F.col("runs") == 1).alias("single"), F.sum("at_once").alias("at_once"))
    ok = (10 * F.col("n") >= 9 * F.col("all")) & (2 * F.col("all") >= 3 * F.col("runs")) & (20 * F.col("distinct") >= F.col("all")) & (20 * F.col("residues") >= F.col("all")) & (100 * F.col("single") >= 95 * F.col("distinct")) & (10 * F.col("at_once") >= 9 * F.col("runs"))
    best = out.where(ok).groupBy("path").agg(F.max(F.struct("distinct", -F.col("runs"), "field", "runs", "n")).alias("b"))
    return best.select("path", "b.field", "b.runs", "b.n", "b.distinct")


def json_guard(lines: DataFrame) -> DataFrame:
    """path, whole_json: whether at least 90 % of a file's lines are whole JSON objects."""
    whole = F.col("text").startswith("{") & F.expr("try_parse_json(text)").isNotNull()
    return lines.groupBy("path").agg((10 * F.count_if(whole) >= 9 * F.count("*")).alias("whole_json"))


def informative_fields(text: Column) -> Column:
    """Of a block record's lines, those that aren't bare keys without a value."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*[:=]\s*$") & (F.trim(x) != "")), "\n")
