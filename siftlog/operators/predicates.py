"""Filters, rule tables and checks as columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.work import saved


def regex_scan(lines: DataFrame, pattern: str, drop: str | None = None) -> DataFrame:
    """Lines that match ``pattern`` and not ``drop``."""
    keep = F.col("text").rlike(pattern)
    return lines.where(keep & ~F.col("text").rlike(drop) if drop else keep)


def glob_match(value: Column, globs: str) -> Column:
    """Whether any of the bar-separated globs matches the whole value, without regard to case."""
    out = F.lit(False)
    for g in globs.split("|"):
        body = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in g)
        out = out | value.rlike(f"(?i)^{body}$")
    return out


def _condition(field: str, op: str, value: str) -> Column:
    c = F.col(field)
    if op == "~":
        return glob_match(c, value)
    v = F.lit(float(value)) if op in ("<", "<=", ">", ">=") else F.lit(value)
    c = c.cast("double") if op in ("<", "<=", ">", ">=") else c.cast("string")
    return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def first_rule(rules: list[tuple[str, int, str, str, str]]) -> Column:
    """The first rule, in order, all of whose (rule, place, field, op, value) conditions hold; null where none does."""
    out = F.lit(None).cast("string")
    for name, conditions in reversed([(k, list(g)) for k, g in groupby(rules, key=lambda r: r[0])]):
        all_ = F.lit(True)
        for _, _, field, op, value in conditions:
            all_ = all_ & _condition(field, op, value)
        out = F.when(all_, name).otherwise(out)
    return out


def every_code(text: Column, holds: Callable[[Column], Column]) -> Column:
    """Whether each standalone code of a line satisfies ``holds``; true without codes."""
    codes = F.regexp_extract_all(text, F.lit(r"(?:^|\s)([1-5]\d\d)(?=\s|$)"), F.lit(1))
    return F.forall(F.transform(codes, lambda c: c.cast("long")), holds)


def verdict_state(cell: Column) -> Column:
    """D and N need a digit, X a reason of three characters; anything else is open."""
    return F.when(cell.rlike(r"^D.*\d"), "D").when(cell.rlike(r"^N.*\d"), "N").when(cell.rlike(r"^X\s+\S.{2,}"), "X").otherwise("open")


def expand_ids(cell: Column, most: int = 5000) -> Column:
    """``g041-g068`` as its ids, any dash; ranges longer than ``most`` give none."""
    letter, low, high = (F.regexp_extract(cell, "^([A-Za-z]+)([0-9]+)[-\u2013\u2014][A-Za-z]*([0-9]+)$", g) for g in (1, 2, 3))
    ok = (low != "") & (high.cast("int") >= low.cast("int")) & (high.cast("int") - low.cast("int") < most)
    ids = F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda i: F.concat(letter, F.lpad(i.cast("string"), 3, "0")))
    return F.when(ok, ids)


def shape_gate(templates: DataFrame, share: float = 0.25) -> DataFrame:
    """path, n of files that look like no log: distinct templates over ``share`` of the records."""
    return templates.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("template").alias("d")).where(F.col("d") > share * F.col("n")).select("path", "n")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order``."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("r"))
    return best.select("r.*")


def doc_checks(docs: DataFrame, sections: list[str], banned: str, least: Column) -> DataFrame:
    """doc_id, present (sections), missing (how many), banned, collapsed (shorter than ``least``)."""
    present = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(s)), F.lit(s)) for s in sections]))
    return docs.select("doc_id", F.array_join(present, ",").alias("present"), (F.lit(len(sections)) - F.size(present)).cast("long").alias("missing"), F.contains("text", F.lit(banned)).alias("banned"), (F.length("text") < least).alias("collapsed"))


def diagnosis(found: Column, collapsed: Column, reached: Column, unknown: Column) -> Column:
    """The first of ok, collapsed, reasoning, inconclusive that applies, else coverage."""
    return F.when(found, "ok").when(collapsed, "collapsed").when(reached, "reasoning").when(unknown, "inconclusive").otherwise("coverage")


def quality_checks(docs: DataFrame, languages: tuple[str, ...] = ("en", "de", "fr")) -> DataFrame:
    """doc_id, found: the violated checks of each row, comma-separated."""
    digest = docs.withColumn("digest", F.sha2("text", 256))
    copies = digest.groupBy("digest").count().where("count > 1").select("digest", F.lit(True).alias("copy"))
    marked = digest.join(copies, "digest", "left")
    checks = F.array(F.when(~F.col("lang").isin(*languages), "lang"), F.when(F.length("text") < 100, "short"), F.when(F.col("n_chars") != F.length("text"), "n_chars"), F.when(F.col("copy"), "copy"))
    return marked.select("doc_id", F.array_join(F.array_compact(checks), ",").alias("found"))


def quote_hits(texts: DataFrame, quotes: DataFrame, words: int = 3, letters: int = 3) -> DataFrame:
    """(doc_id, item_id) where the text holds the quote.

    The first and the last word of a quote may end inside words of the text, those between are whole. Candidates share what a quote
    surely leaves in a text, then are verified: the first ``words`` whole words, else the longest whole word, else a run of ``letters``
    characters in the quote's middle. Quotes shorter than that are tried on every text; there is no such pass where there are none.
    """
    parts = F.split("quote", " ")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    kind = F.when(F.size(parts) >= words + 2, "words").when((F.size(parts) > 2) & (longest != ""), "word").when(F.length("quote") >= letters, "letters").otherwise("none")
    middle = F.substr("quote", F.floor((F.length("quote") - letters) / 2).cast("int") + 1, F.lit(letters))
    key = F.when(F.col("kind") == "words", F.array_join(F.slice(parts, 2, words), " ")).when(F.col("kind") == "word", longest).when(F.col("kind") == "letters", middle)
    keyed = saved(quotes.where("quote is not null").withColumn("kind", kind).select("item_id", "quote", "kind", key.alias("key")), "quote-keys")  # its size is known
    there = {r[0] for r in keyed.select("kind").distinct().collect()}
    texts = texts.withColumn("w", F.split("t", " "))  # named twice below, so it is computed once for each text
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    of = {"words": runs(words), "word": F.col("w"), "letters": F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - letters + 1, F.lit(1))), lambda i: F.substr("t", i, F.lit(letters)))}
    found = texts.select("doc_id", F.lit(None).cast(quotes.schema["item_id"].dataType).alias("item_id")).where("false")
    for name in sorted(there & set(of)):
        own = keyed.where(F.col("kind") == name).drop("kind")
        met = texts.select("doc_id", F.explode(F.array_distinct(of[name])).alias("key")).join(own, "key").select("doc_id", "item_id", "quote").distinct()
        found = found.union(met.join(texts, "doc_id").where(F.contains("t", F.col("quote"))).select("doc_id", "item_id"))
    if "none" in there:
        short = keyed.where("kind = 'none'").select("item_id", "quote")
        found = found.union(texts.join(short, F.contains("t", F.col("quote"))).select("doc_id", "item_id"))
    return found.distinct()


def select_run(runs: DataFrame, order: str, arm: str | None = None, trace: str | None = None, dataset: str | None = None) -> DataFrame:
    """The last run by ``order`` of (dataset, arm, stub, trace_dir, ...), chosen and never guessed.

    Stubs are no runs. ``trace`` is part of the run's trace_dir. No run that fits, or runs of more than one dataset (a null one is
    one) where none was named, raise ValueError, for a score against another dataset's key would look like one.
    """
    live = runs.where(~F.coalesce("stub", F.lit(False)))
    for name, value, fits in (("arm", arm, F.col("arm") == arm), ("trace", trace, F.contains(F.coalesce("trace_dir", F.lit("")), F.lit(trace))), ("dataset", dataset, F.col("dataset") == dataset)):
        live = live.where(fits) if value else live
    n, sets, nulls = live.agg(F.count("*"), F.count_distinct("dataset"), F.count_if(F.col("dataset").isNull())).first()
    if not n:
        raise ValueError(f"no run of arm {arm}, trace {trace}, dataset {dataset}")
    if sets + (nulls > 0) > 1:
        raise ValueError(f"runs of {sets + (nulls > 0)} datasets; name one")
    return live.agg(F.max_by(F.struct(*live.columns), order).alias("r")).select("r.*")


#: Fixed value: how a text refers to a line of a file.
REFERENCE = r"([A-Za-z0-9_.\-]+\.log):(\d+)"


def checklist(texts: DataFrame, row: str, text: str, checks: dict[str, str], lines: DataFrame) -> DataFrame:
    """row, quality, quality_max, missed, refs, refs_ok of each text: checks that its text meets, and references to lines that there are.

    ``lines`` has (path, line_no); a reference is good if some file of that name has that many lines. Null texts meet nothing.
    """
    name = F.element_at(F.split("path", "/"), -1)
    files = lines.groupBy(name.alias("file")).agg(F.max("line_no").alias("most"))
    body = F.coalesce(F.col(text), F.lit(""))
    missed = F.array_compact(F.array(*[F.when(~body.rlike(p), F.lit(n)) for n, p in checks.items()]))
    both = F.zip_with(F.regexp_extract_all(body, F.lit(REFERENCE), F.lit(1)), F.regexp_extract_all(body, F.lit(REFERENCE), F.lit(2)), lambda f, n: F.struct(f.alias("file"), n.try_cast("long").alias("n")))
    held = texts.select(F.monotonically_increasing_id().alias("at"), F.col(row).alias(row), missed.alias("missed"), both.alias("refs"))
    held = saved(held, "checklist")  # numbered once
    good = held.select("at", F.explode("refs").alias("r")).join(files, F.col("r.file") == files["file"]).where(F.col("r.n").between(1, F.col("most"))).groupBy("at").agg(F.count("*").alias("ok"))
    out = held.join(good, "at", "left")
    return out.select(row, (F.lit(len(checks)) - F.size("missed")).alias("quality"), F.lit(len(checks)).alias("quality_max"), F.array_join("missed", ",").alias("missed"), F.size("refs").alias("refs"), F.coalesce("ok", F.lit(0)).alias("refs_ok"))
