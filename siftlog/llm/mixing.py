"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight (u from a hash of its id and text, so
reruns agree); smaller keys come first within a source. A source whose target is e times its size and a rest
takes e complete epochs of all its documents and then, in key order, documents up to the rest. The prefix sums are
split: the sizes of key intervals are summed first, and only the distinct keys of the one interval in which a source's
budget ends are ordered. Every row then tells by its own key whether it is taken, so rows are never shuffled and no
source gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.llm.shared import WORD, picked, saved

#: Key intervals to each unit of a key's natural logarithm. Keys of one weight are spread over it like a Gumbel
#: variable, whose density is 0.37 at most; so no interval holds more than about 1 / 11,000 of a source, whatever its weights.
INTERVALS = 4096


def default_quality(text: Column) -> Column:
    """In (0, 1]: 1 for plain prose, less by the share of ``#*$%&|<>``, 0.05 at least."""
    size = F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), 1 - 8 * (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))) / size)


def targets(sizes: DataFrame, cap: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> also target: the sum of all sizes shared by the cycling weights, at most cap times the size.

    Sources go by code point, null last. What a source can't take is shared among the others by weight until
    none is above: the level at which sum(min(cap * size, level * weight)) is the sum of all sizes. One row for each
    source is ordered here, not one for each document.
    """
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), place + 1)).withColumn("most", cap * F.col("source_size"))
    by = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumns({"full": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "open": F.sum("weight").over(after), "all": F.sum("source_size").over(W.partitionBy())})
    # The level if all before a source are full; it falls from the first source that it doesn't fill, so that one's is the largest.
    rows = rows.withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(W.partitionBy())
    return rows.select("source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def _drawn(docs: DataFrame, id_col: str, text_col: str, seed: str, quality: Column | None) -> Column:
    """The key of each row of ``docs``: equal for rows of equal id, text and quality, and for equal texts of null ids."""
    weight = quality if quality is not None else default_quality(F.coalesce(docs[text_col], F.lit("")))
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), docs[id_col].cast("string"), F.when(docs[id_col].isNull(), F.coalesce(docs[text_col], F.lit(""))))), 1, 12), 16, 10).cast("double")
    return -F.log((digits + 0.5) / float(1 << 48)) / F.greatest(weight.cast("double"), F.lit(1e-6))


def _ends(rows: DataFrame, cap: float, cycle: tuple[int, ...]) -> DataFrame:
    """(source, size, key, interval) of all rows -> one row for each source: source_size, target, whole (epochs), and up to
    which ``end`` (interval) and there up to which ``last`` (key, null for none) the rest is taken."""
    sums = saved(rows.groupBy("source", "interval").agg(F.sum("size").alias("held")), "mix-intervals")
    aims = targets(sums.groupBy("source").agg(F.sum("held").alias("source_size")), cap, cycle)
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = saved(aims.withColumn("rest", F.when(F.col("whole") < cap, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)), "mix-targets")
    upto = W.partitionBy("source").orderBy("interval").rowsBetween(W.unboundedPreceding, -1)
    at = picked(sums.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0))), of="source", interval="interval", before="before", held="held")
    # The first interval that goes beyond the rest: all before it are taken.
    over = at.join(aims, at["of"].eqNullSafe(aims["source"])).where(F.col("before") + F.col("held") > F.col("rest"))
    over = over.groupBy("of").agg(F.min(F.struct("interval", "before", "rest")).alias("o")).select("of", "o.*")
    over = saved(over.withColumnRenamed("interval", "end"), "mix-over")
    some = rows.join(over, rows["source"].eqNullSafe(over["of"]) & (rows["interval"] == over["end"]))
    keys = some.groupBy("of", "before", "rest", "key").agg(F.sum("size").alias("same"))
    along = W.partitionBy("of").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    keys = keys.withColumn("through", F.col("before") + F.sum("same").over(along))
    # The key at which the budget ends is taken if that comes nearer to it than leaving it.
    last = keys.where(2 * F.col("through") - F.col("same") <= 2 * F.col("rest")).groupBy("of").agg(F.max("key").alias("last"))
    last = last.select(F.col("of").alias("last_of"), "last")
    ends = over.select("of", "end").join(last, F.col("of").eqNullSafe(F.col("last_of")), "left")
    out = aims.join(ends, aims["source"].eqNullSafe(ends["of"]), "left")
    return saved(out.select(F.col("source").alias("of"), "source_size", "target", "whole", (F.col("rest") > 0).alias("some"), "end", "last"), "mix-ends")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, quality: Column | None, **columns: Column) -> DataFrame:
    """source, key and interval of each row, and the named columns."""
    key = _drawn(docs, id_col, text_col, seed, quality)
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], docs[source_col].cast("string").alias("source"), key.alias("key"))
    return rows.withColumn("interval", F.floor(F.log("key") * INTERVALS).cast("long"))


def _size(docs: DataFrame, text_col: str) -> Column:
    return F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)).cast("long")


def _times(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows with a key, with the columns of their source's end and epochs, the times that they are taken."""
    # One row for each source, of a size that Spark knows: it is broadcast if it is small, else skewed partitions are split.
    rows = rows.join(ends, rows["source"].eqNullSafe(ends["of"]))
    extra = F.col("some") & (F.col("end").isNull() | (F.col("interval") < F.col("end")) | ((F.col("interval") == F.col("end")) & (F.col("key") <= F.col("last"))))
    return rows.withColumn("epochs", (F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int")).cast("int"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3), seed: str = "mix", quality: Column | None = None) -> DataFrame:
    """Return doc_id, source, size (words), source_size, target, epochs (times the document is taken) and taken (words, repeats counted).

    Nulls: a null text has size 0; a null source is a source of its own, the last; a null id draws its key from its
    text. Repeated rows are documents of their own with equal keys; if the budget ends among them, all or none of
    those equal keys are taken. Documents of size 0 are taken 0 words. An empty table gives an empty result.
    ``quality``: a positive weight for each row of ``docs``; by default from the text.
    """
    keys = saved(_keyed(docs, id_col, text_col, source_col, seed, quality, doc_id=docs[id_col], size=_size(docs, text_col)), "mix-keys")
    return _times(keys, _ends(keys, cap, cycle)).select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3), seed: str = "mix", quality: Column | None = None) -> DataFrame:
    """The rows themselves, each as many times as ``mix_sources`` takes it; columns stay as they are, whatever their names.

    Each row tells by its own key how often it is taken, so ids need not be unique: repeated rows and rows with a null id are
    each taken for themselves. Documents of size 0 are repeated like others of their key. An empty table gives an empty result.
    """
    keys = saved(_keyed(docs, id_col, text_col, source_col, seed, quality, size=_size(docs, text_col)), "mix-keys")
    rows = _keyed(docs, id_col, text_col, source_col, seed, quality, row=F.struct(*[docs[c] for c in docs.columns]))
    return _times(rows, _ends(keys, cap, cycle)).where("epochs > 0").select("row", F.explode(F.sequence(F.lit(1), "epochs"))).select("row.*")
