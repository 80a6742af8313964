"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of ``width`` template words of the benchmark items are
hash-joined with those of all documents. Along each alignment of an item with a document the placeholders' values
must map consistently (one value of the item always to one value in the document); windows that hold a value which
doesn't are dropped, but for those whose values all equal the item's. An item of fewer than ``width`` words is one
window of its own length; if it holds nothing but placeholders, only equal values match it. A document is contaminated by an item if the share of the item's windows found is ``share`` or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.llm.bytetext import LOWER, U, give_back, mix, prefix_sums, spans, text_buffers, word_bounds
from siftlog.llm.shared import picked, saved, small_batches

#: Units, after a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "s", "sec", "min", "h", "hr", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "meters", "metres", "miles", "feet", "inches", "grams", "pounds", "liters", "litres", "dollars", "euros", "cents", "percent", "%", "$", "€", "£", "°c", "°f", "kmh", "mph", "w", "kw", "v", "hz", "kb", "mb", "gb")
NUMBER, NAME, UNIT = (U(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x510E527FADE682D1))
MATCH = "doc_id long, spot long, place int, length int, window long, slots array<long>, bare boolean"

#: What tells an alignment of an item with a document; values that are the item's own.
LINE, EQUAL = ["doc_id", "spot", "item_id", "along"], "slots = item_slots"

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x24), *range(0x26, 0x30), 0x3A, 0x3B, *range(0x3C, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3A, 0x3F]] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z, and the capitals of U+00C0 to U+00DE, in UTF-8."""
    low = LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    low[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    return low


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, down = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def _unit_hashes() -> np.ndarray:
    words = [u.encode() for u in UNITS]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.unique(_hashes(data, ends - [len(w) for w in words], ends))


def template_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(words of each document, template word, value, is slot) of all words.

    A word loses punctuation at its ends and its case. A number holds digits and no letters; a unit follows a number; a
    name starts with a capital and doesn't start a text, line or sentence.
    """
    starts, ends, doc = word_bounds(data, offsets)
    if not len(starts):
        none = np.zeros(0, U)
        return np.zeros(len(offsets) - 1, np.int64), none, none, np.zeros(0, bool)
    at = np.arange(len(data))
    solid = ~_PUNCTUATION[data]
    ahead = np.minimum.accumulate(np.where(solid, at, len(data))[::-1])[::-1]
    behind = np.maximum.accumulate(np.where(solid, at, -1))
    a, b = ahead[starts], behind[ends - 1] + 1
    bare = (a >= ends) | (b <= starts)
    a, b = np.where(bare, starts, a), np.where(bare, ends, b)
    value = _hashes(_lowered(data), a, b)
    digits, letters = (np.concatenate(([0], np.cumsum(t[data]))) for t in (_DIGIT, _LETTER))
    number = (digits[b] > digits[a]) & (letters[b] == letters[a])
    first = data[a]
    capital = ((first >= 0x41) & (first <= 0x5A)) | ((first == 0xC3) & (data[np.minimum(a + 1, len(data) - 1)] <= 0x9E))
    opens = np.ones(len(starts), bool)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    opens[1:] = (doc[1:] != doc[:-1]) | _STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    after = np.zeros(len(starts), bool)
    after[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit = after & np.isin(value, _unit_hashes())
    name = capital & ~opens & ~number & ~unit
    word = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    slot = number | unit | name
    return np.bincount(doc, minlength=len(offsets) - 1), word, value, slot


def windows_of(count: np.ndarray, word: np.ndarray, value: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document, place, window hash, values, is slot) of each window; the last two are arrays of ``width`` columns."""
    full = np.maximum(count - width + 1, 0)
    begin = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), full)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    index = (place + begin[owner])[:, None] + np.arange(width)
    out = np.full(len(owner), width, U)
    for k in range(width):
        out = mix(out * U(0xD6E8FEB86659FD93) + word[index[:, k]])
    return owner, place, out, value[index], slot[index]


def _windows(width: int, lengths: list[int] | None, wanted: np.ndarray | None):
    """Arrow task: (doc_id, spot, text) -> windows of the ``lengths``, only those in ``wanted`` where it is given.

    Without ``lengths``, those of items: of ``width`` words, or of the whole text if it is shorter.
    """

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            ids, spots = batch["doc_id"], batch["spot"]
            for i, j in spans(offsets, 1 << 18):
                count, *words = template_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for length in lengths or range(1, width + 1):
                    doc, place, window, values, slots = windows_of(count, *words, length)
                    keep = np.ones(len(window), bool)
                    if lengths is None and length < width:
                        keep = count[doc] == length
                    if wanted is not None:
                        at = np.minimum(np.searchsorted(wanted, window), max(len(wanted) - 1, 0))
                        keep = wanted[at] == window if len(wanted) else np.zeros(len(window), bool)
                    doc, place, window, values, slots = doc[keep], place[keep], window[keep], values[keep], slots[keep]
                    ends = np.cumsum(np.concatenate(([0], slots.sum(axis=1, dtype=np.int64))))
                    slot_values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[slots].view(np.int64)))
                    take, bare = pa.array(doc + i), pa.array(slots.all(axis=1) & (length < width))
                    own = pa.array(np.full(len(doc), length, np.int32))
                    yield pa.RecordBatch.from_arrays([ids.take(take), spots.take(take), pa.array(place.astype(np.int32)), own, pa.array(window.view(np.int64)), slot_values, bare], ["doc_id", "spot", "place", "length", "window", "slots", "bare"])
        give_back()

    return run


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows without an id or text are left out; a text is told by its hash."""
    return picked(df, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("spot"), "text")


def _found(texts: DataFrame, items: DataFrame, width: int, most_broadcast: int) -> DataFrame:
    """doc_id, spot, place, window, slots: the items' windows in the texts."""
    spark = texts.sparkSession
    lengths = sorted(r[0] for r in items.select("length").distinct().collect()) or [width]
    distinct = items.select("window").distinct()
    wanted = None
    if distinct.limit(most_broadcast + 1).count() <= most_broadcast:
        wanted = np.sort(np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64))
    found = texts.mapInArrow(_windows(width, lengths, wanted), MATCH).select("doc_id", "spot", "place", "window", "slots")
    if wanted is None:
        found = found.join(distinct, "window", "left_semi")
    with small_batches(spark):
        return saved(found, "benchmark-found")  # windows of items only


def _hits(found: DataFrame, items: DataFrame, totals: DataFrame, share: float) -> DataFrame:
    """doc_id, spot, item_id, along, window, item_place, item_slots, slots, torn: windows of items in documents that may hold enough of them.

    torn are the item's values that meet two values of the document on the line; null where there are none.
    """
    asked = items.select(F.col("doc_id").alias("item_id"), F.col("place").alias("item_place"), "window", F.col("slots").alias("item_slots"), "bare")
    # A document with the asked share of an item's windows has one of its rarest few, so windows that many items share meet only
    # the pairs that those few leave.
    often = asked.groupBy("window").agg(F.count_distinct("item_id").alias("items"))
    rarest = W.partitionBy("item_id").orderBy("items", "window")
    rare = asked.select("item_id", "window").distinct().join(often, "window").withColumn("rank", F.row_number().over(rarest)).join(totals, "item_id")
    rare = saved(rare.where(F.col("rank") <= F.col("n_windows") - F.ceil(share * F.col("n_windows") - 1e-9) + 1).select("item_id", "window"), "benchmark-rare")
    tried = saved(found.select("doc_id", "window").distinct().join(rare, "window").select("doc_id", "item_id").distinct(), "benchmark-tried")
    hits = tried.join(asked, "item_id").join(found, ["doc_id", "window"]).where(~F.col("bare") | F.expr(EQUAL)).drop("bare")
    hits = saved(hits.withColumn("along", F.col("place") - F.col("item_place")), "benchmark-hits")
    pairs = hits.select(*LINE, F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    torn = pairs.groupBy(*LINE, F.col("s.item_slots").alias("v")).agg(F.min("s.slots").alias("least"), F.max("s.slots").alias("most")).where("least <> most")
    torn = torn.groupBy(*LINE).agg(F.collect_list("v").alias("torn"))  # values of one item
    return hits.join(torn, LINE, "left")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, share: float = 0.8, most_broadcast: int = 1 << 20) -> DataFrame:
    """Return doc_id, item_id, n_windows (of the item), n_found, exact (all slot values equal): one row for each contaminated pair.

    Null and empty texts have no windows and match nothing; rows with a null id are left out, as are items with a null
    id. Repeated rows of documents with one id count as one document. Empty tables give an empty result. Up to
    ``most_broadcast`` distinct benchmark windows go to the tasks as a filter before the join; beyond that, all
    windows are joined by shuffle, with equal results. Items made of one template each meet its documents; ``contamination_classes``
    has one row for all of them.
    """
    items = saved(_texts(benchmark, item_col, item_text_col).mapInArrow(_windows(width, None, None), MATCH), "benchmark-windows")
    totals = items.groupBy(F.col("doc_id").alias("item_id")).agg(F.count_distinct("window").alias("n_windows"))
    hits = _hits(_found(_texts(docs, id_col, text_col), items, width, most_broadcast), items, totals, share)
    held = hits.where(F.col("torn").isNull() | F.expr(EQUAL) | ~F.arrays_overlap("item_slots", "torn"))
    out = held.groupBy("doc_id", "item_id").agg(F.count_distinct("window").alias("n_found"), F.bool_and(F.expr(EQUAL) & F.col("torn").isNull()).alias("exact"))
    out = out.join(totals, "item_id").where(F.col("n_found") >= share * F.col("n_windows"))
    return out.select("doc_id", "item_id", "n_windows", "n_found", "exact")


def item_classes(items: DataFrame) -> DataFrame:
    """item_id, class_id, values: items whose windows are the same at the same places, with equal values in the same slots of the template.

    The least item_id names a class. An item that only equal values match is in a class with its equals. ``values`` tells the values of an item.
    """
    windows = F.array_sort(F.collect_list(F.struct("place", "length", "window", "slots", "bare")))
    rows = items.groupBy(F.col("doc_id").alias("item_id")).agg(windows.alias("w"))
    rows = saved(rows.withColumn("slots", F.flatten(F.transform("w", lambda x: x["slots"]))), "benchmark-items")
    pattern = F.transform("slots", lambda v: F.array_position("slots", v))
    own = F.when(F.exists("w", lambda x: x["bare"]), F.col("slots"))
    key = F.struct(F.transform("w", lambda x: F.struct(x["place"], x["length"], x["window"])).alias("w"), pattern.alias("p"), own.alias("o"))
    rows = rows.select("item_id", F.sha2(F.to_json(key).cast("binary"), 256).alias("key"), F.xxhash64("slots").alias("values"))
    least = rows.groupBy("key").agg(F.min("item_id").alias("class_id"))
    return saved(rows.join(least, "key").select("item_id", "class_id", "values"), "benchmark-classes")


def contamination_classes(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, share: float = 0.8, most_broadcast: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(doc_id, item_id, n_items, n_windows, n_found, exact; item_id, class_id): a row for each document and class of items, and the classes' members.

    Items that differ only in the values of their slots meet a document alike, so one of them, ``item_id``, is tried for all
    ``n_items``: the pairs grow with documents and templates, not with items of a template. A window with a torn value counts where its values are those of
    some member at that place. exact: the document holds every window of a member with its values. Ids, nulls, repeated rows and
    empty tables are treated as by ``find_contamination``; any pair of that one is in a row of this one.
    """
    items = saved(_texts(benchmark, item_col, item_text_col).mapInArrow(_windows(width, None, None), MATCH), "benchmark-windows")
    members = item_classes(items)
    of = items.join(members.select(F.col("item_id").alias("doc_id"), "class_id"), "doc_id")
    first = saved(of.where("doc_id = class_id").drop("class_id"), "benchmark-first")
    totals = first.groupBy(F.col("doc_id").alias("item_id")).agg(F.count_distinct("window").alias("n_windows"), F.count_distinct("place").alias("places"))
    hits = saved(_hits(_found(_texts(docs, id_col, text_col), first, width, most_broadcast), first, totals.select("item_id", "n_windows"), share), "benchmark-lines")
    sound = F.col("torn").isNull() | ~F.arrays_overlap("item_slots", "torn")
    literal = of.where(F.size("slots") > 0).select(F.col("class_id").alias("item_id"), F.col("place").alias("item_place"), "slots").distinct()
    torn = hits.where(~sound).join(literal, ["item_id", "item_place", "slots"], "left_semi")
    held = hits.where(sound).select(*LINE, "window").unionByName(torn.select(*LINE, "window"))
    counts = held.groupBy("doc_id", "item_id").agg(F.count_distinct("window").alias("n_found"))
    # Values along a line, where every place of the item is there.
    lines = hits.where("torn is null").groupBy(*LINE).agg(F.array_sort(F.collect_set(F.struct("item_place", "slots"))).alias("w"))
    lines = lines.join(totals.select("item_id", "places"), "item_id").where(F.size("w") == F.col("places"))
    lines = lines.select("doc_id", "item_id", F.xxhash64(F.flatten(F.transform("w", lambda x: x["slots"]))).alias("values"))
    whole = lines.join(members.select(F.col("class_id").alias("item_id"), "values").distinct(), ["item_id", "values"], "left_semi").select("doc_id", "item_id").distinct().withColumn("exact", F.lit(True))
    sizes = members.groupBy(F.col("class_id").alias("item_id")).agg(F.count("*").alias("n_items"))
    out = counts.join(totals, "item_id").where(F.col("n_found") >= share * F.col("n_windows")).join(sizes, "item_id").join(whole, ["doc_id", "item_id"], "left")
    return out.select("doc_id", "item_id", "n_items", "n_windows", "n_found", F.coalesce("exact", F.lit(False)).alias("exact")), members.select("item_id", "class_id")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that no item contaminates; columns stay as they are.

    Rows are judged by their texts alone (told apart by 64-bit hashes), so ids may be null or repeated. Null and empty texts stay.
    Empty tables: an empty result, or all documents.
    """
    texts = docs.select(F.xxhash64(docs[text_col]).alias("doc_id"), docs[text_col].alias("text"))
    bad, _ = contamination_classes(texts, benchmark, id_col="doc_id", text_col="text", **options)
    bad = saved(bad.select(F.col("doc_id").alias("bad_text")).distinct(), "benchmark-bad")
    return docs.join(bad, F.xxhash64(docs[text_col]) == bad["bad_text"], "left_anti")
