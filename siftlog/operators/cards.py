"""Cards: sets of patterns over a corpus, as rows, with evidence as bits.

Each pattern of a card has a bit. A file's evidence is the ``bit_or`` of its lines' bits, a card's that of its files; whether all of a
card's patterns stand somewhere is one comparison, and evidence of files, days or corpora is merged by ``bit_or`` again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.operators.trace import firsts

#: Kinds of patterns; how much of a line an example shows.
KINDS = ("any", "all", "name")
MOST_EXAMPLE = 160
#: A card's bits lie in one long.
MOST_BITS = 62


def _numbered(cards: DataFrame, most: int) -> list:
    """Distinct patterns with card, kind and bit, by card; the table is bounded, which is checked."""
    rows = cards.select("card", "kind", "pattern").where("pattern is not null and pattern <> ''").distinct().orderBy("card", "kind", "pattern").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    out, bits = [], {}
    for r in rows:
        if r["kind"] not in KINDS:
            raise ValueError(f"kind {r['kind']} of card {r['card']} is none of {KINDS}")
        out.append((r["card"], r["kind"], r["pattern"], bits.setdefault(r["card"], 0)))
        bits[r["card"]] += 1
        if bits[r["card"]] > MOST_BITS:
            raise ValueError(f"card {r['card']} has more than {MOST_BITS} patterns")
    return out


def evidence(lines: DataFrame, cards: DataFrame, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(card, path, bits, hits; card, kind, pattern, bit, path, line_no, example) of (path, line_no, text) and cards (card, kind, pattern).

    ``any`` and ``all`` patterns hit lines, ``name`` patterns the last part of a path, once, at line 0. Patterns become columns
    of one pass over the lines; more than ``most`` of them are refused. Repeated rows of cards count once, null and empty patterns not at all.
    """
    rows = _numbered(cards, most)
    hit = lambda subject, which: F.array_compact(F.array(*[F.when(subject.rlike(r[2]), F.lit(i)) for i, r in enumerate(rows) if r[1] in which], F.lit(None).cast("int")))
    by_line = lines.select("path", "line_no", "text", F.explode(hit(F.col("text"), ("any", "all"))).alias("i"))
    by_line = by_line.select("path", "line_no", F.substring(F.trim("text"), 1, MOST_EXAMPLE).alias("example"), "i")
    names = lines.select("path").distinct().withColumn("i", F.explode(hit(F.substring_index("path", "/", -1), ("name",))))
    hits = by_line.unionByName(names.select("path", F.lit(0).cast("long").alias("line_no"), F.lit("").alias("example"), "i"))
    meta = lines.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, card string, kind string, pattern string, bit int")
    hits = hits.join(F.broadcast(meta), "i").drop("i")  # ``most`` rows
    one = F.expr("shiftleft(1L, bit)")
    return hits.groupBy("card", "path").agg(F.bit_or(one).alias("bits"), F.count("*").alias("hits")), hits


def card_verdicts(lines: DataFrame, cards: DataFrame, keep: int = 3, most: int = 2000) -> DataFrame:
    """card, holds, bits, hits, files and examples of each card of the table.

    A card holds if one of its ``any`` or ``name`` patterns hits, or if it has ``all`` patterns and each of them hits somewhere in
    the corpus, in whatever files. examples are the first ``keep`` hits of each pattern by path and line, as ``bit:path:line``.
    """
    by_file, hits = evidence(lines, cards, most)
    masks: dict[str, list[int]] = {}
    for card, kind, _, bit in _numbered(cards, most):
        masks.setdefault(card, [0, 0])[kind == "all"] |= 1 << bit
    table = lines.sparkSession.createDataFrame([(c, a, b) for c, (a, b) in masks.items()], "card string, one long, every long")
    merged = by_file.groupBy("card").agg(F.bit_or("bits").alias("bits"), F.sum("hits").alias("hits"), F.count("*").alias("files"))
    first = firsts(hits.select("card", "bit", "path", "line_no"), ["card", "bit"], ["path", "line_no"], keep)
    shown = first.groupBy("card").agg(F.array_sort(F.collect_list(F.struct("bit", "path", "line_no"))).alias("p"))
    examples = F.transform("p", lambda x: F.concat_ws(":", x["bit"], x["path"], x["line_no"]))
    out = table.join(merged, "card", "left").join(shown, "card", "left").withColumn("bits", F.coalesce("bits", F.lit(0)).cast("long"))
    holds = (F.col("bits").bitwiseAND(F.col("one")) != 0) | (F.col("every") != 0) & (F.col("bits").bitwiseAND(F.col("every")) == F.col("every"))
    return out.select("card", holds.alias("holds"), "bits", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce(examples, F.array().cast("array<string>")).alias("examples"))
