"""Secrets in texts: fixed patterns, and runs of characters that a battery of randomness tests takes for random.

DataFrame functions only. Fixed patterns give the base spans. Every other run of 16 or more characters of the base64 alphabets is
a candidate; its encoding is the smallest of ``ENCODINGS`` that has all its characters. Over the places of its characters in
that alphabet of k, for n characters, three tests ask whether they may be drawn at random, each a deviation that has mean
0 and variance 1 for random characters:

* chi-squared of the characters' counts against uniform ones, by its exact mean k - 1 and variance 2 (k - 1) (n - 1) / n;
* runs: changes between the lower and the upper half of the alphabet, against half of the n - 1 neighbours;
* serial correlation of neighbouring places.

A candidate that fails one of them (Bonferroni, at ``alpha``) is no secret: letters in order are even, but not random. Passing
proves little for short ones, since words are short, too. So the second question is whether an ordinary run of that
length would have so few equal pairs of characters. Ordinary characters have the frequencies that all texts of the corpus give the
alphabet's characters; the mean and variance of equal pairs follow exactly, and their lower tail is the p-value. Over the corpus's
different candidates, Benjamini-Hochberg keeps the share of false finds below ``fdr``, with p-values weighted by length (a
candidate's bits over the mean), and thresholds in steps of a sixteenth of a power of two, so that a bounded table of counts
settles it. Candidates of fewer than ``least_bits`` are never secrets.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.shared import picked, saved

#: Kinds of base spans in the order they are listed, their patterns; the least length of a value of ``assign``.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
_UPPER, _LOWER, _DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: Smallest first; each has an even number of characters.
ENCODINGS = (
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
    _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_", _UPPER + _LOWER + _DIGITS + "+/-_",
)
#: Steps of thresholds in a power of two, and the most steps: smaller p-values count as the last one.
STEPS, MOST_STEPS = 16, 16 * 900


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(lengths: Column, step: int = 128) -> Column:
    """The sum of an array's entries up to each one, by blocks of ``step``: nearly linear in the array's length."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    blocks = lambda a: F.sequence(F.lit(0), F.floor(F.size(a) / step).cast("int"))
    before = lambda a: F.aggregate(
        blocks(a), F.array(F.lit(0).cast("long")), lambda sums, b: F.array_append(sums, F.element_at(sums, -1) + total(F.slice(a, b * step + 1, F.lit(step))))
    )

    def sums(x: Column) -> Column:
        block = lambda i: F.floor(i / step).cast("int")
        return F.transform(x["a"], lambda _, i: F.get(x["before"], block(i)) + total(F.slice(x["a"], block(i) * step + 1, i - block(i) * step + 1)))

    return let(lengths, lambda a: let(F.struct(a.alias("a"), before(a).alias("before")), sums))


def matches(text: Column, pattern: str, good: Callable[[Column], Column] | None = None) -> Column:
    """start, end (code points, end exclusive) and token of the pattern's leftmost, non-overlapping matches, without those that aren't good.

    Starts are sums of the lengths of the matches and of what is between them.
    """
    lengths = lambda p, m: F.transform(p, lambda x, i: (F.length(x) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(0)).cast("long"))
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("tokens"))
    placed = let(both, lambda b: let(running(lengths(b["pieces"], b["tokens"])), lambda s: F.transform(b["tokens"], lambda t, i: F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(t)).alias("end"), t.alias("token")))))
    none = F.array().cast("array<struct<start: bigint, end: bigint, token: string>>")
    placed = F.when(text.rlike(pattern), placed).otherwise(none)
    return placed if good is None else F.filter(placed, lambda m: good(m["token"]))


def base_spans(text: Column) -> Column:
    """start, kind (its place in KINDS), end of the base spans, each kind for itself."""
    some = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    of = lambda kind, found: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))
    assign = matches(text, ASSIGN, lambda t: F.length(F.regexp_extract(t, ASSIGN, 2)) >= LEAST_VALUE)
    assign = F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), of(0, assign)).otherwise(some)
    access = F.when(F.contains(text, F.lit("AKIA")), of(1, matches(text, ACCESS))).otherwise(some)
    return F.concat(assign, access, of(2, matches(text, HEX)))


def tail(z: Column) -> Column:
    """The upper tail of the normal distribution, to 0.3 percent of itself."""
    a = F.abs(z)
    upper = F.exp(-a * a / 2) / (((1 - 0.339) * a + 0.339 * F.sqrt(a * a + 5.51)) * math.sqrt(2 * math.pi))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def frequencies(docs: DataFrame) -> dict[str, int]:
    """How often each character of the widest alphabet stands in all texts."""
    chars = ENCODINGS[-1]
    size = F.octet_length("text")
    found = docs.agg(*[F.sum((size - F.octet_length(F.replace("text", F.lit(c), F.lit("")))).cast("long")).alias(f"c{i}") for i, c in enumerate(chars)]).first()
    return {c: found[i] or 0 for i, c in enumerate(chars)}


def _equal_pairs(counts: dict[str, int]) -> list[tuple[float, float]]:
    """For each alphabet, the chance that two ordinary characters are equal, and that three are; never below uniform ones.

    In an alphabet of one case a letter counts in both: words in capitals have the letters of other words.
    """
    out = []
    for alphabet in ENCODINGS:
        one_case = alphabet in (alphabet.lower(), alphabet.upper())
        own = [sum(counts[x] for x in ({c.lower(), c.upper()} if one_case else {c})) for c in alphabet]
        total, k = sum(own), len(alphabet)
        two, three = (sum((n / total) ** e for n in own) if total else 0.0 for e in (2, 3))
        two = max(two, 1 / k)
        out.append((two, max(three, two * two)))
    return out


def tests(token: Column, ordinary: list[tuple[float, float]]) -> Column:
    """bits, battery (p-value of randomness) and p (of so few equal pairs in an ordinary run) of a candidate."""
    at = F.lit(len(ENCODINGS) - 1)
    for e in reversed(range(len(ENCODINGS) - 1)):
        at = F.when(F.translate(token, ENCODINGS[e], "") == "", e).otherwise(at)
    pick = lambda values, e: F.get(F.array(*[F.lit(v) for v in values]), e)
    size = [len(a) for a in ENCODINGS]
    halves = ["0" * (k // 2) + "1" * (k // 2) for k in size]
    held = let(at, lambda e: F.struct(
        pick(ENCODINGS, e).alias("alphabet"), pick(size, e).cast("double").alias("k"), pick(halves, e).alias("halves"), F.length(token).cast("double").alias("n"),
        pick([x for x, _ in ordinary], e).alias("two"), pick([x for _, x in ordinary], e).alias("three")))
    number = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    without = lambda s, part: F.length(s) - F.length(F.replace(s, part, F.lit("")))

    def counted(x: Column) -> Column:
        counts = F.transform(F.split(x["alphabet"], ""), lambda c: without(token, c))
        halved = F.call_function("translate", token, x["alphabet"], x["halves"])
        changes = let(halved, lambda b: (without(b, F.lit("01")) + without(b, F.lit("10"))) / 2)
        places = F.transform(F.split(token, ""), lambda c: 2 * F.instr(x["alphabet"], c) - x["k"].cast("int") - 1)  # twice the distance from the middle
        serial = let(places, lambda y: number(F.transform(y, lambda v, i: F.coalesce(v * F.get(y, i + 1), F.lit(0)).cast("long"))))
        squares = number(F.transform(counts, lambda c: (c * c).cast("long")))
        return F.struct(*[x[c].alias(c) for c in ("k", "n", "two", "three")], squares.cast("double").alias("squares"), changes.cast("double").alias("changes"), serial.cast("double").alias("serial"))

    def measured(y: Column) -> Column:
        k, n, two, three = y["k"], y["n"], y["two"], y["three"]
        even = (k * y["squares"] / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        runs = (y["changes"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = y["serial"] / ((k * k - 1) / 3) / F.sqrt(n - 1)
        pairs, spread = (y["squares"] - n) / 2, n * (n - 1) / 2 * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two)
        fewer = (pairs - n * (n - 1) / 2 * two) / F.sqrt(spread)
        worst = F.greatest(F.abs(even), F.abs(runs), F.abs(serial))
        return F.struct((n * F.log2(k)).alias("bits"), F.least(6 * tail(worst), F.lit(1.0)).alias("battery"), F.greatest(tail(-fewer), F.lit(1e-290)).alias("p"))

    return let(let(held, counted), measured)


def threshold(candidates: DataFrame, fdr: float) -> int | None:
    """The least step whose p-values are all finds; None where there is none. ``candidates``: different ones, with step.

    A step b has weighted p-values of at most 2 ** (-b / STEPS); as many as reach it, of all, must be ``1 / fdr`` times that share at least.
    """
    steps = candidates.groupBy("step").agg(F.count("*").alias("n")).collect()  # a row a step, MOST_STEPS at most
    total, so_far, found = sum(r.n for r in steps), 0, None
    for r in sorted(steps, key=lambda r: -r.step):
        so_far += r.n
        if 2.0 ** (-r.step / STEPS) * total <= fdr * so_far:
            found = r.step
    return found


def scan_secrets(docs: DataFrame, fdr: float = 0.01, alpha: float = 0.001, least_bits: float = 64.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of start, kind and end (code points, end exclusive) by start, then kind as in KINDS, of every row.

    Kinds are places in KINDS; kind 3 are candidates that the tests find, those that overlap a base span left out. Null texts are
    empty and have no spans; rows of one id or without an id each have their own; equal candidates count once in the control of false finds and
    are found everywhere. An empty table stays empty; other columns are left out.
    """
    docs = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    ordinary = _equal_pairs(frequencies(docs))
    seen = docs.select("doc_id", "text", base_spans(F.col("text")).alias("base"), matches(F.col("text"), CANDIDATE).alias("runs"))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    told = F.transform(free, lambda r: let(tests(r["token"], ordinary), lambda t: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.xxhash64(r["token"]).alias("token"), t["bits"].alias("bits"), t["battery"].alias("battery"), t["p"].alias("p"))))
    seen = saved(seen.select("doc_id", "base", told.alias("runs")), "secret-runs")
    each = seen.select(F.explode("runs").alias("r")).select("r.token", "r.bits", "r.p").groupBy("token").agg(F.first("bits").alias("bits"), F.first("p").alias("p"))
    mean = each.agg(F.avg("bits")).first()[0] or 1.0

    def step(bits: Column, p: Column) -> Column:
        return F.least(F.greatest(F.floor(-STEPS * F.log2(p * mean / bits)), F.lit(0)), F.lit(MOST_STEPS)).cast("int")

    least = threshold(each.select(step(F.col("bits"), F.col("p")).alias("step")), fdr)
    found = F.filter("runs", lambda r: F.lit(least is not None) & (r["bits"] >= least_bits) & (r["battery"] >= alpha) & (step(r["bits"], r["p"]) >= F.lit(least or 0)))
    found = F.transform(found, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), r["end"].alias("end")))
    return seen.select("doc_id", F.array_sort(F.concat("base", found)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
