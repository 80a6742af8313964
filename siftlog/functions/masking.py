"""Templates: a record with numbers, stamps, addresses and identifiers replaced in one pass from the left.

One replacement puts marks around all tokens of one alternation; each token is then classified between its marks by its own form
and the characters beside it, so nothing is matched out of place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlog.functions.clock import STAMPS

#: Token shapes, in order of preference where they begin together.
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
STAMP = (
    r"\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
    r"|\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
    r"|\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?"
    r"|[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}"
    r"|(?<![0-9:.])\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
)
ADDRESS = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
HEX = r"\b(?=[a-fA-F]*[0-9])[0-9a-fA-F]{8,}\b"
NUMBER = r"(?:(?<![A-Za-z0-9_])-)?\d+(?:\.\d+)?"
TOKEN = f"{UUID}|{STAMP}|{ADDRESS}|{HEX}|{NUMBER}"
MOST_SLOTS, MOST_CHARS = 10, 800
#: Marks around a token, noncharacters that texts hardly hold; and the kinds of tokens but numbers, in the order of ``_kind``.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
_MARKED = (
    (f"{_OPEN}[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[^{_CLOSE}]*{_CLOSE}", "<uuid>"),
    (rf"{_OPEN}[^{_CLOSE}]*:\d{{2}}:[^{_CLOSE}]*{_CLOSE}", "<T>"),
    (rf"{_OPEN}\d{{1,3}}(?:\.\d{{1,3}}){{3}}{_CLOSE}", "<ip>"),
    (f"(?<![A-Za-z0-9_]){_OPEN}[0-9a-fA-F]{{8,}}{_CLOSE}(?![A-Za-z0-9_])", "<hex>"),
)


def _kind(token: Column, before: Column, after: Column) -> Column:
    """A hex word must stand free of word characters on both sides; else its digits are a number."""
    free = ~before.rlike(r"[A-Za-z0-9_]\z") & ~after.rlike("^[A-Za-z0-9_]")
    return (
        F.when(token.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"), "<uuid>")
        .when(token.rlike(r":\d{2}:"), "<T>")
        .when(token.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "<ip>")
        .when(token.rlike("^[0-9a-fA-F]{8,}$") & free, "<hex>")
        .otherwise("#")
    )


def pieces(text: Column) -> Column:
    """array<struct<token, kind, before>>: each token, its placeholder and the literal before it."""
    text = F.substring(text, 1, MOST_CHARS)
    tokens, between = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.split(text, TOKEN, -1)
    joined = F.arrays_zip(tokens.alias("token"), between.alias("before"), F.slice(between, 2, F.size(between)).alias("after"))
    return F.transform(F.slice(joined, 1, F.size(tokens)), lambda p: F.struct(p["token"].alias("token"), _kind(p["token"], p["before"], p["after"]).alias("kind"), p["before"].alias("before")))


def _numbers_marked(text: Column) -> Column:
    """The text with placeholders for all tokens but numbers, which stand between marks."""
    # No token begins with another character, so most are passed over at once.
    out = F.regexp_replace(F.substring(text, 1, MOST_CHARS), f"(?=[0-9A-Za-f-])({TOKEN})", f"{_OPEN}$1{_CLOSE}")
    for pattern, put in _MARKED:
        out = F.regexp_replace(out, pattern, put)
    return out


def _unmarked(text: Column, plain: Column, otherwise: Column) -> Column:
    """``plain`` for texts without the marks' own characters."""
    return F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), otherwise).otherwise(plain)


def template(text: Column) -> Column:
    """The masked text; white space squeezed."""
    between = F.split(F.substring(text, 1, MOST_CHARS), TOKEN, -1)
    kinds = F.transform(pieces(text), lambda p: F.concat(p["before"], p["kind"]))
    by_pieces = F.concat(F.array_join(kinds, ""), F.element_at(between, -1))
    masked = _unmarked(text, F.regexp_replace(_numbers_marked(text), f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", "#"), by_pieces)
    return F.trim(F.regexp_replace(masked, r"\s{2,}|[^\S ]", " "))


#: How many characters of a template a line of the record has, and how many lines count.
MOST_OF_LINE, MOST_LINES = 180, 4


def capped_template(text: Column, lines: Column) -> Column:
    """The template of a record of so many lines, cut at 180 characters a line, of four lines at most."""
    return F.substring(template(text), F.lit(1), MOST_OF_LINE * F.least(F.greatest(lines, F.lit(1)), F.lit(MOST_LINES)).cast("int"))


def slots(text: Column) -> Column:
    """The first ten numbers, in order."""
    by_pieces = F.transform(F.filter(pieces(text), lambda p: p["kind"] == "#"), lambda p: p["token"])
    numbers = _unmarked(text, F.regexp_extract_all(_numbers_marked(text), F.lit(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}"), F.lit(1)), by_pieces)
    return F.slice(F.transform(numbers, lambda t: t.cast("double")), 1, MOST_SLOTS)


def glued(text: Column) -> Column:
    """For each slot, whether its digits belong to a longer name: a letter before, or one of ``-_/.`` after a letter or digit."""
    # A number right after another token continues it unless a literal stands between.
    return F.slice(F.transform(F.filter(pieces(text), lambda p: p["kind"] == "#"), lambda p: p["before"].rlike(r"(?:\p{L}|[\p{L}\p{N}][-_/.])$")), 1, MOST_SLOTS)


def actors(text: Column) -> Column:
    """The distinct addresses, in order."""
    return F.array_distinct(F.transform(F.filter(pieces(text), lambda p: p["kind"] == "<ip>"), lambda p: p["token"]))


#: A coarser mask, hex words of six, and how long a shape may be.
SHORT_HEX = r"\b(?=[0-9a-fA-F]{6,}\b)(?=[a-fA-F]*[0-9])[0-9a-fA-F]{6,}\b|\d+"
MOST_SHAPE = 180


def shape(text: Column) -> Column:
    """A coarser shape: stamps, uuids and addresses as placeholders, hex words of six and numbers as ``#``, white space squeezed."""
    stamps = "|".join(f"(?:{p})" for name, p in STAMPS.items() if name != "epoch-ms")
    for pattern, put in ((stamps, "<ts>"), (UUID, "<uuid>"), (ADDRESS, "<ip>"), (SHORT_HEX, "#")):
        text = F.regexp_replace(text, pattern, put)
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, MOST_SHAPE)


def slot_label(template_: Column, slot: Column) -> Column:
    """At most 14 characters before the slot's ``#`` (slots from 0)."""
    return F.right(F.get(F.split(template_, "#", -1), slot), F.lit(14))
