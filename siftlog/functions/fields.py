"""Fields, words, addresses, citations and paths found in texts without per-format parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field shapes and the caps on what they read.
JSON_FIELD = r'"([A-Za-z_][A-Za-z0-9_]{0,30})"\s*:\s*(?:"([^"\\]{1,24})"|(-?\d{1,6}(?:\.\d{1,6})?)|(true|false))'
KV_FIELD = r"(?<![\w\-])([A-Za-z_\u0400-\u04FF][\w\u0400-\u04FF]{0,30})=([^\s|,;'\"]{1,24})"
MOST_PLACES, MOST_VALUE = 12, 24
#: Sixteen severity words.
SEVERITIES = ("EMERG", "ALERT", "FATAL", "CRITICAL", "CRIT", "PANIC", "SEVERE", "ERROR", "ERR", "WARNING", "WARN", "NOTICE", "INFO", "DEBUG", "TRACE", "VERBOSE")


def _named(text: Column, pattern: str, prefix: str, value: Column | None = None) -> Column:
    keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = value if value is not None else F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(keys, values, lambda k, v: F.struct(F.concat(F.lit(prefix), k).alias("axis"), v.alias("value")))


def field_bag(text: Column) -> Column:
    """array<struct<axis, value>>: JSON and key=value fields, cells between three bars or more, words by place; the first of an axis wins."""
    groups = [F.regexp_extract_all(text, F.lit(JSON_FIELD), F.lit(g)) for g in (2, 3, 4)]
    json_value = F.zip_with(F.zip_with(groups[0], groups[1], lambda a, b: F.concat(a, b)), groups[2], lambda a, b: F.concat(a, b))

    def places(cells: Column, prefix: str) -> Column:
        cells = F.transform(F.slice(cells, 1, MOST_PLACES), lambda c, i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("axis"), F.trim(c).alias("value")))
        return F.filter(cells, lambda p: F.length(p["value"]).between(1, MOST_VALUE))

    bars = F.when(F.size(F.split(text, r"\|", -1)) > 3, places(F.split(text, r"\|", -1), "pipe:")).otherwise(F.array().cast("array<struct<axis:string,value:string>>"))
    words = places(F.filter(F.split(text, r"\s+", -1), lambda w: w != ""), "ws:")
    # Places and bars have each axis once; of named fields the first of an axis stays.
    named = F.concat(_named(text, JSON_FIELD, "json:", json_value), _named(text, KV_FIELD, "kv:"))
    first = F.filter(named, lambda p, i: F.array_position(F.transform(named, lambda q: q["axis"]), p["axis"]) == i + 1)
    return F.concat(F.when(F.size(F.array_distinct(F.transform(named, lambda q: q["axis"]))) < F.size(named), first).otherwise(named), bars, words)


def extract_axis(text: Column, axis: str) -> Column:
    """The value of one axis of ``field_bag``, read without the others; null where it is missing."""
    kind, _, name = axis.partition(":")
    if kind == "kv":
        got = F.regexp_extract(text, rf"(?<![\w\-]){name}=([^\s|,;'\"]{{1,24}})", 1)
    elif kind == "json":
        got = F.regexp_extract(text, rf'"{name}"\s*:\s*"?([^",}}]{{1,24}})', 1)
    else:
        cells = F.split(text, r"\|", -1) if kind == "pipe" else F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
        got = F.trim(F.get(cells, F.lit(int(name))))
        got = F.when(F.length(got) <= MOST_VALUE, got)
    return F.nullif(got, F.lit(""))


def kv_pairs(text: Column, most: int = 24) -> Column:
    """The first ``most`` distinct key=value strings, sorted by place."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w{0,30}=[^\s|,;'\"]{1,24})"), F.lit(1))), 1, most)


def severity_words(text: Column) -> Column:
    """Distinct severity words of a line, in capitals."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(rf"\b({'|'.join(SEVERITIES)})\b"), F.lit(1)))


def vocabulary(text: Column) -> Column:
    """Words of 3 to 12 capital letters."""
    return F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_\-])([A-Z]{3,12})(?![A-Za-z0-9_\-])"), F.lit(1))


def const_tokens(text: Column) -> Column:
    """Distinct NAMES_WITH_UNDERSCORES."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"), F.lit(1)))


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 as an integer."""
    p = F.split(ip, r"\.")
    return sum((F.get(p, F.lit(i)).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.get(p, F.lit(0)).cast("long") * 256**3)


#: IPv4 blocks that aren't globally routable, as first address and length of the prefix.
LOCAL_BLOCKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3))


def _block(number: Column, first: str, bits: int) -> Column:
    low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(first.split(".")))
    return number.between(low, low + (1 << 32 - bits) - 1)


def ip_class(ip: Column) -> Column:
    """``shared`` for 100.64.0.0/10, else ``local`` or ``global``."""
    n = ip_number(ip)
    local = F.lit(False)
    for first, bits in LOCAL_BLOCKS:
        local = local | _block(n, first, bits)
    return F.when(_block(n, "100.64.0.0", 10), "shared").when(local, "local").otherwise("global")


def measure_line(text: Column) -> Column:
    """struct<longest, codes, addresses>: the longest word's length, distinct standalone codes 100 to 599, distinct addresses."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|\s)([1-5]\d\d)(?=\s|$)"), F.lit(1)))
    addresses = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"), F.lit(1)))
    longest = F.coalesce(F.array_max(F.transform(F.split(text, r"\s+", -1), F.length)), F.lit(0))
    return F.struct(longest.cast("long").alias("longest"), codes.alias("codes"), addresses.alias("addresses"))


#: Fixed value: an address in a text.
CITATION = r"([\w./\-]+\.\w+):(\d+)(?:-(\d+))?"


def citations(text: Column) -> Column:
    """array<struct<path, line_lo, line_hi>> of ``path:line`` and ``path:line-line`` in a text."""
    path, low, high = (F.regexp_extract_all(text, F.lit(CITATION), F.lit(g)) for g in (1, 2, 3))
    joined = F.arrays_zip(path.alias("path"), low.alias("low"), high.alias("high"))
    return F.transform(joined, lambda p: F.struct(p["path"].alias("path"), p["low"].cast("long").alias("line_lo"), F.when(p["high"] != "", p["high"].cast("long")).otherwise(p["low"].cast("long")).alias("line_hi")))


#: A table row; a cell that names a file; a cell that is a line number.
TABLE_ROW, FILE_CELL, NUMBER_CELL = r"^\s*\|(?:[^|]*\|){2,}", r"^[\w./\-]+\.\w+$", r"^\d{1,9}$"


def table_citations(text: Column) -> Column:
    """array<struct<path, line_lo, line_hi, claim>> of the rows of tables: the first cell that is a file, the first number beside it, the rest as the claim.

    A row has three bars or more and begins with one; rows of dashes are none, nor are rows that lack either cell.
    """
    rows = F.filter(F.split(text, r"\r?\n", -1), lambda r: r.rlike(TABLE_ROW) & ~r.rlike(r"^[\s|:\-]*$"))
    cells = lambda r: F.transform(F.split(F.regexp_replace(F.trim(r), r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c))
    place = lambda cs, pattern: F.array_position(F.transform(cs, lambda c: c.rlike(pattern)), F.lit(True)).cast("int")

    def cited(cs: Column) -> Column:
        file, number = place(cs, FILE_CELL), place(cs, NUMBER_CELL)
        line = F.get(cs, number - 1).try_cast("long")
        claim = F.array_join(F.filter(cs, lambda _, i: (i != file - 1) & (i != number - 1)), " ")
        return F.when((file > 0) & (number > 0), F.struct(F.get(cs, file - 1).alias("path"), line.alias("line_lo"), line.alias("line_hi"), claim.alias("claim")))

    return F.array_compact(F.flatten(F.transform(rows, lambda r: F.transform(F.array(cells(r)), cited))))


#: Quoted spans.
QUOTES = (r'"([^"\n]{4,400})"', r"«([^»\n]{4,400})»", r"“([^”\n]{4,400})”", r"`([^`\n]{4,400})`")


def quoted_spans(text: Column) -> Column:
    """Spans of 4 to 400 characters between quotes, backticks or angle quotes."""
    return F.filter(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in QUOTES])), lambda s: s != "")


#: Words that carry no evidence.
STOP_WORDS = tuple(
    """
the a an and or of in on at to for from by with is are was were it this that as not but has have had be been will would can could
should there their they them then than out into over under after before all any some such no nor only own same too very just now
here when what which who whom why how
и в во на с со по что как из для это эта эти этот был была было были при его её их но же то так все всё уже или если бы не да мы
он она они там тут когда чтобы после перед над под между около него неё них
""".split()
)
CYRILLIC = r"[\x{400}-\x{4FF}]"


def token_set(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case words of three characters (Latin, Cyrillic, digits, underscores) and numbers of two digits, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9a-z_\x{400}-\x{4FF}]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop) & (F.length(w) >= F.when(w.rlike("^[0-9]+$"), 2).otherwise(3))))


def comparable(tokens: Column, line: Column) -> Column:
    """The tokens that a line's scripts could hold: numbers always, Cyrillic words only where it has such letters, others only beside Latin ones."""
    return F.filter(tokens, lambda w: w.rlike("^[0-9]+$") | F.when(w.rlike(CYRILLIC), line.rlike(CYRILLIC)).otherwise(line.rlike("[A-Za-z]")))


def word_count(tokens: Column) -> Column:
    """How many tokens aren't bare numbers."""
    return F.size(F.filter(tokens, lambda w: ~w.rlike("^[0-9]+$")))


def normalised(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def canon_id(text: Column) -> Column:
    """Letters and digits in lower case: one form for every way to join an identifier's parts."""
    return F.lower(F.regexp_replace(text, r"[-_.\s]+", ""))


def fingerprint(signatures: Column) -> Column:
    """Twelve hexadecimal digits of the sha-256 of the sorted normalised signatures."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.transform(signatures, normalised)), "\n"), 256), 1, 12)


def path_parts(path: Column) -> Column:
    """struct<host, dir, base, stem, rotation>."""
    base = F.element_at(F.split(path, "/", -1), -1)
    rotation = F.regexp_extract(base, r"((?:[.-]\d{1,8})*(?:\.gz)?)$", 1)
    return F.struct(F.substring_index(path, "/", 1).alias("host"), F.regexp_replace(path, "/?[^/]*$", "").alias("dir"), base.alias("base"), F.regexp_replace(base, r"(?:[.-]\d{1,8})*(?:\.gz)?$", "").alias("stem"), rotation.alias("rotation"))


#: Fixed value: a line that opens or closes a fenced block.
FENCE = r"(?md)^[^\S\n]*(?:```|~~~).*$"
_CUT = "\ue000\x00\ue000"


def text_blocks(text: Column) -> Column:
    """Paragraphs with white space squeezed, in order; empty ones are left out.

    A line of spaces and tabs ends a paragraph, but not between two fence lines: every other stretch between fences is
    inside, and after an open fence all the rest. Only outside are blank lines made cuts; then the text is put together again and cut.
    """
    text = F.concat(F.lit("\n"), F.replace(text, F.lit("\r\n"), F.lit("\n")))
    stretches, fences = F.split(text, FENCE, -1), F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    cut = lambda s, i: F.when(i % 2 == 0, F.regexp_replace(s, "\n[ \t]*(?=\n)", "\n" + _CUT)).otherwise(s)
    whole = F.array_join(F.zip_with(F.transform(stretches, cut), fences, lambda s, f: F.concat(s, F.coalesce(f, F.lit("")))), "")
    return F.filter(F.transform(F.split(whole, _CUT, -1), lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: b != "")
