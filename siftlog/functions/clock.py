"""Clocks in log lines: which time shape a text shows, and its reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seven time shapes in order of preference; the group holds the hour where there is one.
TIME_SHAPES = {
    "iso": r"\d{4}[-/]\d{2}[-/]\d{2}[T ](\d{2}):\d{2}:\d{2}",
    "dmy": r"\d{2}\.\d{2}\.\d{4} (\d{2}):\d{2}:\d{2}",
    "bsd": r"[A-Z][a-z]{2} +\d{1,2} (\d{2}):\d{2}:\d{2}",
    "clf": r"\d{2}/[A-Za-z]{3}/\d{4}:(\d{2}):\d{2}:\d{2}",
    "compact": r"\|(\d{2})\d{4}\.\d{3}\|",
    "epoch": r"(?<![0-9.eE+-])(\d{10}(?:\.\d{1,9})?|\d{13}|\d{16})(?![0-9])",
    "clock": r"(?<![0-9:.])(\d{2}):\d{2}:\d{2}",
}
#: The years 2000 to 2100 as epoch seconds.
EPOCH_LOW, EPOCH_HIGH = 946684800, 4102444800


def shape_of(text: Column) -> Column:
    """The first time shape that the text shows; null without one."""
    out = F.lit(None).cast("string")
    for name in reversed(TIME_SHAPES):
        out = F.when(text.rlike(TIME_SHAPES[name]), name).otherwise(out)
    return out


def epoch_seconds(raw: Column) -> Column:
    """Epoch text in seconds, milliseconds or microseconds (by its digits before a point); null outside 2000 to 2100."""
    digits = F.length(F.substring_index(raw, ".", 1))
    v = F.when(digits == 10, raw.cast("double")).when(digits == 13, raw.cast("double") / 1e3).when(digits == 16, raw.cast("double") / 1e6)
    return F.when((v >= EPOCH_LOW) & (v <= EPOCH_HIGH), v)


def clock(text: Column) -> Column:
    """The reading as a timestamp in the session's time zone; offsets aren't applied. Shapes without a date or a year give null."""
    return F.timestamp_seconds(F.coalesce(*[reading(text, s) for s in ("iso", "dmy", "clf", "epoch")]))


#: The parts of the dated shapes, in the order that their pattern captures them; month names.
_DATED = {
    "iso": (r"(\d{4})[-/](\d{2})[-/](\d{2})[T ](\d{2}):(\d{2}):(\d{2})", "yMdhms"),
    "dmy": (r"(\d{2})\.(\d{2})\.(\d{4}) (\d{2}):(\d{2}):(\d{2})", "dMyhms"),
    "clf": (r"(\d{2})/([A-Za-z]{3})/(\d{4}):(\d{2}):(\d{2}):(\d{2})", "dNyhms"),
    "compact": (r"(\d{4})(\d{2})(\d{2})\|(\d{2})(\d{2})(\d{2})\.\d{3}\|", "yMdhms"),
}
_OF_DAY = {"bsd": r"[A-Z][a-z]{2} +\d{1,2} (\d{2}):(\d{2}):(\d{2})", "compact": r"\|(\d{2})(\d{2})(\d{2})\.\d{3}\|", "clock": r"(?<![0-9:.])(\d{2}):(\d{2}):(\d{2})"}
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _month(name: Column) -> Column:
    """The number of a month's name; null for another word."""
    at = F.instr(F.lit(_MONTHS), F.lower(name))
    return F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def reading(text: Column, shape: str) -> Column:
    """Seconds since 1970 of a dated shape's first stamp, without its offset; null without one or outside the calendar."""
    if shape == "epoch":
        return epoch_seconds(F.nullif(F.regexp_extract(text, TIME_SHAPES["epoch"], 1), F.lit("")))
    pattern, parts = _DATED[shape]
    p = {k: F.regexp_extract(text, pattern, i + 1) for i, k in enumerate(parts)}
    v = {k: _month(c) if k == "N" else F.nullif(c, F.lit("")).cast("int") for k, c in p.items()}
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", v["y"], v.get("M", v.get("N")), v["d"]), "yyyy-MM-dd")
    return F.when(p["y"] != "", F.unix_date(day).cast("double") * 86400 + v["h"] * 3600 + v["m"] * 60 + v["s"])


def second_of_day(text: Column, shape: str) -> Column:
    """Seconds of the day of a stamp that names no date or no year; null without one."""
    h, m, s = (F.nullif(F.regexp_extract(text, _OF_DAY[shape], g), F.lit("")).cast("int") for g in (1, 2, 3))
    return (h * 3600 + m * 60 + s).cast("double")


def yearless(text: Column) -> Column:
    """A number that rises with month, day and time of a stamp without a year; null without one."""
    p = [F.regexp_extract(text, r"([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}):(\d{2}):(\d{2})", g) for g in range(1, 6)]
    n = [F.nullif(c, F.lit("")).cast("int") for c in p[1:]]
    return ((_month(p[0]) * 31 + n[0]) * 86400 + n[1] * 3600 + n[2] * 60 + n[3]).cast("double")


def order_key(text: Column, shape: str) -> Column:
    """What readings of one shape are ordered by: their own date where they have one."""
    if shape == "bsd":
        return yearless(text)
    if shape == "clock":
        return second_of_day(text, shape)
    dated = reading(text, shape)
    return F.coalesce(dated, second_of_day(text, shape)) if shape == "compact" else dated


def offset_seconds(text: Column) -> Column:
    """The offset that the first dated stamp with a zone states, 0 without one."""
    p = [F.regexp_extract(text, r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)? ?([+-])(\d{2}):?(\d{2})", g) for g in (1, 2, 3)]
    n = [F.nullif(c, F.lit("")).cast("int") for c in p[1:]]
    return F.coalesce(F.when(p[0] == "-", -1).otherwise(1) * (n[0] * 3600 + n[1] * 60), F.lit(0))


def hour_of(text: Column) -> Column:
    """Hour of day shown by the widest shape; null without a clock."""
    out = F.lit(None).cast("int")
    for name in reversed([n for n in TIME_SHAPES if n != "epoch"]):
        got = F.regexp_extract(text, TIME_SHAPES[name], 1)
        out = F.when(got != "", got.try_cast("int") if hasattr(got, "try_cast") else got.cast("int")).otherwise(out)
    return out


#: Six stamps as they are written, in order of preference.
STAMPS = {
    "iso": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    "clf": r"\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}",
    "logcat": r"\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}",
    "bsd-syslog": r"[A-Z][a-z]{2} [ \d]?\d \d{2}:\d{2}:\d{2}",
    "epoch-ms": r"(?<![0-9.])1[0-9]{12}(?![0-9])",
    "time-only": r"(?<![0-9:])\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?![0-9])",
}


def raw_stamp(text: Column) -> Column:
    """The first stamp as it is written, of six shapes tried in order; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"({s})", 1), F.lit("")) for s in STAMPS.values()])


def clock_gap(a: Column, b: Column, around: int = 86400) -> Column:
    """Seconds between two times of day, the shortest way round the dial."""
    d = F.pmod(a - b, F.lit(around))
    return F.least(d, F.lit(around) - d)
