"""Nested event records, several levels deep, as flat fields: JSON of system and event data, read as VARIANT.

Three sources, by how deep they lie: fields of the system part; event data, named or by place; ``key=value`` inside any
string of the event data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.functions.fields import ip_class

#: What is looked for inside strings, how long a value by place may be, fields that name an account.
PAIR = r"([A-Za-z][A-Za-z0-9_]{2,31})=([^\r\n\t]{0,120})"
CONSTANT = r"\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+){2,})\b"
QUOTED = r"'([^']{1,64})'"
ADDRESS = r"\b((?:\d{1,3}\.){3}\d{1,3})\b"
MOST_BY_PLACE = 120
ACCOUNTS = ("data.TargetUserName", "data.SubjectUserName", "kv.User", "kv.UserName")

_ENTRIES = "array<struct<field: string, value: string>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column) -> Column:
    """A string's value; null for anything else."""
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _entry(field: Column | str, value: Column) -> Column:
    return F.struct((F.lit(field) if isinstance(field, str) else field).alias("field"), value.alias("value"))


def _system(event: Column) -> Column:
    number = _at(event, "$.System.EventID")
    number = F.when(_is(number, "OBJECT"), _at(number, '$["#text"]')).otherwise(number)
    provider = F.try_variant_get(event, '$.System.Provider["#attributes"].Name', "string")
    named = {"provider": provider, "channel": _text(_at(event, "$.System.Channel")), "event_id": F.try_variant_get(number, "$", "string"), "computer": _text(_at(event, "$.System.Computer"))}
    found = F.array(*[_entry(n, c) for n, c in named.items()])
    return F.filter(found, lambda e: e["value"].isNotNull() & ((e["field"] != "provider") | (e["value"] != "")))


def _named(data: Column) -> Column:
    """Strings of an object, without names that begin with ``#``."""
    entries = F.transform(F.map_entries(F.try_variant_get(data, "$", "map<string,variant>")), lambda e: _entry(F.concat(F.lit("data."), e["key"]), _text(e["value"])))
    return F.when(_is(data, "OBJECT"), F.filter(entries, lambda e: e["value"].isNotNull() & ~e["field"].startswith("data.#")))


def positional(data: Column) -> Column:
    """The strings of event data by place: a list's, an object's ``#text``, or a lone string."""
    inner = F.when(_is(data, "OBJECT"), _at(data, '$["#text"]')).otherwise(data)
    many = F.filter(F.transform(F.try_variant_get(inner, "$", "array<variant>"), _text), lambda x: x.isNotNull())
    return F.coalesce(F.when(_is(inner, "ARRAY"), many).when(_is(inner, "STRING"), F.array(_text(inner))), F.array().cast("array<string>"))


def _pairs(strings: Column) -> Column:
    """The last value of each key of all strings, sorted by key."""
    each = lambda s: F.zip_with(F.regexp_extract_all(s, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(s, F.lit(PAIR), F.lit(2)), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    every = F.transform(F.flatten(F.transform(strings, each)), lambda e, i: F.struct(e["k"].alias("k"), (-i).alias("i"), e["v"].alias("v")))
    last = _let(F.array_sort(every), lambda s: F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"])))
    return F.transform(last, lambda e: _entry(F.concat(F.lit("kv."), e["k"]), F.regexp_replace(e["v"], r"^\s+|\s+$", "")))


def _parsed(df: DataFrame, row: str, text: str) -> DataFrame:
    """row, event, data, strings; an event may stand in an ``Event`` of its own."""
    v = df.select(F.col(row).alias("row"), F.try_parse_json(F.col(text)).alias("v"))
    v = v.select("row", F.coalesce(_at(F.col("v"), "$.Event"), F.col("v")).alias("event"))
    v = v.select("row", "event", _at(F.col("event"), "$.EventData.Data").alias("data"))
    return v.select("row", "event", "data", positional(F.col("data")).alias("strings"))


def _all_fields(df: DataFrame, row: str, text: str) -> DataFrame:
    parsed = _parsed(df, row, text)
    placed = F.transform("strings", lambda s, i: _entry(F.concat(F.lit("data["), i, F.lit("]")), s))
    placed = F.filter(placed, lambda e: F.length(e["value"]) <= MOST_BY_PLACE)
    none = F.array().cast(_ENTRIES)
    every = F.concat(F.coalesce(_system(F.col("event")), none), F.coalesce(_named(F.col("data")), none), placed, _pairs(F.col("strings")))
    return parsed.select("row", "event", "strings", every.alias("fields"))


def event_fields(df: DataFrame, row: str, text: str) -> DataFrame:
    """row, field, value of the JSON in ``text``: system fields, ``data.name``, ``data[i]`` and ``kv.key``.

    Strings by place are numbered among the strings only, and shown up to 120 characters; of a key that stands more than
    once the last value counts. Texts that are no JSON, or name one member twice, have no fields.
    """
    # Of a plain explode Spark would infer that there are fields, and work them out, parsing included, to ask that before it works them out.
    f = _all_fields(df, row, text).select("row", F.explode_outer("fields").alias("f")).where("f is not null")
    return f.select(F.col("row").alias(row), "f.field", "f.value")


def event_facts(df: DataFrame, row: str, text: str) -> DataFrame:
    """row, at, record, strings (how many), constants, accounts and peers of each event, lists sorted; a row for every text.

    constants are NAMES_OF_THREE_WORDS or more, accounts what stands in single quotes without a space or in a field that names one, peers
    global addresses, all from strings by place.
    """
    parsed = _all_fields(df, row, text)
    every = lambda pattern: F.flatten(F.transform("strings", lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(1))))
    named = F.transform(F.filter("fields", lambda e: e["field"].isin(*ACCOUNTS) & (e["value"] != "")), lambda e: e["value"])
    accounts = F.concat(F.filter(every(QUOTED), lambda q: ~F.contains(q, F.lit(" "))), named)
    whole = lambda ip: F.forall(F.split(ip, r"\."), lambda x: (x.cast("int") <= 255) & ((x == "0") | ~x.startswith("0")))
    peers = F.filter(F.array_distinct(every(ADDRESS)), lambda ip: whole(ip) & (ip_class(ip) == "global"))
    at = F.try_variant_get(F.col("event"), '$.System.TimeCreated["#attributes"].SystemTime', "string")
    record = F.try_variant_get(F.col("event"), "$.System.EventRecordID", "string")
    lists = {"constants": every(CONSTANT), "accounts": accounts, "peers": peers}
    return parsed.select(F.col("row").alias(row), at.alias("at"), record.alias("record"), F.size("strings").alias("strings"), *[F.array_sort(F.array_distinct(c)).alias(n) for n, c in lists.items()])
