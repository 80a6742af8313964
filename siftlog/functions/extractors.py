"""Extractors as table functions: for what no column expression can state, rows out of each text by Arrow batches.

``with_rows`` joins a table function laterally: the text goes to Python in Arrow batches and each of its rows comes back
beside the columns of its line. Where a column form exists (``fields.field_bag``), it is the faster one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.functions.fields import JSON_FIELD, KV_FIELD, MOST_PLACES, MOST_VALUE


@dataclass(frozen=True)
class Extractor:
    """The rows of one text, as tuples, and their schema."""

    rows: Callable[[str], Iterator[tuple]]
    schema: str


def _named(text: str) -> Iterator[tuple[str, str]]:
    seen = set()
    for prefix, pattern in (("json:", JSON_FIELD), ("kv:", KV_FIELD)):
        for m in re.finditer(pattern, text):
            axis = prefix + m.group(1)
            if axis not in seen:
                seen.add(axis)
                yield axis, "".join(g or "" for g in m.groups()[1:])


def field_bag(text: str) -> Iterator[tuple[str, str]]:
    """axis and value as ``fields.field_bag`` has them."""
    yield from _named(text)
    cells = text.split("|")
    for prefix, parts in (("pipe:", cells if len(cells) > 3 else []), ("ws:", re.split(r"[ \t\n\x0b\f\r]+", text))):
        parts = [p for p in parts if p] if prefix == "ws:" else parts
        for i, part in enumerate(parts[:MOST_PLACES]):
            if 1 <= len(part.strip(" ")) <= MOST_VALUE:
                yield f"{prefix}{i}", part.strip(" ")


_CLOSES = {")": "(", "]": "[", "}": "{"}


def brackets(text: str) -> Iterator[tuple[int, str]]:
    """Place and text of the outermost groups of balanced brackets; one that is never closed hides none that is inside."""
    open_: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        if c in "([{":
            open_.append((c, i))
        elif c in _CLOSES and open_ and open_[-1][0] == _CLOSES[c]:
            begin = open_.pop()[1]
            while found and found[-1][0] > begin:
                found.pop()
            found.append((begin, i + 1))
        elif c in _CLOSES:
            open_.clear()
    for begin, end in found:
        yield begin, text[begin:end]


FIELD_BAG = Extractor(field_bag, "axis string, value string")
BRACKETS = Extractor(brackets, "at int, part string")


def with_rows(df: DataFrame, extractor: Extractor, text: str) -> DataFrame:
    """The rows of ``df``, each once for every row that the extractor finds in its text; null texts have none."""

    class Extract:
        def eval(self, value: str) -> Iterator[tuple]:
            if value is not None:
                yield from extractor.rows(value)

    return df.lateralJoin(F.udtf(Extract, returnType=extractor.schema, useArrow=True)(F.col(text).outer()))
