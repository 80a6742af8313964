"""Tracing a table of identifiers through records, by an inverted index of their tokens.

An identifier's parts may be joined by one separator or none, in any case, with no ASCII letter or digit beside it. So a
record that holds it has a run of neighbouring tokens that, joined, are the identifier's own letters and digits. Hashes of all
runs of the lengths that occur meet those of the identifiers by equality, so thousands of them cost one pass, and a token that
many identifiers share costs nothing; what meets is verified by the identifier's own pattern.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.functions.clock import raw_stamp
from siftlog.operators.scan import BLOCK
from siftlog.work import saved

#: What may join the parts of an identifier, in it and in texts; how much of a sample is shown.
PARTED, JOINT = r"[-_.\s]+", "[-_.:/]?"
MOST_SAMPLE = 220
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most so many bits, as a power of two, tell which runs can't be an identifier: 16 MB, for any number of them.
MOST_BITS = 27
_PRIME, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: Letters and digits in lower case, anything else 0.
_CODE = np.array([ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 0 for i in range(256)], np.uint8)


def lowered(text: Column) -> Column:
    """ASCII letters in lower case; others stay, for some have an ASCII letter below them."""
    return F.translate(text, _UPPER, _LOWER)


def _parts(id_: Column) -> Column:
    return F.filter(F.split(id_, PARTED), lambda p: p != "")


def pattern_of(id_: Column) -> Column:
    """The identifier's pattern, each part quoted."""
    quoted = F.transform(_parts(id_), lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), F.array_join(quoted, JOINT), F.lit("(?![A-Za-z0-9])"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _windows(texts: pa.Array, lengths: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row and the hash of each run of so many neighbouring tokens of a text, tokens joined; by sums over the letters and digits."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    code = _CODE[data]
    at = np.flatnonzero(code)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))[at]
    first = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(of) > 0))) if len(at) else at
    end, row = np.append(first[1:], len(at)), of[first]
    sums = np.append(np.uint64(0), np.cumsum(code[at].astype(np.uint64) * _powers(_PRIME, len(at))[: len(at)]))
    back = _powers(pow(_PRIME, -1, 1 << 64), len(at))[first]
    for n in lengths:
        i = np.arange(max(0, len(first) - n + 1))
        i = i[row[i] == row[i + n - 1]]
        h = (sums[end[i + n - 1]] - sums[first[i]]) * back[i]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        yield row[i], h ^ (h >> np.uint64(29))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: ``h``, the hash of ``joined``, which is one token."""
    for b in batches:
        (_, h), = _windows(b["joined"], [1])
        yield b.append_column("h", pa.array(h.view(np.int64)))


def _meeting(bits: Broadcast, lengths: list[int]):
    """Arrow task: each record with ``h``, once for each hash of its runs of tokens that the bits let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            rows, hashes = [], []
            for row, h in _windows(b["text"], lengths):
                at = h & np.uint64(8 * len(kept) - 1)
                passed = (kept[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                rows.append(row[passed])
                hashes.append(h[passed])
            row, h = np.concatenate(rows), np.concatenate(hashes)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.append(True, (np.diff(row) > 0) | (h[1:] != h[:-1])) if len(row) else np.zeros(0, bool)
            yield b.take(pa.array(row[new])).append_column("h", pa.array(h[new].view(np.int64)))

    return run


def candidates(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records with the ``id`` and ``pattern`` of each identifier whose tokens, joined, stand in them as a run of neighbours; compared by hash."""
    tokens = lambda joint: F.regexp_extract_all(lowered(F.array_join(_parts(F.col("id")), joint)), F.lit("[a-z0-9]+"), F.lit(0))
    index = ids.select("id").distinct().select("id", pattern_of(F.col("id")).alias("pattern"), tokens("\x01").alias("t"), F.size(tokens("")).alias("least"))
    index = index.where(F.size("t") > 0).select("id", "pattern", "least", F.size("t").alias("most"), F.array_join("t", "").alias("joined"))
    index = saved(index.mapInArrow(_named, f"{_ddl(index)}, h long"), "id-index")  # its size is known: broadcast only if it is small
    lengths = sorted(r.n for r in index.select(F.explode(F.sequence("least", "most")).alias("n")).distinct().collect())
    size = 1 << min(MOST_BITS, max(15, (64 * index.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(size - 1))
    parts = index.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    bits = bytearray(size // 8)
    for r in parts.toLocalIterator():
        bits[4096 * r.part : 4096 * (r.part + 1)] = r.bits
    met = records.mapInArrow(_meeting(records.sparkSession.sparkContext.broadcast(bytes(bits)), lengths or [1]), f"{_ddl(records)}, h long")
    return met.join(index.select("h", "id", "pattern"), "h").drop("h")


def id_hits(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records (path, line_start, line_end, text) with the ``id`` of each identifier that they hold.

    ``ids`` has a column id; repeated ones count once, null ones and those without an ASCII letter or digit are found nowhere.
    """
    return candidates(records, ids).where(F.expr("rlike(text, pattern)")).drop("pattern")


def first_rows(rows: DataFrame, keys: list[str], order: str, keep: int, block: int = BLOCK) -> DataFrame:
    """The first ``keep`` rows of each key: first of each block of ``order``, then of what the blocks kept, so no key is sorted whole."""
    inside = W.partitionBy(*keys, F.floor(F.col(order) / block)).orderBy(order)
    kept = rows.withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= keep)
    return kept.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= keep).drop("_r")


def firsts(rows: DataFrame, keys: list[str], order: list[str], keep: int, spread: int = 1024) -> DataFrame:
    """The first ``keep`` rows of each key in ``order``: first of each of ``spread`` hash buckets, then of what these kept."""
    kept = rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys, F.pmod(F.xxhash64(*order), F.lit(spread))).orderBy(*order))).where(F.col("_r") <= keep)
    return kept.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= keep).drop("_r")


def trace(records: DataFrame, ids: DataFrame, keep: int = 20, samples: int = 3) -> DataFrame:
    """id, path, n, refs, samples, first_ts, last_ts, truncated of each identifier in each file that has it.

    n counts all records; refs are the first ``keep`` of them as ``line`` or ``line-line``, ``truncated`` tells that there are
    more. samples are the texts of the first ``samples``, cut at 220 characters. first_ts and last_ts are the first and the last stamp
    among the records, in order of lines, as they are written; null where none has one.
    """
    hits = saved(id_hits(records.select("path", "line_start", "line_end", "text"), ids), "id-hits")
    hits = hits.withColumn("stamp", raw_stamp(F.col("text")))
    at = F.when(F.col("stamp").isNotNull(), F.col("line_start"))
    counts = hits.groupBy("id", "path").agg(F.count("*").alias("n"), F.min_by("stamp", at).alias("first_ts"), F.max_by("stamp", at).alias("last_ts"))
    ref = F.concat(F.col("line_start"), F.when(F.col("line_end") > F.col("line_start"), F.concat(F.lit("-"), "line_end")).otherwise(""))
    first = first_rows(hits.select("id", "path", "line_start", ref.alias("ref"), F.substring(F.trim("text"), 1, MOST_SAMPLE).alias("sample")), ["id", "path"], "line_start", keep)
    shown = first.groupBy("id", "path").agg(F.array_sort(F.collect_list(F.struct("line_start", "ref", "sample"))).alias("f"))
    out = counts.join(shown, ["id", "path"])
    return out.select("id", "path", "n", F.transform("f", lambda x: x["ref"]).alias("refs"), F.transform(F.slice("f", 1, samples), lambda x: x["sample"]).alias("samples"), "first_ts", "last_ts", (F.col("n") > keep).alias("truncated"))
