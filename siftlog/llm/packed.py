"""How often 64-bit identifiers occur over the whole corpus, with compact shuffles.

The corpus is dealt into chunks of whole documents (by a hash of the id). A chunk sends each distinct
identifier once, sorted, as differences, with its own count: one row for each range of identifiers that it
meets. One task for each range adds up the counts and answers each chunk in the order sent: with one byte per
identifier (see ``code``), or with the numbers of the buckets that equal identifiers form over the corpus, 0 for an
identifier that occurs once. The chunk, which finds its identifiers again from its texts, reads the
answers beside them. A frequent identifier costs each chunk one entry, so no range grows with its frequency.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

U = np.uint64
SENT = "part int, chunk int, ids binary, counts binary"
ANSWERED = "part int, chunk int, counts binary"


def squeeze(a: np.ndarray) -> bytes:
    """Byte planes, compressed: leading zero bytes of small numbers cost nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def distinct(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct leading bits, index of each id in them, counts)."""
    return np.unique(ids >> U(64 - bits), return_inverse=True, return_counts=True)


def cuts(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where the ranges begin in sorted keys; range k holds keys from k to k + 1 parts of the whole."""
    bounds = np.array([(k << bits) // parts for k in range(parts)], dtype=object)
    return np.concatenate((np.searchsorted(keys, bounds.astype(np.uint64)), [len(keys)]))


def sent(chunk: int, ids: np.ndarray, bits: int, parts: int) -> pa.Table:
    """The rows of a chunk, of schema SENT."""
    keys, _, n = distinct(ids, bits)
    n = np.minimum(n, 255).astype(np.uint8)
    at = cuts(keys, bits, parts)
    full = np.flatnonzero(np.diff(at))
    gaps = [np.diff(keys[at[k] : at[k + 1]], prepend=U(0)) for k in full]
    return pa.table(
        {
            "part": pa.array(full.astype(np.int32)),
            "chunk": pa.array(np.full(len(full), chunk, np.int32)),
            "ids": pa.array([squeeze(g) for g in gaps], pa.binary()),
            "counts": pa.array([squeeze(n[at[k] : at[k + 1]]) for k in full], pa.binary()),
        }
    )


def code(n: np.ndarray) -> np.ndarray:
    """Counts in one byte: exact below 128, then eighths of a doubling; larger counts never get a smaller code."""
    high = 128 + np.minimum(127, np.floor(8 * np.log2(np.maximum(n, 128) / 128)))
    return np.where(n < 128, n, high).astype(np.uint8)


def counted(rows: DataFrame, numbers: bool = False) -> DataFrame:
    """Answers, of schema ANSWERED, to rows of schema SENT: counts, or with ``numbers`` the ranks of repeated identifiers in their range, from 1."""

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["chunk"].to_pylist(), table["ids"].to_pylist(), table["counts"].to_pylist(), strict=True))
        ids = [np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64) for _, b, _ in rows]
        _, inverse = np.unique(np.concatenate(ids), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unsqueeze(c, np.uint8) for _, _, c in rows]))
        total = (np.cumsum(total > 1, dtype=np.uint32) * (total > 1).astype(np.uint32) if numbers else code(total))[inverse]
        ends = np.cumsum([len(x) for x in ids])
        return pa.table(
            {
                "part": pa.array([table["part"][0].as_py()] * len(rows), pa.int32()),
                "chunk": pa.array([c for c, _, _ in rows], pa.int32()),
                "counts": pa.array([squeeze(x) for x in np.split(total, ends[:-1])], pa.binary()),
            }
        )

    return rows.groupBy("part").applyInArrow(add, ANSWERED)


def answers(ids: np.ndarray, bits: int, table: pa.Table) -> np.ndarray:
    """The count, as ``code`` gives it, of each id of a chunk, from the rows that answer it."""
    return _answers(ids, bits, table, np.uint8)


def bucket_numbers(ids: np.ndarray, bits: int, table: pa.Table) -> np.ndarray:
    """The number of the bucket of each id of a chunk, the same in every chunk; 0 where the id is alone in it."""
    return _answers(ids, bits, table, np.uint32)


def _answers(ids: np.ndarray, bits: int, table: pa.Table, kind: type) -> np.ndarray:
    keys, inverse, _ = distinct(ids, bits)
    if not len(keys):
        return np.zeros(0, U if kind is np.uint32 else kind)
    got = [(part, unsqueeze(c, kind)) for part, c in sorted(zip(table["part"].to_pylist(), table["counts"].to_pylist(), strict=True))]
    if kind is np.uint32:  # the range's number, then the rank in it
        got = [(part, np.where(c > 0, (U(part) << U(32)) + c.astype(U), U(0))) for part, c in got]
    counts = np.concatenate([c for _, c in got])
    if len(counts) != len(keys):
        raise ValueError(f"{len(keys)} identifiers were sent and {len(counts)} answered")
    return counts[inverse]
