"""Vectorised helpers on UTF-8 buffers for use inside Arrow tasks: rolling hashes, words, sets.

Every helper works on whole documents; a buffer holds several documents end to end and ``offsets`` marks
their bounds. Hashes are 64 bits wide: sums of ``table[byte] * base ** i`` modulo 2**64, shifted to position
0 by the inverse base and mixed. Equal byte strings always hash equal.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
TABLE = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for the worker's next batches while they are small."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        up, down = (np.full(size, U(b & (1 << 64) - 1)) for b in (BASE, INVERSE))
        up[0] = down[0] = U(1)
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 21:
            return up[:n], down[:n]
        _powers.update(up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h *= U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    h ^= h >> U(33)
    return h


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): the hash of data[i:j] before mixing is ``(sums[j] - sums[i]) * down[i]``."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(TABLE[data] * up[:-1], out=sums[1:])
    return sums, down


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Of every q-byte string of the buffer, by its start."""
    if len(data) < q:
        return np.zeros(0, U)
    sums, down = prefix_sums(data)
    return mix((sums[q:] - sums[:-q]) * down[: len(data) - q + 1])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column without copies; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int = 1 << 20):
    """Runs (i, j) of whole documents of about ``most`` bytes, to bound the memory of a pass; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of bytes other than ASCII white space; runs never cross documents."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    first[edge] = word[edge]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = edge[edge > 0]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, down = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the sorted distinct word shingles of document i are ``hashes[bounds[i]:bounds[i + 1]]``.

    A document of fewer words has its whole sequence as its only shingle; one without words has none.
    """
    docs = len(offsets) - 1
    starts, ends, doc = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=docs)
    full = np.maximum(count - size + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(docs), full)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) + begin[owner]
    out = np.minimum(count, size)[owner].astype(U)
    for k in range(size):
        there = k < count[owner]
        out = mix(out * U(0xD6E8FEB86659FD93) + np.where(there, h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else 0, U(0)) + there.astype(U))
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=docs)))), out


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers are reused, and each would keep its own peak."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
