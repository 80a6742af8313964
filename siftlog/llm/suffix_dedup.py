"""Suffix-array dedup by bucket-pointer refinement: byte passages that occur more than once in the corpus go.

A sparse suffix array, kept as buckets of equal leading strings: of each ``length``-byte window only the suffix at its
minimizer (the leftmost least q-gram hash among the q-grams inside the window) stands for it in the first round, so equal
windows are always led by equal suffixes at equal distances. The initial identifier of every suffix is that of its
q-gram. Each round forms buckets from identifiers at later offsets, counts them over the corpus and gives each bucket of
two or more a number, which the next round reads in place of what it stands for; a suffix alone in its bucket is settled
(it repeats nowhere) and leaves:

1. suffixes at minimizers, to q bytes: the bucket is the q-gram;
2. suffixes at every ``step``-th distance before a surviving minimizer, to ``length - step + 1`` bytes, the common core of
   ``step`` windows: the bucket is the *number of round 1* at the minimizer's offset, with the identifiers of the q-grams
   that cover the rest, at offsets 0, q, 2q and the last;
3. windows, to ``length`` bytes: the bucket is the *number of round 2* at the offset of the window's core, with the q-grams at
   the window's start and end, which cover the bytes before and behind the core.

So a round's updates are reused by the next, and strings of q, then ``length - step + 1``, then ``length`` bytes are told apart.
Round 3 is exact over windows: numbers are exact names of buckets, q-grams are compared by 64-bit hashes. Buckets are
counted and numbered by ``packed``; the texts are shuffled once, by a hash of doc_id and digest, and exact copies of
a whole document are counted once and stand aside.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftlog.llm import packed
from siftlog.llm.bytetext import U, gram_hashes, mix, spans
from siftlog.llm.shared import chunks_for
from siftlog.llm.standing import answered, at_level, stand, standing_texts

#: Leading bits of the identifiers of each round that are counted; round 2 reads the text below the numbers of round 1 again, round 3 relies on those of round 2.
BITS = (44, 64, 64)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` keys."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _bucket(grams: np.ndarray, start: np.ndarray, offsets: list[int], number: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Identifiers of suffixes at ``start`` from the bucket number at a later ``distance`` and the q-grams at ``offsets``."""
    out = mix(number * U(0x8CB92BA72F3D8DD7) + distance.astype(np.uint64))
    for k in offsets:
        out = mix(out * U(0xD1342543DE82EF95) + grams[start + k])
    return out


class Slice:
    """One run of documents of a chunk; each round yields its identifiers in a fixed order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, q: int, step: int):
        self.data, self.offsets, self.length, self.q, self.step = data, offsets, length, q, step
        self.grams = gram_hashes(data, q)
        size = np.maximum(np.diff(offsets) - length + 1, 0)
        p = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[:-1], size)
        if not len(p):
            self.lead = self.first = self.last = np.zeros(0, np.int64)
            return
        keys = (self.grams >> U(32) << U(32)) | np.arange(len(self.grams), dtype=np.uint64)
        lead = (_sliding_least(keys, length - q + 1)[p] & U(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (lead[1:] != lead[:-1]) | (p[1:] != p[:-1] + 1)
        at = np.flatnonzero(new)
        self.lead, self.first, self.last = lead[at], p[at], p[np.append(at[1:], len(p)) - 1]

    def leaders(self) -> np.ndarray:
        return self.grams[self.lead]

    def cores(self, number: np.ndarray) -> np.ndarray:
        """Of the minimizers in buckets with a number."""
        alive = number > 0
        lead, first, last = self.lead[alive], self.first[alive], self.last[alive]
        low, n = (lead - last) // self.step, (lead - first) // self.step - (lead - last) // self.step + 1
        owner = np.repeat(np.arange(len(lead)), n)
        c = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner]
        self.core = lead[owner] - self.step * c
        self.begin = np.maximum(first[owner], self.core - self.step + 1)
        self.end = np.minimum(last[owner], self.core)
        size = self.length - self.step + 1
        return _bucket(self.grams, self.core, [*range(0, size - self.q, self.q), size - self.q], number[alive][owner], lead[owner] - self.core)

    def windows(self, number: np.ndarray) -> np.ndarray:
        """Of the cores in buckets with a number."""
        alive = number > 0
        begin, n = self.begin[alive], (self.end - self.begin + 1)[alive]
        owner = np.repeat(np.arange(len(begin)), n)
        self.start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + begin[owner]
        return _bucket(self.grams, self.start, [0, self.length - self.q], number[alive][owner], self.core[alive][owner] - self.start)

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Which bytes a repeated window covers."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        at = self.start[repeated]
        edge[at] += 1
        edge[at + self.length] -= 1
        return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, q: int = 64, step: int = 16, chunk_bytes: int = 4 << 20, texts: bool = True) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts anywhere else, same document included.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if ``texts``, kept: the
    remaining bytes read as UTF-8 with U+FFFD for cut characters. Null and empty texts: zeros and the digest of
    nothing. Repeated rows count as different places. Rows with a null id are kept: their matches count, and they
    return with a null id. An empty table gives an empty result. Strings are judged on the input.
    """
    if not 8 <= q <= length // 2 or not 1 <= step <= min(q, length - 2 * q):
        raise ValueError("q must be between 8 and half the length, and step at most q and the length less 2 q")
    held = stand(docs, id_col, text_col, chunk_bytes, "suffix")
    parts = chunks_for(held.total // 16, 1 << 20)

    def slices(texts: pa.Table, side: pa.Table) -> tuple[list[list[tuple[str, int, int]]], list[Slice]]:
        own, data, offsets = standing_texts(texts, side)
        runs = list(spans(offsets))
        return [own[i:j] for i, j in runs], [Slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, q, step) for i, j in runs]

    def taken_to(k: int, slices: list[Slice], right: pa.Table) -> list[np.ndarray]:
        """Identifiers of round k, or for k = 3 the bucket numbers of the windows, by Slice."""
        now = [s.leaders() for s in slices]
        for r in range(k):
            number = packed.bucket_numbers(np.concatenate([np.zeros(0, np.uint64), *now]), BITS[r], at_level(right, r))
            now = np.split(number, np.cumsum([len(x) for x in now])[:-1]) if now else []
            if r < 2:
                now = [(s.windows if r else s.cores)(n) for s, n in zip(slices, now, strict=True)]
        return now

    def rounds(k: int):
        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            now = taken_to(k, slices(left, right)[1], right)
            return packed.sent(key[0].as_py(), np.concatenate([np.zeros(0, np.uint64), *now]), BITS[k], parts)

        return run

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        owns, runs = slices(left, right)
        rows: dict[str, list] = {"digest": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for own, s, number in zip(owns, runs, taken_to(3, runs, right), strict=True):
            gone = s.covered(number > 0)
            for i, (digest, _, copies) in enumerate(own):
                a, b = s.offsets[i], s.offsets[i + 1]
                cut = np.ones(b - a, bool) if copies > 1 and b - a >= length else gone[a:b]
                rest = s.data[a:b][~cut].tobytes()
                rows["digest"].append(digest)
                rows["n_removed"].append(int(cut.sum()))
                rows["n_spans"].append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
                rows["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                rows["kept"].append(rest.decode("utf-8", "replace") if texts else None)
        return pa.table({k: pa.array(v, pa.string() if k in ("digest", "kept_sha256", "kept") else pa.int64()) for k, v in rows.items()})

    side = held.side
    for k in range(3):
        sent = held.texts.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(rounds(k), packed.SENT)
        side = side.unionByName(answered(packed.counted(sent, numbers=True), k))
    done = held.texts.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(finish, "digest string, n_removed long, n_spans long, kept_sha256 string, kept string")
    out = held.members.join(done, "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return out if texts else out.drop("kept")
