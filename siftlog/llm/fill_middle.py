"""Fill-in-the-middle by a piecewise-linear learned rank index.

A text is a row of units (white space with the word behind it; white space at the end is a unit of its own). The index of
a text answers where its first r units end: lines are fitted, greedily as long as they go, so that no boundary is farther
than ``error`` bytes from its line, and each boundary's distance from the rounded prediction, a signed byte, is stored
beside them. A cut is the line's prediction at its rank plus the residual stored there, which is exact. So an index takes
about a byte for each unit, and further cuts of the same text (other seeds, further epochs) need no second look for words:
``with_rank_index`` keeps it beside the text, ``fill_in_middle`` takes it from there or fits it on the way.

All work is one pass of Arrow tasks over the rows; nothing is shuffled, so no group of copies or source meets in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftlog.llm.bytetext import spans, text_buffers, word_bounds
from siftlog.llm.shared import picked

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
INDEX = "struct<ranks: array<int>, offsets: array<bigint>, slopes: array<double>, residuals: binary>"
OUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
#: A residual must fit a signed byte, also after a prediction is rounded.
MOST_ERROR = 126


@dataclass
class RankIndex:
    """Lines over ranks: line s starts at ``ranks[s]`` and ``offsets[s]``; ``residuals`` has an entry for each rank."""

    ranks: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def cut(self, rank: int) -> int:
        """The byte at which the first ``rank`` units end."""
        s = int(np.searchsorted(self.ranks, rank, side="right")) - 1
        return int(self.offsets[s]) + round(float(self.slopes[s]) * (rank - int(self.ranks[s]))) + int(self.residuals[rank])

    def stored(self) -> dict:
        return {"ranks": self.ranks.tolist(), "offsets": self.offsets.tolist(), "slopes": self.slopes.tolist(), "residuals": self.residuals.tobytes()}

    @staticmethod
    def read(x: dict) -> RankIndex:
        return RankIndex(np.array(x["ranks"]), np.array(x["offsets"]), np.array(x["slopes"]), np.frombuffer(x["residuals"], np.int8))


def fit_rank_index(ends: np.ndarray, error: int) -> RankIndex:
    """Lines through the offsets 0, then ``ends``: each starts on a boundary and goes as far as one slope serves all.

    Every boundary narrows the cone of slopes that keep all boundaries so far within ``error``; the line ends where the
    cone would be empty, and takes the middle of the last one that isn't.
    """
    y = np.concatenate(([0], ends)).astype(np.float64)
    ranks, slopes, predicted, a = [], [], np.zeros(len(y), np.int64), 0
    while a < len(y):
        low, high, b, width = -np.inf, np.inf, a + 1, 128
        while b < len(y):
            k = np.arange(b - a, min(len(y), b + width) - a)
            rise = y[b : b + width] - y[a]
            lows = np.maximum(np.maximum.accumulate((rise - error) / k), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / k), high)
            good = len(k) if lows[-1] <= highs[-1] else int(np.argmax(lows > highs))
            if good:
                low, high = lows[good - 1], highs[good - 1]
            b, width = b + good, 2 * width
            if good < len(k):
                break
        slope = (low + high) / 2 if b > a + 1 else 0.0
        predicted[a:b] = int(y[a]) + np.rint(slope * np.arange(b - a)).astype(np.int64)
        ranks.append(a)
        slopes.append(slope)
        a = b
    ranks = np.array(ranks)
    return RankIndex(ranks, y[ranks].astype(np.int64), np.array(slopes), (y.astype(np.int64) - predicted).astype(np.int8))


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, ends): the units of document i end at ``ends[bounds[i]:bounds[i + 1]]``, in bytes from its start."""
    _, ends, doc = word_bounds(data, offsets)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    upto, length = np.cumsum(words), np.diff(offsets)
    ends = ends - offsets[doc]
    last = np.where(words > 0, ends[np.maximum(upto - 1, 0)] if len(ends) else 0, 0)
    rest = length > last  # white space at the end
    ends = np.insert(ends, upto[rest], length[rest])
    return np.concatenate(([0], np.cumsum(words + rest))), ends


def _indexes(column: pa.Array, error: int):
    """(document, its bytes, its index) of a batch, some documents at a time."""
    data, offsets = text_buffers(column)
    for i, j in spans(offsets):
        own = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        bounds, ends = unit_ends(part, own)
        for d in range(j - i):
            yield i + d, part[own[d] : own[d + 1]], fit_rank_index(ends[bounds[d] : bounds[d + 1]], error)


def with_rank_index(docs: DataFrame, name: str = "rank_index", text_col: str = "text", error: int = 64) -> DataFrame:
    """The rows as they are with the index of their text in the column ``name``, to be stored and cut again and again.

    A null or empty text has the lone boundary 0.
    """
    if not 0 < error <= MOST_ERROR:
        raise ValueError(f"error must be from 1 to {MOST_ERROR} bytes")
    at = docs.columns.index(text_col)
    kind = pa.struct([("ranks", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("slopes", pa.list_(pa.float64())), ("residuals", pa.binary())])

    def indexed(batches):
        for b in batches:
            found = pa.array([x.stored() for _, _, x in _indexes(b.column(at), error)], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, name])

    return docs.mapInArrow(indexed, StructType([*docs.schema.fields, *StructType.fromDDL(f"`{name}` {INDEX}").fields]))


def _hashes(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex sha256 of ``seed:doc_id``; a null id counts as no digits."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _chars(data: np.ndarray) -> int:
    """Code points: the bytes that don't continue one."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text", index_col: str | None = None, error: int = 64) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output of every row.

    ``rate`` percent of the texts are cut into prefix, middle and suffix at two ranks dealt by the hash of seed and doc_id,
    ``spm`` percent of those with the suffix first. Texts that are empty or null, or hold one of the three marks, stay plain. Where
    ``index_col`` names a column of ``with_rank_index``, cuts are read from it; else the index is fitted on the way.
    Rows of one id are cut by the same hashes, each by its own length; rows without an id all by the hash of no digits. An
    empty table stays empty; other columns are left out.
    """
    if not 0 < error <= MOST_ERROR:
        raise ValueError(f"error must be from 1 to {MOST_ERROR} bytes")
    named = picked(docs, doc_id=id_col, text=text_col) if index_col is None else picked(docs, doc_id=id_col, text=text_col, own=index_col)
    rows = named.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumns({f"h{i + 1}": h for i, h in enumerate(_hashes(F.col("doc_id"), seed))})
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def cut(batches):
        for b in batches:
            h, done, size = [b.column(f"h{i}").to_numpy() for i in range(1, 5)], [], 0
            found = _indexes(b.column("text"), error) if index_col is None else _stored(b.column("text"), b.column("own"))
            for d, data, index in found:
                n, text = len(index.residuals) - 1, data.tobytes()
                if not text or h[2][d] % 100 >= rate or any(m in text for m in marks):
                    done.append((n, "plain", None, None, text))
                else:
                    r, s = sorted((int(h[0][d]) % (n + 1), int(h[1][d]) % (n + 1)))
                    i, j = index.cut(r), index.cut(s)
                    form, p, m, s = "spm" if h[3][d] % 100 < spm else "psm", text[:i], text[i:j], text[j:]
                    pieces = (marks[1], s, marks[0], p, marks[2], m) if form == "spm" else (marks[0], p, marks[1], s, marks[2], m)
                    done.append((n, form, _chars(data[:i]), _chars(data[i:j]), b"".join(pieces)))
                size += len(text)
                if size > 1 << 20:
                    yield _batch(b.column(0).slice(d + 1 - len(done), len(done)), done)
                    done, size = [], 0
            if done:
                yield _batch(b.column(0).slice(len(b.column(0)) - len(done)), done)

    return rows.mapInArrow(cut, OUT)


def _stored(texts: pa.Array, own: pa.Array):
    data, offsets = text_buffers(texts)
    for d in range(len(texts)):
        yield d, data[offsets[d] : offsets[d + 1]], RankIndex.read(own[d].as_py())


def _batch(ids: pa.Array, done: list[tuple]) -> pa.RecordBatch:
    n, form, prefix, middle, output = zip(*done, strict=True)
    columns = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its pieces, told by the first mark of each kind, back in order."""

    def piece(after: str, before: str | None) -> Column:
        rest = F.substring(output, F.locate(after, output) + F.lit(len(after)), F.length(output))
        return rest if before is None else F.substring_index(rest, before, 1)

    psm = F.concat(piece(PREFIX, SUFFIX), piece(MIDDLE, None), piece(SUFFIX, MIDDLE))
    spm = F.concat(piece(PREFIX, MIDDLE), piece(MIDDLE, None), piece(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
