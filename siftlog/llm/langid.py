"""Language identification by words first, with backoff to character n-grams.

A word of the model scores by its log frequency in each language. An unseen word is read from left to right: at each
place the longest known n-gram of the marked word counts, from ``longest`` characters down to one, and the word scores
their mean. A word is a maximal run of letters (Unicode category L) after each character is lower-cased; the same
array operations find words while learning and predicting. Words and n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from siftlog.llm.bytetext import U, give_back, mix, powers, spans, text_buffers
from siftlog.llm.shared import saved, unused

UNKNOWN = "und"
#: Up to so many languages a task holds full rows of scores.
FEW = 8
OPEN, CLOSE = ord("<"), ord(">")


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case, where that is one character, and whether that is a letter."""
    points, letters = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for a in range(0, 0x110000, 0x1000):  # some at a time, for their objects would be many times the tables
        some = [chr(i) for i in range(a, a + 0x1000)]
        points[a : a + 0x1000] = [ord(low if len(low := c.lower()) == 1 else c) for c in some]
        letters[a : a + 0x1000] = [c.isalpha() for c in some]
    return points, letters[points]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points, start, end, document) of the words of several UTF-8 texts end to end."""
    lower, letters = _characters()
    try:
        text = data.tobytes().decode()
    except UnicodeDecodeError:  # bytes that are no UTF-8 become U+FFFD
        texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return words_of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    points = lower[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    word = np.zeros(len(points) + 2, bool)
    word[1:-1] = letters[points]
    starts, ends = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    # A word that runs over the bound of two texts is a word of each.
    inner = begins[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(points))])
    inner = inner[word[inner] & word[inner + 1]]
    starts, ends = np.union1d(starts, inner), np.union1d(ends, inner)
    return points, starts, ends, np.searchsorted(begins, starts, side="right") - 1


def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, U)
    np.cumsum(mix((points.astype(U) + U(1)) * U(0x9E6C63D0876A9A47)) * up[:-1], out=sums[1:])
    return sums, down


def _hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def _word_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of words in order, some at a time to bound memory."""
    out = [np.zeros(0, U)]
    for i, j in spans(np.append(starts, ends[-1:]), 1 << 19) if len(starts) else ():
        sums, down = _sums(points[starts[i] : ends[j - 1]])
        out.append(_hashes(sums, down, starts[i:j] - starts[i], ends[i:j] - starts[i]))
    return np.concatenate(out)


def hashes_of(strings: list[str]) -> np.ndarray:
    """The hash of each string, as words and n-grams have it."""
    size = np.array([len(s) for s in strings], np.int64)
    points = np.array([ord(c) for s in strings for c in s], np.uint32)
    return _hashes(*_sums(points), np.cumsum(size) - size, np.cumsum(size))


def _marked(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words between their marks, end to end: (code points, start, end)."""
    size = ends - starts + 2
    stop = np.cumsum(size)
    at = np.arange(size.sum()) - np.repeat(stop - size, size) - 1 + np.repeat(starts, size)
    out = points[np.clip(at, 0, max(len(points) - 1, 0))]
    out[stop - size], out[stop - 1] = OPEN, CLOSE
    return out, stop - size, stop


def _row_of(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among sorted ones, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Scored:
    """Sorted hashes, and a full row of scores by language for each: for few keys."""

    keys: np.ndarray
    rows: np.ndarray

    def find(self, wanted: np.ndarray) -> np.ndarray:
        return _row_of(self.keys, wanted)

    def entries(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the rows, language, score) of each entry of the rows."""
        size = self.rows.shape[1]
        return np.repeat(np.arange(len(row)), size), np.tile(np.arange(size), len(row)), self.rows[row].ravel()

    def joined(self, keys: np.ndarray, rows: np.ndarray) -> Scored:
        keys, rows = np.concatenate((self.keys, keys)), np.concatenate((self.rows, rows))
        order = np.argsort(keys)
        return Scored(keys[order], rows[order])


@dataclass
class Sparse:
    """Sorted hashes; key i has the languages ``place[start[i]:start[i + 1]]`` with what each gains over one that lacks the key."""

    keys: np.ndarray
    start: np.ndarray
    place: np.ndarray
    gain: np.ndarray
    languages: int

    def find(self, wanted: np.ndarray) -> np.ndarray:
        return _row_of(self.keys, wanted)

    def entries(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the rows, language, gain) of each entry of the rows."""
        begin, size = self.start[row].astype(np.int64), (self.start[row + 1] - self.start[row]).astype(np.int64)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        return np.repeat(np.arange(len(row)), size), self.place[at], self.gain[at]

    @property
    def rows(self) -> np.ndarray:
        """Full rows less their mean, to look at a small model."""
        out = np.zeros((len(self.keys), self.languages))
        which, place, gain = self.entries(np.arange(len(self.keys)))
        out[which, place] = gain
        return out - out.mean(axis=1, keepdims=True)

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.start.nbytes + self.place.nbytes + self.gain.nbytes


@dataclass
class LanguageModel:
    """words and grams (by length) with their scores; ``guesses`` are those of unseen words that a task has met, ``most_guesses`` of four languages at most."""

    languages: list[str]
    words: Sparse | Scored
    grams: dict[int, Sparse | Scored]
    most_guesses: int = 200_000
    guesses: Scored | None = field(default=None, repr=False)

    @property
    def nbytes(self) -> int:
        return sum(t.nbytes for t in (self.words, *self.grams.values()))

    def _sums(self, owner: np.ndarray, scored: Sparse | Scored, row: np.ndarray, owners: int) -> np.ndarray:
        """By owner and language, the sum of the scores of rows."""
        which, place, score = scored.entries(row)
        size = len(self.languages)
        return np.bincount(owner[which] * size + place, score, owners * size).reshape(owners, size)

    def _at_once(self, most: int) -> int:
        """``most`` for up to four languages, fewer for more, to bound memory."""
        return max(most * 4 // max(len(self.languages), 4), 1)

    def backoff(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of unseen words, each read whole."""
        out = np.zeros((len(starts), len(self.languages)))
        # Some words at a time, to bound memory; a longer word is a run of its own.
        for i, j in spans(np.concatenate(([0], np.cumsum(ends - starts))), self._at_once(1 << 18)):
            text, a, b = _marked(points, starts[i:j], ends[i:j])
            sums, down = _sums(text)
            owner = np.repeat(np.arange(j - i), b - a)
            open_, met = np.arange(len(text)), np.zeros(j - i)
            for size in sorted(self.grams, reverse=True):
                fits = open_[open_ + size <= b[owner[open_]]]
                row = self.grams[size].find(_hashes(sums, down, fits, fits + size))
                known = fits[row >= 0]
                if not len(known):
                    continue
                out[i:j] += self._sums(owner[known], self.grams[size], row[row >= 0], j - i)
                met += np.bincount(owner[known], minlength=j - i)
                left = np.zeros(len(text), bool)
                left[open_] = True
                left[known] = False
                open_ = np.flatnonzero(left)
            out[i:j] /= np.maximum(met, 1)[:, None]
        return out

    def guessed(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of unseen words, from what the task remembers or by backoff."""
        none = Scored(np.zeros(0, U), np.zeros((0, len(self.languages))))
        held = self.guesses or none
        row = held.find(keys)
        out = np.zeros((len(keys), len(self.languages)))
        out[row >= 0] = held.rows[row[row >= 0]]
        new = np.flatnonzero(row < 0)
        if len(new):
            out[new] = self.backoff(points, starts[new], ends[new])
            most = self._at_once(self.most_guesses)
            if len(new) <= most:
                self.guesses = (held if len(held.keys) + len(new) <= most else none).joined(keys[new], out[new])
        return out

    def totals(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sums of scores, number of words) of each text."""
        docs = len(offsets) - 1
        points, starts, ends, doc = words_of(data, offsets)
        out = np.zeros((docs, len(self.languages)))
        if not len(starts) or not self.languages:
            return out, np.bincount(doc, minlength=docs)
        distinct, first, index = np.unique(_word_hashes(points, starts, ends), return_index=True, return_inverse=True)
        row = self.words.find(distinct)
        unseen = np.flatnonzero(row < 0)
        if len(self.languages) <= FEW:  # a full row for each different word is small; the sums are the same
            scores = np.zeros((len(distinct), len(self.languages)))
            which, place, score = self.words.entries(row[row >= 0])
            scores[np.flatnonzero(row >= 0)[which], place] = score
            scores[unseen] = self.guessed(distinct[unseen], points, starts[first[unseen]], ends[first[unseen]])
            for k in range(len(self.languages)):
                out[:, k] = np.bincount(doc, scores[index, k], docs)
            return out, np.bincount(doc, minlength=docs)
        of, known = row[index], np.flatnonzero(row[index] >= 0)
        step = self._at_once(1 << 18)
        for i in range(0, len(known), step):
            some = known[i : i + step]
            out += self._sums(doc[some], self.words, of[some], docs)
        place = np.full(len(distinct), -1)
        place[unseen] = np.arange(len(unseen))
        place, step = place[index], self._at_once(1 << 17)
        for i in range(0, len(unseen), step):
            some = unseen[i : i + step]
            guesses = Scored(distinct[some], self.guessed(distinct[some], points, starts[first[some]], ends[first[some]]))
            there = np.flatnonzero((place >= i) & (place < i + step))
            for j in range(0, len(there), step):
                part = there[j : j + step]
                out += self._sums(doc[part], guesses, place[part] - i, docs)
        return out, np.bincount(doc, minlength=docs)

    def judged(self, data: np.ndarray, offsets: np.ndarray, certain_at: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the language or -1, score) of each text."""
        total, words = self.totals(data, offsets)
        if not self.languages:
            return np.full(len(total), -1), np.zeros(len(total))
        total *= (np.minimum(words, certain_at) / np.maximum(words, 1))[:, None]
        share = np.exp(total - total.max(axis=1, keepdims=True))
        best = share.argmax(axis=1)
        score = share[np.arange(len(best)), best] / share.sum(axis=1)
        return np.where(words > 0, best, -1), np.where(words > 0, score, 0.0)


def _sparse(key: np.ndarray, place: np.ndarray, n: np.ndarray, totals: np.ndarray) -> Sparse:
    """Counts by key and language as gains in log frequency over a language that lacks the key.

    Languages are brought to the total of the largest before a tenth of a count is added, so what none or few of a
    language's texts hold speaks neither for nor against it because it has fewer texts.
    """
    order = np.lexsort((place, key))
    key, place, n = key[order], place[order], n[order]
    keys, start = np.unique(key, return_index=True)
    scale = totals.max(initial=1) / np.maximum(totals, 1)
    gain = np.log(n * scale[place] + 0.1) - np.log(0.1)
    return Sparse(keys, np.append(start, len(key)).astype(np.int32), place.astype(np.int16), gain.astype(np.float32), len(totals))


def _counted(longest: int):
    """Arrow task: texts and places of their languages -> how often each word (size 0) and n-gram occurs, by hash, in each run of texts."""

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b["text"])
            place = b["place"].to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in spans(offsets):
                points, starts, ends, doc = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for u, v in spans(np.concatenate(([0], np.cumsum(ends - starts))), 1 << 18):  # some words at a time, to bound memory
                    lang = place[i + doc[u:v]]
                    text, a, stop = _marked(points, starts[u:v], ends[u:v])
                    sums, down = _sums(text)
                    owner = np.repeat(np.arange(len(a)), stop - a)
                    for size in range(longest + 1):
                        at = np.flatnonzero(np.arange(len(text)) + size <= stop[owner]) if size else a + 1
                        h, of = _hashes(sums, down, at, at + size if size else stop - 1), lang[owner[at]]
                        for one in np.unique(of):
                            keys, n = np.unique(h[of == one], return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), one, np.int32)), pa.array(n.astype(np.int64))], ["size", "key", "place", "n"])
        give_back()

    return run


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", most_rows: int = 2000, most_bytes: int = 32 << 20, most_entries: int = 4_000_000, least_count: int = 2, longest: int = 5) -> LanguageModel:
    """Learn from about ``most_rows`` different whole texts of each language (a share of them by a hash of the text, so reruns agree).

    Three bounds fix the size of sample and model. A language whose texts are more than its share of ``most_bytes`` (that of all languages
    alike) gives fewer of them. Every word and n-gram that occurs ``least_count`` times in the sample is kept, in the languages that have
    it; if these are more than ``most_entries`` entries, as many times more as bring them below: some 15 bytes an entry are
    broadcast. So a small language loses nothing to a large one. Words of any length teach all their n-grams. Rows with a
    null text or language teach nothing; without rows the model has no languages.
    """
    rows = labelled.select(labelled[text_col].alias("text"), labelled[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null").withColumn("hash", F.xxhash64("text", F.lit(7)))
    each = rows.groupBy("lang", "hash").agg(F.max(F.octet_length("text").cast("long")).alias("size"))
    sizes = {r["lang"]: r for r in each.groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}  # one row for each language
    languages = sorted(sizes)
    if not languages:
        none = Scored(np.zeros(0, U), np.zeros((0, 0)))
        return LanguageModel([], none, {})
    share = {k: min(1.0, most_rows / r["n"], most_bytes / len(languages) / max(r["size"], 1)) for k, r in sizes.items()}
    bound = F.create_map(*[F.lit(x) for k in languages for x in (k, int(share[k] * (1 << 20)) + 1)])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    sample = rows.where(F.pmod("hash", F.lit(1 << 20)) < bound[F.col("lang")]).groupBy("lang", "hash").agg(F.first("text").alias("text"))
    sample = sample.select("text", place[F.col("lang")].cast("int").alias("place"))
    counts = sample.mapInArrow(_counted(longest), "size int, key long, place int, n long").groupBy("size", "key", "place").agg(F.sum("n").alias("n"))
    by_key = counts.groupBy("size", "key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("place", "n")).alias("by")).where(F.col("total") >= least_count)
    by_key = saved(by_key, "language-counts")
    at_total = by_key.groupBy(F.least("total", F.lit(10_000)).alias("total")).agg(F.sum(F.size("by")).alias("entries")).collect()  # a row a count, 10,000 at most
    entries, least = 0, None
    for r in sorted(at_total, key=lambda r: -r["total"]):
        entries += r["entries"]
        if entries > most_entries:
            break
        least = r["total"]
    got = by_key.where(F.col("total") >= (10_000 if least is None else least)).select("size", "key", F.explode("by").alias("b")).select("size", "key", "b.place", "b.n").toArrow()  # most_entries bounds it
    size, key, at, n = (got[c].to_numpy() for c in ("size", "key", "place", "n"))
    key = key.view(np.uint64)
    totals = lambda mine: np.bincount(at[mine], n[mine], len(languages))

    def sparse(of: int) -> Sparse:
        mine = size == of
        return _sparse(key[mine], at[mine], n[mine], totals(size == 0 if of == 0 else size > 0))

    return LanguageModel(languages, sparse(0), {k: sparse(k) for k in range(1, longest + 1)})


def labelled(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"), certain_at: int = 20) -> DataFrame:
    """The rows with two more columns: the language and its score (0 to 1), the share of the best language if at most
    ``certain_at`` words' weight is trusted. Nothing is shuffled.

    Null texts, texts without letters and models without languages give ``und`` and 0. Ties go to the first language by
    name. Rows are judged alone, so repeated rows agree; an empty table gives an empty result. The new names must be new.
    """
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        names_of = np.array([*m.languages, UNKNOWN], object)
        for b in batches:
            data, offsets = text_buffers(b[text_col])
            got = [m.judged(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], certain_at) for i, j in spans(offsets)]
            at, scores = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((int, float), zip(*got, strict=True) if got else ((), ()), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names_of[at].tolist(), pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, *names])
        m.guesses = None
        give_back()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Return doc_id, lang_pred and score as ``labelled`` gives them."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return labelled(rows, model, **options).drop("text")


def known_languages(docs: DataFrame, model: LanguageModel, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows whose text is in a language of the model with at least ``least_score``; columns stay as they are."""
    lang, score = unused("told_lang", docs), unused("told_score", docs)
    told = labelled(docs, model, text_col, names=(lang, score))
    return told.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).select(*docs.columns)
