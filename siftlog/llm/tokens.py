"""Encoding whole texts inside tasks with a public tokenizer file, through a bounded cache of text pieces.

The file's normaliser and pre-tokenizer never join characters across ASCII white space, so a text's ids are those of
its pieces, in order. Texts of plain letters, digits and punctuation are cut further, between words and punctuation,
and A-Z are lower-cased, as the file itself does; texts with apostrophes, underscores, special strings or letters
beyond Latin are cut at white space only. Each distinct piece is encoded once for each worker; pieces are found,
hashed (64 bits) and looked up by array operations, and ids are gathered from one array.
"""

from __future__ import annotations

import os

import numpy as np

from siftlog.llm.bytetext import LOWER, SPACE, U, word_hashes

_WORD = np.zeros(256, np.uint8)
_WORD[:] = 2
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_WORD[SPACE] = 0
#: Lead bytes of letters U+00C0 to U+023F are 0xC3 to 0xC8; other lead bytes, apostrophes and underscores keep a text whole.
_WHOLE = np.zeros(256, bool)
_WHOLE[[0x27, 0x5F, 0xC2, *range(0xC9, 0x100)]] = True
#: Bytes of a document that are encoded at once.
LONG = 1 << 18
_held: dict[str, Pieces] = {}


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes to encode, start, end, document) of the pieces of several documents."""
    whole = _WHOLE[data]
    # The signs U+00D7 and U+00F7 stand among the letters, U+0130 gains a mark in lower case, ``<|`` opens special strings.
    for lead, then in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0x3C, 0x7C)):
        whole[1:] |= (data[:-1] == lead) & (data[1:] == then)
    seen = np.concatenate(([0], np.cumsum(whole)))[offsets]
    keep = np.repeat(np.diff(seen) > 0, np.diff(offsets))
    kind = np.where(keep, (~SPACE[data]).astype(np.uint8), _WORD[data])
    text = np.where(keep, data, LOWER[data])
    opens = kind > 0
    opens[1:] &= kind[1:] != kind[:-1]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    opens[edge] = kind[edge] > 0
    closes = kind > 0
    closes[:-1] &= kind[1:] != kind[:-1]
    edge = offsets[1:-1][offsets[1:-1] > 0] - 1
    closes[edge] = kind[edge] > 0
    starts = np.flatnonzero(opens)
    return text, starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, side="right") - 1


class Pieces:
    """Ids by the hash of a piece. ``most`` pieces are held; beyond that the cache starts anew, which changes speed only."""

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, where their ids begin, how many they are
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids of each hash begin, -1 if it isn't held; how many they are)."""
        at, size = np.full(len(wanted), -1, np.int64), np.zeros(len(wanted), np.int64)
        for known, begin, count in self.runs:
            place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            met = np.flatnonzero(known[place] == wanted)
            at[met], size[met] = begin[place[met]], count[place[met]]
        return at, size

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        ids, size = [], []
        for i in range(0, len(texts), 5000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 5000], add_special_tokens=False)]
            size += map(len, got)
            ids.append(np.array([x for one in got for x in one], np.int32))
        ids, size = np.concatenate(ids), np.array(size, np.int64)
        if self.used + len(ids) > len(self.ids):  # a quarter more, so that each id is moved a few times only
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(len(ids) + self.used // 4, np.int32)))
        self.ids[self.used : self.used + len(ids)] = ids
        run = hashes, self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        # A run joins those before it that are not four times its size: few runs to search, and each hash is moved a few times only.
        while self.runs and len(self.runs[-1][0]) < 4 * len(run[0]):
            run = tuple(map(np.concatenate, zip(self.runs.pop(), run, strict=True)))
        order = np.argsort(run[0], kind="stable")
        self.runs.append(tuple(x[order] for x in run))

    def encode(self, data: np.ndarray, offsets: np.ndarray, counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents end to end, number of ids of each document); the first is empty if only counts are asked for.

        Documents above ``LONG`` bytes are encoded in parts that end at white space, to bound memory.
        """
        if not (np.diff(offsets) > LONG).any():
            return self._encode(data, offsets, counts_only)
        ids, n = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            size = 0
            while True:
                stop = min(b, a + LONG)
                if stop < b:  # the first white space from there on, so a longer word stays whole
                    stop += int(np.argmax(SPACE[data[stop:b]])) if SPACE[data[stop:b]].any() else b - stop
                part, k = self._encode(data[a:stop], np.array([0, stop - a]), counts_only)
                ids.append(part)
                size, a = size + int(k[0]), stop
                if a >= b:
                    break
            n.append(size)
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.array(n, np.int64)

    def _encode(self, data: np.ndarray, offsets: np.ndarray, counts_only: bool) -> tuple[np.ndarray, np.ndarray]:
        text, starts, ends, doc = cut(data, offsets)
        docs = len(offsets) - 1
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(docs, np.int64)
        distinct, first, index = np.unique(word_hashes(text, starts, ends), return_index=True, return_inverse=True)
        at, size = self._find(distinct)
        if (at < 0).any():
            new = np.flatnonzero(at < 0)
            if self.runs and sum(len(r[0]) for r in self.runs) + len(new) > self.most:
                self._clear()
                new = np.arange(len(distinct))
            raw = text.tobytes()
            self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at, size = self._find(distinct)
        at, size = at[index], size[index]
        n = np.bincount(doc, size, docs).astype(np.int64)
        if counts_only:
            return np.zeros(0, np.int32), n
        return self.ids[np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)], n


def pieces(path: str) -> Pieces:
    """One cache for each worker process and file."""
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]
