"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document marked good over one marked bad) train a linear score by logistic loss on feature
differences. The scores of the training documents give the threshold: of all cuts between two of them, the one that
splits them as their labels are split best. Reported scores are logistic in the distance from the threshold, which is at 0.7.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.bytetext import shingle_sets, spans, text_buffers, word_bounds, word_hashes

CUT = 0.7
FEATURES = ("log_words", "symbols", "digits", "capitals", "stops", "lines", "wide", "mean_length", "length_spread", "distinct_words", "repeats_last", "distinct_pairs", "distinct_triples", "top_word", "word_ends_symbol", "bars", "long_words", "empty")


def _classes() -> np.ndarray:
    t = np.zeros((256, 7))
    t[[ord(c) for c in "#*$%&|<>"], 0] = 1
    t[0x30:0x3A, 1] = 1
    t[0x41:0x5B, 2] = 1
    t[[ord(c) for c in ".!?,;:"], 3] = 1
    t[10, 4] = 1
    t[0xC0:0x100, 5] = 1
    t[ord("|"), 6] = 1
    return t


_CLASSES = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each document, of FEATURES, each about 0 to 1."""
    docs = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((docs, len(FEATURES)))
    starts, ends, doc = word_bounds(data, offsets)
    n = np.bincount(doc, minlength=docs)
    per = np.maximum(n, 1)
    out[:, 0] = np.log1p(n) / 10
    for k, col in enumerate((1, 2, 3, 4, 5, 6, 15)):
        out[:, col] = np.diff(np.concatenate(([0.0], np.cumsum(_CLASSES[data, k])))[offsets]) / size
    if not len(starts):
        out[:, 17] = 1
        return out
    length = np.minimum(ends - starts, 60)
    out[:, 7] = np.bincount(doc, length, docs) / per / 20
    out[:, 8] = np.sqrt(np.maximum(np.bincount(doc, length * length, docs) / per - (out[:, 7] * 20) ** 2, 0)) / 20
    h = word_hashes(data, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, 10] = np.bincount(doc[same], minlength=docs) / per
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    out[:, 9] = np.bincount(ds[new], minlength=docs) / per
    runs = np.diff(np.append(np.flatnonzero(new), len(hs)))
    top = np.zeros(docs)
    np.maximum.at(top, ds[new], runs)
    out[:, 13] = top / per
    for col, k in ((11, 2), (12, 3)):
        out[:, col] = np.diff(shingle_sets(data, offsets, k)[0]) / np.maximum(n - k + 1, 1)
    out[:, 14] = np.bincount(doc, _CLASSES[data[ends - 1], 0], docs) / per
    out[:, 16] = np.bincount(doc, length > 25, docs) / per
    out[:, 17] = n == 0
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z])

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = self.slope * (self.expand(x) @ self.weights - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def _feature_rows(batches):
    for b in batches:
        data, offsets = text_buffers(b["text"])
        rows = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in spans(offsets)]
        x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([b["label"], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))], ["label", "x"])


def learn(x: np.ndarray, y: np.ndarray, pairs: int = 100_000, rounds: int = 40, ridge: float = 1e-3, seed: int = 5) -> QualityModel:
    """Fit preference pairs drawn from good and bad rows. Without rows of both kinds every document scores alike, at the cut."""
    width = len(FEATURES)
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(width), np.ones(width))
    model = QualityModel(mean, scale, np.zeros(2 * width), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(seed)
    z = model.expand(x)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(rounds):  # Newton steps on the mean of log(1 + exp(-d w)) + ridge / 2 * |w|^2
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.sort(s)
    cuts = np.unique(np.concatenate((order[:1], (order[1:] + order[:-1]) / 2)))  # between neighbours, at any share of bad rows
    right = 1 - np.searchsorted(np.sort(s[good]), cuts) / len(good) + np.searchsorted(np.sort(s[bad]), cuts) / len(bad)
    model.weights, model.threshold = w, float(cuts[int(np.argmax(right))])
    model.slope = float(2 / max(np.std(s[good]), 1e-6))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 20_000) -> QualityModel:
    """Learn from about ``most_rows`` labelled documents (a share of the labels by a hash of the id); their features go to the driver.

    Labels that are null or neither 0 nor 1, and those of no document, teach nothing.
    """
    marks = labels.select(labels[id_col].alias("label_id"), labels[label_col].cast("int").alias("label")).where("label in (0, 1) and label_id is not null")
    n = marks.count()
    marks = marks.where(F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(1 << 20)) < int(min(1.0, most_rows / max(n, 1)) * (1 << 20)) + 1)
    rows = docs.select(docs[id_col].alias("label_id"), docs[text_col].alias("text")).join(F.broadcast(marks), "label_id")  # most_rows bounds it
    got = rows.select("label", "text").mapInArrow(_feature_rows, "label int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["label"].to_numpy(int)))  # reruns agree whatever order rows come in
    return learn(x[order], got["label"].to_numpy(int)[order])


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, score (0 to 1) and predicted (1 if score >= 0.7). Null texts are empty and score as such; rows are judged alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            data, offsets = text_buffers(b["text"])
            out = [held.value.scores(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in spans(offsets)]
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
