"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams up to two words, of words and of word shapes (case, digits and signs, runs collapsed).
Each indicator is scaled by the log-count ratio of its class counts, rows are brought to unit length, and a linear
hinge-loss model is fitted to them by dual coordinate descent. Margins become probabilities by a logistic function
fitted on training texts that the model did not see.

Training takes at most ROWS[y] documents with label y and about MAX_BYTES of text, on the driver: parameters of the
operator. Scoring reads every whole text in one pass without a shuffle; the model's size is fixed (2**BITS features).
Labels, language, source and id are no inputs.

Cases. Null, empty or blank text: no n-grams, margin of the bias alone. Null doc_id: scored, held_out null. No usable
labels: every score is one half. Repeated rows: each is scored. Empty table: no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import WORDS_TABLE, chunks, doc_rows
from folioscan.llm.labelled import fold, logistic, probability, sample

ROWS = (2000, 3000)
MAX_BYTES = 24 << 20
BITS = 20
COST = 1.0
PASSES = 12

#: Upper case to A, lower case to a, digits to 0, bytes of other scripts to e with an upper-case mark where Latin-1 letters have one.
_SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else 97 if 0xA0 <= b <= 0xBF else 65 if 0x80 <= b < 0xA0 else 36 if b >= 0xC0 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class Grams:
    """Turns texts into sets of feature numbers; remembers what it knows of a token while it lives."""

    def __init__(self) -> None:
        self._seen: dict[bytes, int] = {}

    def _number(self, token: bytes) -> int:
        word = zlib.crc32(token.translate(WORDS_TABLE).strip() or token)
        shape = zlib.crc32(_RUNS.sub(rb"\1", token.translate(_SHAPES).replace(b"$", b"")))
        return (word << 31) ^ (shape & 0x7FFFFFFF)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature): each feature of each text once, in order of text."""
        if len(self._seen) > 300_000:
            self._seen.clear()
        split = [t.split() for t in texts]
        tokens = [t for s in split for t in s]
        fresh = set(tokens) - self._seen.keys()
        self._seen.update((t, self._number(t)) for t in fresh)
        both = np.fromiter(map(self._seen.__getitem__, tokens), np.int64, len(tokens))
        doc = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        word, shape = (both >> 31).astype(np.uint64), (both & 0x7FFFFFFF).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = lambda a, salt: ((a + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            next_to = doc[1:] == doc[:-1]
            pair = lambda a: a[1:][next_to] * np.uint64(31) + a[:-1][next_to] * np.uint64(1_000_003)
            same = np.flatnonzero(next_to & (word[1:] == word[:-1])) + 1
            feature = np.concatenate([mixed(word, 1), mixed(shape, 2), mixed(pair(word), 3), mixed(pair(shape), 4), np.full(len(same), mixed(np.zeros(1, np.uint64), 5)[0])])
        of = np.concatenate([doc, doc, doc[1:][next_to], doc[1:][next_to], doc[same]])
        codes = np.unique((of << BITS) | feature.astype(np.int64))
        return codes >> BITS, codes & (2**BITS - 1)


def in_pieces(grams: Grams, texts: list[bytes], size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """What grams gives for the texts, made from about size bytes at a time, so that only the features of a whole sample stay in memory."""
    of, features, start = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    while start < len(texts):
        end, n = start + 1, len(texts[start])
        while end < len(texts) and n + len(texts[end]) <= size:
            n += len(texts[end])
            end += 1
        text, feature = grams(texts[start:end])
        of.append((text + start).astype(np.int32))
        features.append(feature.astype(np.int32))
        start = end
    return np.concatenate(of), np.concatenate(features)


def log_count_ratios(text: np.ndarray, feature: np.ndarray, y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = (smooth + np.bincount(feature[y[text] == c], minlength=2**BITS) for c in (1, 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights of the linear hinge-loss model: for one row at a time the dual variable that is best for it, in a random order.

    rows: (features, values) with the bias among them; y: -1 or 1; cost: the upper bound of each dual variable.
    """
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norm = np.array([float(v @ v) for _, v in rows])
    rng = np.random.default_rng(1)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    def __init__(self) -> None:
        self.ratio = np.zeros(2**BITS, np.float32)
        self.weight = np.zeros(2**BITS, np.float32)
        self.bias, self.calibration = 0.0, np.zeros(2)

    def margins(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[feature]
        length = np.sqrt(np.bincount(text, r * r, n)) + 1e-9
        return np.bincount(text, self.weight[feature] * r, n) / length + self.bias

    def scores(self, grams: Grams, texts: list[bytes]) -> np.ndarray:
        return probability(self.margins(*grams(texts), len(texts))[:, None], self.calibration)


def fit(texts: list[bytes], y: np.ndarray, share: float) -> Model:
    """Fits on three quarters of the texts, and calibrates on the others."""
    model = Model()
    if not len(texts) or y.min() == y.max():
        model.calibration = logistic(np.zeros((len(texts), 1)), y, share) if len(texts) else np.zeros(2)
        return model
    other = np.zeros(len(texts), bool)
    for c in (0, 1):
        other[np.flatnonzero(y == c)[::4]] = True
    grams, own = Grams(), np.flatnonzero(~other)
    text, feature = in_pieces(grams, [texts[i] for i in own])
    model.ratio = log_count_ratios(text, feature, y[own]).astype(np.float32)
    edges = np.searchsorted(text, np.arange(len(own) + 1))
    rows = []
    for a, b in zip(edges[:-1], edges[1:]):
        v = model.ratio[feature[a:b]].astype(np.float64)
        rows.append((np.append(feature[a:b], np.int32(2**BITS)), np.append(v / (np.sqrt(v @ v) + 1e-9), 1.0)))
    del text, feature
    sign = np.where(y[own] > 0, 1.0, -1.0)
    cost = COST * np.where(sign > 0, len(own) / (2 * (sign > 0).sum()), len(own) / (2 * (sign < 0).sum()))
    w = dual_coordinate_descent(rows, sign, 2**BITS + 1, cost)
    model.weight, model.bias = w[:-1].astype(np.float32), float(w[-1])
    held = np.flatnonzero(other)
    model.calibration = logistic(model.margins(*in_pieces(grams, [texts[i] for i in held]), len(held))[:, None], y[held], share)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: tuple[int, int] = ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """A model fitted on a bounded sample of the labelled documents; usable selects labels by doc_id."""
    return fit(*sample(docs, labels, "quality", F.lit(True) if usable is None else usable, rows, max_bytes))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for c in chunks(batch):
                score = shared.value.scores(grams, c.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns from labels whose id is not in the held-out fold."""
    model = fit_on(docs, labels, fold("doc_id", folds) != held_out)
    return score_quality(docs, model).select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", "predicted")
