"""Toxicity with a linear-chain conditional random field.

The field tags every word of a text as toxic or not. Labels are given for documents, so word labels for training come
from them: a word of a toxic training document is toxic if one of its features (the word, its first 3 to 6 bytes, its
last 3) stands in toxic training documents far more often than chance allows, and hardly in others. The clearest features
are marked first; the next are sought in the toxic documents that hold none of those, so that what merely stands beside a
toxic word is not taken for one. Forward-backward gives each word's marginal probability; a document's score is a
calibrated function of its largest marginal and of their sum, and runs of words with a marginal over one half are its
offending spans. The calibration is fitted on all training documents, each marked by a field that did not learn from it.

Training takes at most ROWS documents of each label and about MAX_BYTES of text, in one task: parameters of the operator.
The driver sees the fitted model only. Scoring reads every whole text in one pass without a shuffle; the model's size is fixed (2**BITS weights).
A chain is a line of any length. Long ones are worked on in segments of SEGMENT words at once: each segment's factors are
multiplied into one matrix, messages go from segment to segment through these, and then all segments are done together
with the messages at their ends, which gives the same marginals as the whole chain.

Cases. Null, empty or wordless text: no words, so the score for no evidence. Null doc_id: scored, held_out null.
No usable labels: every score is the share of toxic labels. Repeated rows: each is scored. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import WORDS_TABLE, chunks, doc_rows
from folioscan.llm.labelled import fitted_in_task, fold, logistic, probability

#: Training documents labelled 0 and 1.
ROWS = (3600, 1200)
MAX_BYTES = 24 << 20
BITS = 18
SEGMENT = 64
STEPS = 25
#: A feature marks words as toxic if so large a share of its places is in toxic documents (were half of all words in such).
LEAST_SHARE = 0.95
#: And if chance would give less than one such feature: its surprise in nats is the log of the number of features, or this
#: many times that for the first ones, which are judged on all toxic documents. Later rounds take what reaches half of the most.
FIRST, LATER = 1.5, 0.5
#: Fields fitted for the calibration, each on all parts of the sample but one.
FOLDS = 2
THRESHOLD = 0.3


def features(word: bytes) -> list[int]:
    """The numbers of a word's six features."""
    parts = (b"w" + word, b"3" + word[:3], b"4" + word[:4], b"5" + word[:5], b"6" + word[:6], b"s" + word[-3:])
    return [zlib.crc32(p) & (2**BITS - 1) for p in parts]


class Chains:
    """The words of some texts as chains, one per line, in segments of up to SEGMENT words; words are kept if wanted."""

    def __init__(self, texts: list[bytes], words: bool = True):
        data = b"\n".join(texts)
        plain = data.translate(WORDS_TABLE)
        self.words = plain.split() if words else []
        raw, inside = np.frombuffer(data, np.uint8), np.frombuffer(plain, np.uint8) != 32
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text_start = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.doc = np.searchsorted(self.text_start, self.start, "right") - 1
        line = np.searchsorted(np.flatnonzero(raw == 10), self.start)
        n = len(self.start)
        new = np.ones(n, bool)
        new[1:] = line[1:] != line[:-1]
        heads = np.flatnonzero(new)
        at = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        first = np.flatnonzero(at % SEGMENT == 0)
        length = np.diff(np.append(first, n))
        order = np.argsort(-length, kind="stable")
        self.rank = np.empty(len(first), np.int64)
        self.rank[order] = np.arange(len(first))
        self.place = (at % SEGMENT, np.repeat(self.rank, length))
        self.active = np.searchsorted(-length[order], -np.arange(SEGMENT), "left")  # segments longer than t
        self.first, self.number = first, at[first] // SEGMENT  # the first word of each segment, and its number in its chain
        self.opens = self.number == 0
        self.goes_on = np.flatnonzero(np.append(~self.opens[1:], False)) if len(first) else first  # segments with another one behind
        self.shape = (int(length.max()) if n else 0, len(first))

    def messages(self, odds: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(forward, backward, pairs): what each segment, by rank, gets from the one before and the one behind, and the expected transitions between segments."""
        chains = self.shape[1]
        forward, backward = np.repeat(np.asarray(start, np.float32)[:, None], chains, 1), np.ones((2, chains), np.float32)
        pairs, before = np.zeros((2, 2)), self.goes_on
        if not len(before):
            return forward, backward, pairs
        own = np.unique(self.rank[np.append(before, before + 1)])
        m = np.zeros((2, 2, len(own)), np.float32)  # from the state of a segment's first word to that of its last
        m[0, 0], m[1, 1] = 1, odds[0, own]
        for t in range(1, self.shape[0]):
            k = int(np.searchsorted(own, self.active[t]))
            now = odds[t, own[:k]]
            step = [[m[i, 0, :k] * trans[0, j] + m[i, 1, :k] * trans[1, j] for j in (0, 1)] for i in (0, 1)]
            step = np.array([[x, y * now] for x, y in step])
            m[:, :, :k] = step / step.sum((0, 1))
        levels = np.split(before[np.argsort(self.number[before], kind="stable")], np.cumsum(np.bincount(self.number[before]))[:-1])
        last = np.zeros((2, chains))
        for level in levels:
            here, behind = self.rank[level], self.rank[level + 1]
            a = (forward[:, None, here] * m[:, :, np.searchsorted(own, here)]).sum(0)
            last[:, here] = a / a.sum(0)
            forward[:, behind] = trans.T @ last[:, here]
        for level in levels[::-1]:
            here, behind = self.rank[level], self.rank[level + 1]
            b = (m[:, :, np.searchsorted(own, behind)] * backward[None, :, behind]).sum(1)
            b /= b.sum(0)
            joint = last[:, None, here] * trans[:, :, None] * b[None]
            pairs += (joint / joint.sum((0, 1))).sum(2)
            backward[:, here] = trans @ b
        return forward, backward / backward.sum(0), pairs

    def marginals(self, e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's probability of being toxic, the expected number of each transition, and of each start.

        e: each word's odds of being toxic by itself; trans[i, j] and start[i]: factors, state 1 is toxic.
        """
        steps, chains = self.shape
        odds = np.ones(self.shape, np.float32)
        odds[self.place] = e
        forward, backward, pairs = self.messages(odds, trans, start)
        alpha = np.zeros((steps, 2, chains), np.float32)
        for t in range(steps):
            k = self.active[t]
            if t == 0:
                a0, a1 = forward[0, :k], forward[1, :k] * odds[0, :k]
            else:
                p0, p1 = alpha[t - 1, 0, :k], alpha[t - 1, 1, :k]
                a0, a1 = p0 * trans[0, 0] + p1 * trans[1, 0], (p0 * trans[0, 1] + p1 * trans[1, 1]) * odds[t, :k]
            total = a0 + a1
            alpha[t, 0, :k], alpha[t, 1, :k] = a0 / total, a1 / total
        marginal = np.zeros(self.shape, np.float32)
        b0 = b1 = np.empty(0, np.float32)
        for t in range(steps - 1, -1, -1):
            k, nxt = self.active[t], (self.active[t + 1] if t + 1 < steps else 0)
            n0, n1 = backward[0, :k].copy(), backward[1, :k].copy()
            if nxt:
                x0, x1 = b0[:nxt], b1[:nxt] * odds[t + 1, :nxt]
                f0, f1 = alpha[t, 0, :nxt], alpha[t, 1, :nxt]
                joint = [f0 * trans[0, 0] * x0, f0 * trans[0, 1] * x1, f1 * trans[1, 0] * x0, f1 * trans[1, 1] * x1]
                z = joint[0] + joint[1] + joint[2] + joint[3]
                pairs += np.array([float((j / z).sum()) for j in joint]).reshape(2, 2)
                n0[:nxt], n1[:nxt] = trans[0, 0] * x0 + trans[0, 1] * x1, trans[1, 0] * x0 + trans[1, 1] * x1
                scale = n0[:nxt] + n1[:nxt]
                n0[:nxt] /= scale
                n1[:nxt] /= scale
            b0, b1 = n0, n1
            m1 = alpha[t, 1, :k] * b1
            marginal[t, :k] = m1 / (m1 + alpha[t, 0, :k] * b0)
        ones = float(marginal[0, self.rank[self.opens]].sum()) if steps else 0.0
        return marginal[self.place], pairs, np.array([self.opens.sum() - ones, ones])


def evidence(chains: Chains, marginal: np.ndarray, n: int) -> np.ndarray:
    """For each text the log odds of its largest marginal, and the log of their sum; -12 and 0 without words."""
    most, added = np.full(n, 6e-6), np.zeros(n)
    np.maximum.at(most, chains.doc, marginal)
    np.add.at(added, chains.doc, marginal)
    most = np.clip(most, 6e-6, 1 - 6e-6)
    return np.column_stack([np.log(most / (1 - most)), np.log1p(added)])


class Field:
    """A fitted field: one weight per feature number, transition and start scores, and the calibration."""

    def __init__(self) -> None:
        self.weights = np.zeros(2**BITS, np.float32)
        self.trans, self.start = np.zeros((2, 2)), np.zeros(2)
        self.calibration = np.array([-3.0, 0.0, 0.0])
        self._seen: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def odds(self, words: list[bytes]) -> np.ndarray:
        seen = self._seen
        if len(seen) > 300_000:
            seen.clear()
        fresh = set(words) - seen.keys()
        if fresh:
            fresh = list(fresh)
            at = np.array([features(w) for w in fresh], np.int64)
            seen.update(zip(fresh, np.exp(np.clip(self.weights[at].sum(1), -12, 12)).tolist()))
        return np.fromiter(map(seen.__getitem__, words), np.float32, len(words))

    def mark(self, texts: list[bytes]) -> tuple[Chains, np.ndarray]:
        chains = Chains(texts)
        return chains, chains.marginals(self.odds(chains.words), np.exp(self.trans), np.exp(self.start))[0]

    def scores(self, chains: Chains, marginal: np.ndarray, n: int) -> np.ndarray:
        return probability(evidence(chains, marginal, n), self.calibration)


def word_labels(chains: Chains, at: np.ndarray, word_of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0/1 for each word of the training texts, from the labels of whole texts. at[w]: the features of word number w.

    A feature's support is the number of different pairs of neighbours it stands between (told apart by a 64-bit hash), so
    copies of a text count once.
    """
    bad = toxic[chains.doc] > 0
    around = word_of * 0x1E3779B97F4A7C15 + bad
    around[1:] += (word_of[:-1] + 1) * 0x3F58476D1CE4E5B9
    around[:-1] += (word_of[1:] + 1) * 0x14D049BB133111EB
    once = np.zeros(len(word_of), bool)
    once[np.unique(around, return_index=True)[1]] = True

    def support(places: np.ndarray) -> np.ndarray:
        by_word = np.bincount(word_of[places], minlength=len(at))
        return np.bincount(at.ravel(), np.repeat(by_word, 6), 2**BITS)

    clean, n_clean = support(once & ~bad), int((once & ~bad).sum())
    least = np.log(max(2, np.count_nonzero(clean + support(once & bad))))
    marks, unexplained, first = np.zeros(2**BITS, bool), toxic > 0, True
    while (left := once & bad & unexplained[chains.doc]).any():
        held = support(left)
        share, base = held / np.maximum(1, held + clean), left.sum() / (left.sum() + n_clean)
        with np.errstate(divide="ignore", invalid="ignore"):
            surprise = (held + clean) * (np.nan_to_num(share * np.log(share / base)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - base))))
        even = share * (1 - base) / np.maximum(1e-12, share * (1 - base) + (1 - share) * base)
        surprise[(even < LEAST_SHARE) | marks] = 0
        fresh = surprise >= (FIRST * least if first else max(least, LATER * surprise.max()))
        if not first and not fresh.any():
            break
        marks, first = marks | fresh, False
        unexplained[chains.doc[marks[at].any(1)[word_of]]] = False
    return (marks[at].any(1)[word_of] & bad).astype(np.float32)


def train(texts: list[bytes], toxic: np.ndarray, words: list[np.ndarray], at: np.ndarray) -> Field:
    """A field without calibration. words: the numbers of each text's words; at: the features of each number."""
    field = Field()
    chains, word_of = Chains(texts, words=False), np.concatenate(words or [np.empty(0)]).astype(np.int64)
    labels = word_labels(chains, at, word_of, toxic)
    grid = np.zeros(chains.shape, np.int8)
    grid[chains.place] = labels
    pairs = np.zeros((2, 2))
    for t in range(chains.shape[0] - 1):
        k = chains.active[t + 1]
        pairs += np.bincount(2 * grid[t, :k] + grid[t + 1, :k], minlength=4).reshape(2, 2)
    cut = chains.first[~chains.opens]  # the first words of segments that go on a chain
    pairs += np.bincount(2 * labels[cut - 1].astype(np.int64) + labels[cut].astype(np.int64), minlength=4).reshape(2, 2)
    first = np.bincount(labels[chains.first[chains.opens]].astype(np.int64), minlength=2).astype(float)
    flat = at.ravel()
    weights = np.zeros(2**BITS)
    weights[:] = -0.5
    trans, start = np.log((pairs + 1) / (pairs + 1).sum(1, keepdims=True)), np.log((first + 1) / (first + 1).sum())
    # Steps of Adagrad on the likelihood of the word labels with a small penalty on squares.
    squares, squares_t = np.full(2**BITS, 1e-6), np.full((2, 2), 1e-6)
    true_words = np.bincount(word_of, labels, len(at))
    for _ in range(STEPS):
        e = np.exp(np.clip(weights[at].sum(1), -12, 12)).astype(np.float32)
        marginal, expected, _ = chains.marginals(e[word_of], np.exp(trans), np.exp(start))
        by_word = true_words - np.bincount(word_of, marginal, len(at))
        g = np.bincount(flat, np.repeat(by_word, 6), 2**BITS) - 0.05 * weights
        squares += g * g
        weights += 0.5 * g / np.sqrt(squares)
        g = pairs - expected - 0.05 * trans
        squares_t += g * g
        trans += 0.1 * g / np.sqrt(squares_t)
    field.weights, field.trans, field.start = weights.astype(np.float32), trans, start
    return field


def fit(texts: list[bytes], toxic: np.ndarray, share: float) -> Field:
    """Fits the field on all texts, and the calibration on what fields fitted on the other parts say of each part."""
    field = Field()
    if not len(texts) or toxic.min() == toxic.max():
        field.calibration = logistic(np.zeros((len(texts), 2)), toxic, share)
        return field
    part = np.zeros(len(texts), np.int64)
    for y in (0, 1):
        own = np.flatnonzero(toxic == y)
        part[own] = np.arange(len(own)) % FOLDS
    numbers: dict[bytes, int] = {}
    words = [np.array([numbers.setdefault(w, len(numbers)) for w in t.translate(WORDS_TABLE).split()], np.int32) for t in texts]
    at = np.array([features(w) for w in numbers], np.int64).reshape(-1, 6)
    seen = np.zeros((len(texts), 2))
    for k in range(FOLDS):
        own, other = np.flatnonzero(part != k), np.flatnonzero(part == k)
        fitted = train([texts[i] for i in own], toxic[own], [words[i] for i in own], at)
        seen[other] = evidence(*fitted.mark([texts[i] for i in other]), len(other))  # nothing is kept of the part's chains
    field = train(texts, toxic, words, at)
    field.calibration = logistic(seen, toxic, share)
    return field


def fit_on(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: tuple[int, int] = ROWS, max_bytes: int = MAX_BYTES) -> Field:
    """A field fitted on a bounded sample of the labelled documents; usable selects labels by doc_id."""
    return fitted_in_task(docs, labels, "toxic", F.lit(True) if usable is None else usable, rows, max_bytes, fit)


def spans_of(chains: Chains, marginal: np.ndarray, texts: list[bytes]) -> list[str]:
    """For each text start:end of its offending runs of words, in code points, comma-joined."""
    out: list[list[str]] = [[] for _ in texts]
    hit = np.flatnonzero(marginal > 0.5)
    breaks = np.flatnonzero((np.diff(hit) > 1) | (np.diff(chains.doc[hit]) > 0)) + 1
    for run in np.split(hit, breaks):
        if len(run):
            d = int(chains.doc[run[0]])
            low, high = int(chains.start[run[0]] - chains.text_start[d]), int(chains.end[run[-1]] - chains.text_start[d])
            before = len(texts[d][:low].decode("utf-8", "replace"))
            out[d].append(f"{before}:{before + len(texts[d][low:high].decode('utf-8', 'replace'))}")
    return [",".join(s) for s in out]


def score_toxicity(docs: DataFrame, field: Field, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans): spans are start:end of offending runs of words in code points, end exclusive."""
    model = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch):
                texts = c.column("text").to_pylist()
                chains, marginal = model.value.mark(texts)
                score = model.value.scores(chains, marginal, len(texts))
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans_of(chains, marginal, texts))], names=["doc_id", "score", "predicted", "spans"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int, spans string")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans); learns from labels whose id is not in the held-out fold."""
    field = fit_on(docs, labels, fold("doc_id", folds) != held_out)
    scored = score_toxicity(docs, field)
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", "predicted", "spans")
