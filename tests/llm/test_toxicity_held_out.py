"""op7 on the driver's tables: the whole result against plain forward-backward, and held-out labels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import toxicity
from folioscan.llm.common import WORDS_TABLE
from folioscan.llm.labelled import fold, probability
from folioscan.llm.queries import op7_toxicity


def plain_score(field, text: bytes) -> float:
    """A document's score from one line after the other, one word after the other, in doubles."""
    trans, start = np.exp(field.trans), np.exp(field.start)
    most, added = 6e-6, 0.0
    for line in text.split(b"\n"):
        words = line.translate(WORDS_TABLE).split()
        odds = [math.exp(min(12, max(-12, sum(float(field.weights[i]) for i in toxicity.features(w))))) for w in words]
        ahead = []
        for t, o in enumerate(odds):
            a = start if t == 0 else ahead[-1] @ trans
            a = a * np.array([1, o])
            ahead.append(a / a.sum())
        behind = np.ones(2)
        for t in range(len(odds) - 1, -1, -1):
            p = ahead[t] * behind
            most, added = max(most, p[1] / p.sum()), added + p[1] / p.sum()
            behind = trans @ (behind * np.array([1, odds[t]]))
            behind = behind / behind.sum()
    most = min(most, 1 - 6e-6)
    return float(probability(np.array([[math.log(most / (1 - most)), math.log1p(added)]]), field.calibration)[0])


def test_query_equals_plain_forward_backward(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = toxicity.fit_on(docs, labels, fold("doc_id", 4) != 2)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = op7_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.score == pytest.approx(plain_score(field, texts[r.doc_id]), abs=2e-3)
        assert r.predicted == int(r.score >= 0.3)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_documents(spark, sf):
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").where("toxic is not null")
    rows = op7_toxicity(spark, f"/root/testdata/{sf}").where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()
    n = {(r.toxic, r.predicted): r.n for r in rows}
    found, missed, false = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    print(sf, "found", found, "missed", missed, "false", false)
    assert found >= 0.9 * (found + missed)
    assert found >= 0.75 * (found + false)


@pytest.mark.parametrize("texts, toxic", [([b"a calm day", b"you idiot"], [0, 1]), ([b"", b"idiot"], [1, 0]), ([b"", b""], [0, 1]), ([b"one"] * 3 + [b"you idiot"], [0, 0, 0, 1])])
def test_parts_without_a_class(texts, toxic):
    field = toxicity.fit(texts, np.array(toxic, float), 0.5)
    chains, marginal = field.mark(texts)
    assert np.isfinite(field.scores(chains, marginal, len(texts))).all()


def test_words_beside_toxic_words_are_not_marked():
    """A word that always stands in the same documents as a clearer one is left to chance once those are explained."""
    texts = [f"mild a{i} number {i} pass b{i}".encode() for i in range(300)]
    texts += [f"mild idiot {i} idiot here idiot x{i}".encode() for i in range(60)] + [f"mild grobian {i} grobian there grobian y{i}".encode() for i in range(6)]
    toxic = np.array([0.0] * 300 + [1.0] * 66)
    numbers = {w: i for i, w in enumerate(dict.fromkeys(b" ".join(texts).split()))}
    at = np.array([toxicity.features(w) for w in numbers], np.int64)
    chains = toxicity.Chains(texts)
    word_of = np.array([numbers[w] for w in chains.words])
    marked = {w for w, y in zip(chains.words, toxicity.word_labels(chains, at, word_of, toxic)) if y}
    assert {b"idiot", b"grobian"} <= marked
    assert not marked & {b"mild", b"pass", b"number"}
