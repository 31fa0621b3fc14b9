import itertools
import random
import zlib

import numpy as np
import pytest

from folioscan.llm import quality as q
from folioscan.llm import toxicity as t
from folioscan.llm.labelled import logistic, probability

BAD = ["idiot", "scumbag", "loweiA", "loweiB", "loweiC"]


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "tu", "re", "sa"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(20, 120))]
        toxic, good = i % 5 == 0, i % 3 != 0
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + " |" for x in w]
        docs.append((i, " ".join(w[:30]) + "\n" + " ".join(w[30:])))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(1500, 1)
    extra = [(None, "idiot " * 3), (5001, None), (5002, ""), (5003, "..."), (5004, "ka lo " * 30000), (3, docs[3][1])]
    labels += [(None, 1, 1), (7, None, None), (99999, 0, 1)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "doc_id AS score", "text AS y")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(docs), {i: (g, x) for i, g, x in labels}


def check(rows, truth, mod, held, cut, n):
    assert len(rows) == n
    right = wrong = 0
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % mod == held)
        if r.held_out and r.doc_id in truth and r.doc_id != 7:
            right, wrong = (right + 1, wrong) if r.predicted == truth[r.doc_id] else (right, wrong + 1)
    assert right / (right + wrong) > 0.95


def test_quality(tables):
    d, labels, docs, truth = tables
    check(q.quality(d, labels).collect(), {i: g for i, (g, _) in truth.items()}, 3, 1, 0.5, d.count())


def test_toxicity(tables):
    d, labels, docs, truth = tables
    rows = t.toxicity(d, labels).collect()
    check(rows, {i: x for i, (_, x) in truth.items()}, 4, 2, 0.3, d.count())
    flagged = [r for r in rows if r.held_out and r.doc_id in docs and truth[r.doc_id][1] and r.spans]
    hit = [docs[r.doc_id][int(s.split(":")[0]) : int(s.split(":")[1])] for r in flagged for s in r.spans.split(",")]
    assert flagged and sum(any(b.lower() in h.lower() for b in BAD) for h in hit) / len(hit) > 0.9


def test_no_labels_and_no_rows(tables):
    d, labels, *_ = tables
    few = d.where("doc_id IN (1, 5001)")
    assert {round(r.score, 3) for r in q.quality(few, labels.limit(0)).collect()} == {0.5}
    assert all(r.predicted == 0 for r in t.toxicity(few, labels.limit(0)).collect())
    assert q.quality(d.limit(0), labels).count() == 0 and t.toxicity(d.limit(0), labels).count() == 0


def test_forward_backward_against_enumeration():
    chains = t.Chains([b"a b c d e", b"x\ny z", b""])
    rng = np.random.default_rng(0)
    e = rng.uniform(0.2, 3, len(chains.words)).astype(np.float32)
    trans, start = rng.uniform(0.2, 1, (2, 2)), np.array([0.7, 0.3])
    marginal, pairs, first = chains.marginals(e, trans, start)
    expected, expected_pairs = [], np.zeros((2, 2))
    for part in ([0, 1, 2, 3, 4], [5], [6, 7]):
        weights = {}
        for tags in itertools.product((0, 1), repeat=len(part)):
            w = start[tags[0]]
            for k, i in enumerate(part):
                w *= (e[i] if tags[k] else 1) * (trans[tags[k - 1], tags[k]] if k else 1)
            weights[tags] = w
        z = sum(weights.values())
        expected += [sum(w for tags, w in weights.items() if tags[k]) / z for k in range(len(part))]
        for tags, w in weights.items():
            for a, b in zip(tags, tags[1:]):
                expected_pairs[a, b] += w / z
    assert marginal == pytest.approx(np.array(expected), abs=1e-5) and pairs == pytest.approx(expected_pairs, abs=1e-4)
    assert first.sum() == pytest.approx(3)


def test_dual_coordinate_descent_is_optimal():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=(60, 4)), np.ones(60)])
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = q.dual_coordinate_descent([(np.arange(5), r) for r in x], y, 5, np.full(60, 1.0), 2000)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in rng.normal(scale=0.05, size=(300, 5)))


def test_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    w = logistic(x[:, None], y, y.mean(), 1e-6)
    assert w == pytest.approx([-1, 2], abs=0.25)
    assert probability(x[:, None], w).mean() == pytest.approx(y.mean(), abs=0.02)


def test_long_chains_are_not_cut(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join("w" for _ in range(n)).encode() for n in (0, 1, 7, 8, 9, 16, 61, 200)] + [b"w w w\n" + b"w " * 33 + b"\n\nw"]
    trans, start = np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.8, 0.2])
    results = []
    for size in (1000, 8, 5):
        monkeypatch.setattr(t, "SEGMENT", size)
        chains = t.Chains(texts)
        odds = np.exp(np.random.default_rng(1).normal(0, 2, len(chains.words))).astype(np.float32)
        results.append(chains.marginals(odds, trans, start))
    for got in results[1:]:
        for a, b in zip(got, results[0]):
            assert np.allclose(a, b, atol=1e-4, rtol=1e-4)
