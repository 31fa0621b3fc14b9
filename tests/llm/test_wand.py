"""Ranked search: blocks against every way to cut, results against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from folioscan.llm import wand


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, queries, top=10):
    rows = [(d, terms_of(t)) for d, t in docs]
    n_docs, n_terms = sum(1 for _, w in rows if w), sum(len(w) for _, w in rows)
    df = {}
    for _, w in rows:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in queries:
        scored = []
        for d, w in rows:
            score = 0
            for t in terms_of(text):
                if tf := w.count(t):
                    m = 25 + 75 * len(w) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1):
            out.append((item, rank, d, -score))
    return sorted(out, key=repr)


def least_cost(impacts, cost, cell, most):
    best = [0]
    for i in range(1, -(-len(impacts) // cell) + 1):
        end = min(len(impacts), i * cell)
        best.append(min(best[j] + cost + (end - j * cell) * max(impacts[j * cell : end]) for j in range(max(0, i - most), i)))
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
def test_blocks_cost_least(seed):
    rng = random.Random(seed)
    lists = [[rng.choice((100, 500, rng.randrange(1000))) for _ in range(rng.choice((1, 3, 4, 5, 17, 60, 300)))] for _ in range(25)]
    starts = np.cumsum([0] + [len(x) for x in lists[:-1]])
    cost, cell, most = rng.choice((0, 700, 5000)), 4, 6
    ends, bounds = wand.cut_lists(starts, np.concatenate(lists), cost, cell, most)
    begins = np.concatenate([[0], ends[:-1]])
    assert ends[-1] == sum(map(len, lists)) and set(starts) <= set(begins)
    for start, own in zip(starts, lists, strict=True):
        mine = (begins >= start) & (begins < start + len(own))
        assert all(max(own[b - start : e - start]) == t for b, e, t in zip(begins[mine], ends[mine], bounds[mine], strict=True))
        assert ((ends - begins)[mine] * bounds[mine] + cost).sum() == least_cost(own, cost, cell, most)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "naïve", "Zulu9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(rng.randrange(n * 2), " ".join(rng.choices(vocabulary, weights, k=rng.choice((1, 5, 30, 200))))) for _ in range(n)]
    docs += [(7, None), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (8, ""), (9, "..;:"), (5, "w1 " * 20_000), (6, "Zulu9"), (6, "Zulu9"), (3, "zulu9")]
    queries = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 12))))) for i in range(15)] + [(90, None), (91, "nowhere"), (92, ""), (None, "w1 W1 w2!"), (93, "zulu9"), (93, "zulu9"), (94, "w50 " * 300)]
    return docs, queries


@pytest.mark.parametrize("shard_docs,query_pairs,cost", [(16_384, 200_000, wand.BLOCK_COST), (40, 10, 100_000)])
def test_as_if_all_were_scored(spark, shard_docs, query_pairs, cost, monkeypatch):
    docs, queries = corpus(shard_docs, 400)
    d = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, term string, score double").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in queries], "item_id long, text string, q int")
    got = wand.search(wand.index(d, shard_docs=shard_docs), q, query_pairs=query_pairs)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=repr) == brute(docs, queries)


def test_bounds_skip_documents():
    """A rare term decides: the documents of the common one are never looked up."""
    lists = [(100, (np.arange(5000, dtype=np.uint16), np.full(5000, 500, np.uint32), np.array([0]), np.array([5000]), np.array([500]))), (100, (np.arange(0, 5000, 250, dtype=np.uint16), np.full(20, 9000, np.uint32), np.arange(0, 5000, 250), np.arange(0, 5000, 250) + 1, np.full(20, 9000)))]
    shard, seen = wand._Lists.__new__(wand._Lists), []
    shard.ids, shard.of = np.arange(5000), {b"a": lists[0][1], b"b": lists[1][1]}
    real = wand._Lists.scores
    try:
        wand._Lists.scores = staticmethod(lambda own, docs: (seen.append(len(docs)), real(own, docs))[1])
        found = wand._best(shard, [(b"a", 100), (b"b", 100)], 0, 10)
    finally:
        wand._Lists.scores = staticmethod(real)
    assert found == [(950_000, 250 * i) for i in range(10)] and sum(seen) <= 40


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert wand.ranked_search(none, one).collect() == []
    assert wand.ranked_search(one.withColumnRenamed("item_id", "doc_id"), one.limit(0)).collect() == []
