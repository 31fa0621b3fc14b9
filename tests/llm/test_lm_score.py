import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscan.llm import lm_score as m
from folioscan.llm.eliasfano import EliasFano, Trie


@pytest.mark.parametrize("top", [1, 10, 1000, 10**6, 2**60])
def test_elias_fano(top):
    rng = np.random.default_rng(top % 97)
    v = np.sort(rng.integers(0, top, 3000))
    e = EliasFano(v)
    assert (e[np.arange(len(v))] == v).all()
    x = rng.integers(0, top + 5, 2000)
    index, value = e.successor(x)
    expected = np.searchsorted(v, x)
    assert (index == expected).all() and (value[expected < len(v)] == v[expected[expected < len(v)]]).all()
    none = EliasFano(v[:0])
    assert none.successor(x)[0].max() == 0


def test_trie_round_trip(tmp_path):
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 60, (900, 2)), axis=0)
    count = rng.integers(1, 9, len(pairs))
    for path in (None, str(tmp_path / "levels")):
        trie = m.build_trie(pairs[:, 0], pairs[:, 1], count, path=path)
        known = {tuple(p): c for p, c in zip(pairs.tolist(), count.tolist())}
        sums = Counter()
        for (a, _), c in known.items():
            sums[a] += c
        asked = np.array([(a, b) for a in range(62) for b in range(62)])
        p, w = trie.find(asked[:, 0], asked[:, 1])
        for (a, b), x, y in zip(asked.tolist(), Trie.decode(p), Trie.decode(w)):
            assert (x > 0) == ((a, b) in known) and (y > 0) == (a in sums)
            if x:
                assert x == pytest.approx((known[a, b] - 0.75) / sums[a], rel=0.005)


def brute(rows, discount=0.75):
    texts = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in t or ""))
        texts.append((d, d is None or zlib.crc32(str(d).encode()) % 5 != 1, [*w, None]))
    c = Counter(x for _, learn, w in texts if learn for x in w)
    n, v = sum(c.values()), len(c)
    after = defaultdict(Counter)
    for _, learn, w in texts:
        if learn:
            for a, b in zip(["<s>", *w], w):
                after[a][b] += 1
    out = []
    for d, learn, w in texts:
        uni = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
        score = 0.0
        for a, b in zip(["<s>", *w], w):
            h = after.get(a)
            s = sum(h.values()) if h else 0
            score += math.log10(uni(b) if not h else max(h[b] - discount, 0) / s + discount * len(h) / s * uni(b))
        out.append((d, not learn, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(uni(x)) for x in w), score))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def test_against_brute_force(spark):
    random.seed(6)
    pool = ["the", "The", "a", "é", "x.", "y", *(f"w{i}" for i in range(40))]
    rows = [(i, random.choice([" ", "\n", "\t "]).join(random.choice(pool) for _ in range(random.randrange(40)))) for i in range(80)]
    rows += [(None, None), (3, ""), (3, ""), (None, "a b"), (200, "unseen words only"), (201, "the " * 4000), (202, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS g", "text AS learn").repartition(3)
    results = []
    for sizes in ({"bucket_bytes": 300, "shard_bytes": 900}, {}, {"bucket_bytes": 2000, "shard_bytes": 200, "hot": 20}, {"shard_bytes": 400, "hot": 5}):
        got = sorted((tuple(r) for r in m.lm_score(df, **sizes).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))
        for a, b in zip(got, brute(rows), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=0.003 * b[2] + 1e-6)
        results.append(got)
    for got in results[1:]:  # how rows are dealt changes nothing
        for a, b in zip(got, results[0], strict=True):
            assert a[6] == pytest.approx(b[6], abs=1e-9 * max(1, b[2]))


def test_empty(spark):
    assert m.lm_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
