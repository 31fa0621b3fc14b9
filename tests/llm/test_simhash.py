import numpy as np
import pytest
import xxhash

from folioscan.llm import simhash as s
from folioscan.llm.hashing import xxh64


def slow_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return [find(i) for i in range(n)]


def test_hash_of_many_ranges():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 4000, dtype=np.uint8).tobytes()
    start = rng.integers(0, 3800, 500)
    end = start + rng.integers(0, 120, 500)
    assert [int(h) for h in xxh64(data, start, end)] == [xxhash.xxh64_intdigest(data[a:b], seed=42) for a, b in zip(start, end)]


def cluster(rng, base, n, flips):
    out = np.full(n, base)
    for _ in range(flips):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return out


@pytest.fixture(scope="module")
def codes():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    parts = [base, *(cluster(rng, b, 6, 3) for b in base[:60]), cluster(rng, base[0], 1500, 3), np.zeros(1, np.uint64)]
    return np.unique(np.concatenate(parts))


def test_index_finds_every_neighbour(codes):
    c = codes[np.argsort(s.gray_rank(codes))]
    near = np.bitwise_count(c[:, None] ^ c[None, :]) <= 3
    assert sorted(zip(*s.GrayIndex(c).search(c, 3))) == sorted(zip(*np.nonzero(near)))
    assert list(s._links_of_run(c, 3)) == roots(len(c), zip(*np.nonzero(near)))


@pytest.mark.parametrize("most", [None, 100])
def test_components_against_all_pairs(spark, codes, most):
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    got = {r.node: r.root for r in s.components(s.links(fps, 3, most=most)).collect()}
    near = np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3, 1)
    expected = roots(len(codes), zip(*np.nonzero(near)))
    ids = codes.view(np.int64).tolist()
    by = {}
    for i, r in zip(ids, expected):
        by.setdefault(r, set()).add(i)
    mine = {}
    for i in ids:
        mine.setdefault(got.get(i, i), set()).add(i)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, mine.values()))


def test_hot_band_values_are_split(spark, codes):
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    groups = s.banded(fps, 4, 100).selectExpr("path", "shiftrightunsigned(turned, 64 - fixed) AS value", "fp", "turned", "fixed").collect()
    sizes = {}
    for r in groups:
        sizes.setdefault((r.path, r.value), []).append(r)
    assert max(r.fixed for r in groups) > 16 and all(len(x) <= 100 or x[0].fixed >= 64 - s.LEFT for x in sizes.values())
    for rows in sizes.values():  # turning the bits keeps the differences
        a = np.array([r.fp for r in rows]).view(np.uint64)
        b = np.array([r.turned for r in rows]).view(np.uint64)
        assert (np.bitwise_count(a ^ a[0]) == np.bitwise_count(b ^ b[0])).all()


def test_documents(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(5, " ".join(words)), (2, " ".join([*words[:150], "other", *words[151:]])), (9, "W0  w1\tw2"), (1, "w0 w1 w2"), (1, "w0 w1 w2"), (None, None), (7, ""), (8, "x y"), (None, "x  Y"), (4, "ü " * 5000)]
    got = s.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS fp")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((d is None, d or 0, format(slow_fingerprint(t), "016x")) for d, t in rows)
    group = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    fp = lambda t: format(slow_fingerprint(t), "016x")
    assert group[9, fp("w0 w1 w2")] == 1 and group[None, fp("x y")] == 8 and group[None, fp("")] == 7 and group[5, fp(rows[0][1])] == 2
    assert s.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
