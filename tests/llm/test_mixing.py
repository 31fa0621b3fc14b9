import random
from collections import defaultdict

import numpy as np
import pytest

from folioscan.llm import mixing as m


def test_targets():
    assert m.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert m.targets([1, 100, 100], [5, 2, 1]) == pytest.approx([3, 132, 66])
    assert m.targets([0, 4], [5, 2]) == pytest.approx([0, 4])
    assert m.targets([], []) == []


def test_tree_is_exact_and_repeats():
    quotas = np.array([7, 0, 1000, 3])
    out = m.split_quotas(quotas, 5, 1)
    assert (out.sum(0) == quotas).all() and (out >= 0).all() and (out == m.split_quotas(quotas, 5, 1)).all()
    means = np.mean([m.split_quotas(quotas, 4, s)[0] for s in range(400)], axis=0)
    assert means == pytest.approx(quotas / 4, rel=0.1)


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(8)
    rows = [(i, "w " * random.choice([1, 5, 40, 300]), f"s{i % 4}" if i % 5 else "hot") for i in range(400)]
    rows += [(500, None, "s1"), (501, "", None), (502, "a b\tc", None), (502, "a b\tc", None), (None, "x y", "s2"), (503, " \n", "blank")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id AS size", "text AS bucket")


def test_report(docs, spark):
    got = m.mixing_report(docs).collect()
    assert len(got) == docs.count()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) and len(r.shards) == (r.taken // r.size if r.size else 0)
    assert {r.source: r.source_size for r in got} == dict(size)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert [target[n] for n in names] == pytest.approx(m.targets([size[n] for n in names], [m.WEIGHTS[i % 3] for i in range(len(names))]))
    for n in names:
        assert abs(taken[n] - target[n]) <= max(4, 0.05 * target[n])
    assert sorted(map(repr, got)) == sorted(map(repr, m.mixing_report(docs.repartition(5)).collect()))


def test_mix_follows_the_tree(docs):
    rows = m.mix(docs).collect()
    assert len({(r.doc_id, r.copy) for r in rows if r.doc_id not in (None, 502)}) == len([r for r in rows if r.doc_id not in (None, 502)])
    assert {r.shard for r in rows} <= set(range(m.SHARDS))


def test_empty(docs):
    assert m.mixing_report(docs.limit(0)).count() == 0


def test_rows_without_an_id_are_spread(spark):
    docs = spark.createDataFrame([(None, f"word {i}", "s") for i in range(2000)], "doc_id long, text string, source string")
    rows = m.plan(docs).select("order", "passes", "size").collect()
    assert len({r.order for r in rows}) == 2000
    assert sum(r.passes * r["size"] for r in rows) == 4000
