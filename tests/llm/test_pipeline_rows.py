"""Each stage of the pipeline against brute force, on documents with null and repeated ids."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as c
from folioscan.llm import decontaminate, mixing, simhash, toxicity

DATA = Path("/root/testdata/sf0.001")
SF = str(DATA)
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    """Every third id null, every seventh the id of another text; n_chars numbers the rows. All are copied once under other ids."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    ids = [None if i % 3 == 0 else rows[0].doc_id if i % 7 == 0 else r.doc_id for i, r in enumerate(rows)]
    out = [(d, r.text, r.lang, r.source) for d, r in zip(ids, rows)] + [(None if i % 2 else 10**6 + i // 4, r.text, r.lang, r.source) for i, r in enumerate(rows)]
    out = [(*r, i) for i, r in enumerate(out)]
    return c.written(spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))


def tags(df):
    return sorted(r.n_chars for r in df.select("n_chars").collect())


def test_toxic(spark, docs):
    field = toxicity.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    scores = field.scores(*field.mark(texts), len(texts))
    stay = sorted(r.n_chars for r, s in zip(rows, scores) if s < toxicity.THRESHOLD)
    assert len(stay) < len(rows)
    assert tags(c.toxic(spark, docs, SF)) == stay


def test_near(spark, docs):
    rows = docs.collect()
    fps = simhash.fingerprints_of([(r.text or "").encode() for r in rows])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= simhash.DISTANCE).tolist():
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    groups = defaultdict(list)
    for r, g in zip(rows, label):
        groups[g].append(r)
    kept = c.near(spark, docs, SF).collect()
    group_of = {r.n_chars: g for r, g in zip(rows, label)}
    assert Counter(group_of[r.n_chars] for r in kept) == Counter(dict.fromkeys(groups, 1))  # one of each group
    for r in kept:
        ids = [x.doc_id for x in groups[group_of[r.n_chars]] if x.doc_id is not None]
        assert r.doc_id == min(ids, default=None)


def test_decontaminated(spark, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    n = decontaminate.WINDOW
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    sizes = {len(x) for x in windows}
    hit = lambda t: any(tuple(w[i : i + k]) in windows for w in [words(t)] for k in sizes for i in range(len(w) - k + 1))
    stay = sorted(r.n_chars for r in docs.collect() if not hit(r.text))
    assert 0 < len(stay) < docs.count()
    assert tags(c.decontaminated(spark, docs, SF)) == stay


def test_mixed(spark, docs):
    rows = docs.collect()
    size = {r["n_chars"]: r["size"] for r in docs.select("n_chars", mixing.words(docs.text).alias("size")).collect()}
    source_of = {r.n_chars: r.source for r in rows}
    total = Counter()
    for k, s in size.items():
        total[source_of[k]] += s
    names = sorted(total, key=lambda s: (s is None, s or ""))
    aims = dict(zip(names, mixing.targets([total[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    copies, taken = defaultdict(list), Counter()
    for r in c.mixed(spark, docs, SF).collect():
        copies[r.n_chars].append(r.copy)
        taken[r.source] += size[r.n_chars]
    for got in copies.values():
        assert sorted(got) == list(range(len(got))) and len(got) <= mixing.MOST  # each row by itself: no copy twice
    for n in names:
        assert abs(taken[n] - aims[n]) <= max(s for k, s in size.items() if source_of[k] == n)  # documents are not cut
        whole = int(aims[n] // total[n]) if total[n] else 0
        assert all(len(copies[k]) in (whole, whole + 1) for k, s in size.items() if s and source_of[k] == n)  # null ids too
