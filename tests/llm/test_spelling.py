"""Spelling variants: the pairs against all pairs, the result against a plain reading of its definition."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folioscan.llm.spelling import near_pairs, spelling_variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(rows, key=lambda r: r[0])


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def dense(text):
    """Words close to one another: every base word with edits at each place."""
    out = [text]
    for i in range(len(text)):
        out += [text[:i] + text[i + 1 :], text[:i] + "a" + text[i:], text[:i] + "é" + text[i + 1 :], text[:i] + text[i] + text[i:]]
    return out


@pytest.mark.parametrize("group_pairs", [1, 20, 10_000])
def test_pairs_are_all_pairs(spark, group_pairs):
    vocabulary = sorted({w for base in ("aaaaaaa", "aaaaaaaa", "banana bread".replace(" ", ""), "aabbaabb", "coniosa", "xyzzyxyz") for w in dense(base)})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(vocabulary)], "word string, n long")
    rows = [(r.word, r.other) for r in near_pairs(df, group_pairs).collect()]
    assert len(rows) == len(set(rows))
    assert sorted(rows) == sorted((a, b) for a in vocabulary for b in vocabulary if one_edit(a, b))


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abé", min_size=7, max_size=9), min_size=1, max_size=60, unique=True))
def test_pairs_of_any_words(spark, vocabulary):
    df = spark.createDataFrame([(w, 1) for w in vocabulary], "word string, n long")
    rows = sorted((r.word, r.other) for r in near_pairs(df, 2).collect())
    assert rows == sorted((a, b) for a in vocabulary for b in vocabulary if one_edit(a, b))


def test_result_with_chains_ties_and_marks(spark):
    docs = [
        (1, "Caballero " * 200 + "caballera " * 15 + "caballerÁ " * 15 + "caballeras caballeras"),
        (2, "CABALLERO, caballeros caballeros caballeros! caballéro caballéro Étérnelle Étérnelle"),
        (3, None), (None, "ordinary ordinary ordinart ordinart"), (4, ""), (4, "short words only"), (5, "x" * 5000 + " " + "x" * 5000), (6, "ordinary " * 30), (6, "ordinary " * 30),
    ] + [(100 + i, "variable variables variabel zigzagged") for i in range(90)]
    df = spark.createDataFrame([(d, t, "k", 0, "w") for d, t in docs], "doc_id long, text string, key string, n long, word string")
    assert got(spelling_variants(df)) == brute(docs)


def test_no_rows(spark):
    assert got(spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert got(spelling_variants(spark.createDataFrame([(1, "nothing repeated anywhere")], "doc_id long, text string"))) == []
