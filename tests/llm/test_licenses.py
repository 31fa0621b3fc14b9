import itertools
import random
import re

import pytest

from folioscan.llm import licenses as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, threshold=m.THRESHOLD):
    w, places, base = words(text), [], set()
    for phrase, label in m.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    labels, score = set(base), 1.0 if base else 0.0
    for template, label in m.TEMPLATES.items():
        tokens, size = set(template.split()), m.block_size(template)
        for at in range(0, max(1, len(w) - size // 2), size // 2):
            share = len(tokens & set(w[at : at + size])) / len(tokens)
            if share >= threshold - 1e-9:
                labels.add(label)
                score = max(score, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_against_brute_force(spark):
    random.seed(9)
    pool = ["under", "the", "mit", "license", "MIT", "cc", "by-nc", "Apache", "version", "2", "x", "gnu", "general", "public", "3", "work", "this", "is", "licensed", "of", "and"]
    texts = [" ".join(random.choice(pool) for _ in range(random.randrange(120))) for _ in range(150)]
    texts += [f"intro\n{t}\nend" for t in m.TEMPLATES] + ["Released under the MIT License.", "under the mit license under the mit license", "filler " * 70 + "licensed under the Apache License, Version 2.0.", "CC BY-NC", "licensed under the apache\nlicense version 2", None, "", "...", "Ünder the mit license", "a " * 20000]
    rows = list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS labels").repartition(2)
    got = [tuple(r) for r in m.license_scan(df).collect()]
    assert sorted(got, key=repr) == sorted([(d, *brute(t)) for d, t in rows], key=repr)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_join_filters_lose_nothing(threshold):
    random.seed(3)
    vocabulary = [f"t{i}" for i in range(12)]
    templates = {" ".join(random.sample(vocabulary, random.randrange(1, 8))): f"l{i}" for i in range(20)}
    index = m.Index(templates, {v.encode(): random.randrange(9) for v in vocabulary}, threshold)
    for _ in range(300):
        block = {v.encode() for v in random.sample(vocabulary, random.randrange(0, 12))}
        expected = {(label, len(set(t.encode().split()) & block) / len(set(t.split()))) for t, label in templates.items()}
        assert set(index.join(block)) == {(label, s) for label, s in expected if s >= threshold - 1e-9}
    assert list(itertools.islice(index.join(set()), 1)) == []


def test_whole_texts_with_few_words_changed(spark):
    texts = []
    for t, label in m.TEXTS.items():
        w = t.split()
        w[len(w) // 2] = "otherword"
        texts.append(("x " * 300 + "\n".join(w) + " y" * 40, label))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in m.license_scan(df).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score >= 0.9 for i, (_, label) in enumerate(texts))


def test_empty(spark):
    assert m.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
