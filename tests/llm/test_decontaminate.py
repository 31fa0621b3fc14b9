import hashlib
import random
import re

from folioscan.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        w, hit, found, longest = words(text), set(), set(), 0
        for item_id, item in items:
            v = words(item)
            for i in range(max(1, len(v) - n + 1) if v else 0):
                window = v[i : i + n]
                for j in range(len(w) - len(window) + 1):
                    if w[j : j + len(window)] == window:
                        hit |= set(range(j, j + len(window)))
                        found.add(str(item_id))
                        k = len(window)
                        while i + k < len(v) and j + k < len(w) and v[i + k] == w[j + k]:
                            k += 1
                        longest = max(longest, k)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), longest))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    random.seed(4)
    pool = [*"abcde", "Éa", "x1"]
    items = [(i, " ".join(random.choice(pool) for _ in range(random.randrange(25)))) for i in range(12)] + [(50, "A b."), (51, "a, B"), (52, None), (53, ""), (10, "!!"), (9, "zz a b c d e a b c d e")]
    docs = [(i, " ".join(random.choice(pool) for _ in range(random.randrange(60)))) for i in range(25)]
    docs += [(100 + i, f"new words {random.choice(items)[1] or ''} and\nmore {items[k][1] or ''}") for i, k in enumerate(range(12))] + [(None, None), (3, ""), (3, ""), (7, "b a " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS item_id").repartition(2)
    got = d.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest_words) for r in got], key=repr) == brute(docs, items)
    for r in got:
        if r.longest_words:
            own = [words(v) for k, v in items if str(k) == r.longest_item]
            parts = [words(t)[r.longest_at : r.longest_at + r.longest_words] for k, t in docs if k == r.doc_id]
            assert any(item[i : i + len(part)] == part for item in own for part in parts for i in range(len(item)) if part)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    items = [(i, f"p{i} q r s t u v w x y z{i}") for i in range(6)]
    docs = spark.createDataFrame([(i, f"a p{i} q r s t u v w x y z{i} b") for i in range(6)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 30)
    assert sorted(map(tuple, d.decontaminate(docs, bench).collect())) == whole and all(r[2] == 11 for r in whole)


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in d.decontaminate(docs, bench).collect()] == [False]
    assert d.decontaminate(docs.limit(0), bench).count() == 0
