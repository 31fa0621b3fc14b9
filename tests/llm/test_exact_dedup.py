import hashlib
import random
from collections import defaultdict

import pytest

from folioscan.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string"


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for d, t in rows:
        ids = [i for i in groups[t or ""] if i is not None]
        out.append((d, max(ids, default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, batches", [(4, 1), (7, 10**5), (4096, 10**5)])
def test_against_brute_force(spark, block, batches):
    random.seed(block)
    parts = ["".join(random.choice("aé") for _ in range(random.randrange(1, 12))) for _ in range(5)]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(5))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "other"), (None, texts[1]), (None, None), (99, "x" * 9000), (98, "x" * 9000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "doc_id AS batch", "text AS name").repartition(3)
    got = exact_dedup(df, block, batches).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(rows)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
