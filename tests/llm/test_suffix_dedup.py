import hashlib
import random

import numpy as np
import pytest
import xxhash

from folioscan.llm import suffix_dedup as s
from folioscan.llm.common import NO_ID


def brute(rows, length):
    seen, out = set(), []
    hashed = lambda t: np.uint64(xxhash.xxh64_intdigest(t, seed=42)).astype(np.int64)
    for d, _, t in sorted((NO_ID if d is None else d, hashed((t or "").encode()), (t or "").encode()) for d, t in rows):
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(t[i : i + length])
        kept = bytes(b for b, c in zip(t, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((d, len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


@pytest.mark.parametrize("length, gram", [(100, 32), (40, 16), (9, 8)])
def test_against_brute_force(spark, length, gram):
    random.seed(length)
    base = ["".join(random.choice("abcdeé ") for _ in range(300)) for _ in range(6)]
    part = lambda: random.choice([random.choice(base)[random.randrange(100) : random.randrange(100, 300)], "".join(random.choice("ab ") for _ in range(random.randrange(60))), "x" * random.randrange(250), "abc" * random.randrange(80)])
    rows = [(random.choice([i, i, i, 7, None]), random.choice(["".join(part() for _ in range(random.randrange(6))), None])) for i in range(90)]
    rows += [rows[0], rows[0], (1000, base[0] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS g", "text AS meta").repartition(3)
    for hot in (s.HOT_RUNS, 2):
        got = s.suffix_dedup(df, length, gram, bucket_bytes=2000, shard_bytes=3000, hot_runs=hot, with_text=True).collect()
        assert sorted((NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == brute(rows, length)


def test_refinement_sorts_suffixes():
    rng = np.random.default_rng(2)
    strings = [rng.choice(list(b"ab"), n).astype(np.uint8).tobytes() for n in (60, 5, 40, 80)] + [b"a" * 70, b""]
    sizes = np.array([len(x) for x in strings])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings), np.uint8)
    pointer = s.refine(data, starts, sizes, 20)
    suffixes = sorted((x[i : i + 20], int(starts[k] + i)) for k, x in enumerate(strings) for i in range(len(x) - 19))
    for (a, i), (b, j) in zip(suffixes, suffixes[1:]):
        assert (pointer[i] == pointer[j]) == (a == b) and pointer[i] <= pointer[j]


def test_a_bucket_sends_a_hot_window_once():
    import pyarrow as pa

    shared = bytes(range(33, 33 + 80)) * 2
    docs = pa.table({"doc_id": list(range(60)), "text": [b"%03d" % i * 9 + shared + b"%03d" % i * 9 for i in range(60)], "mark": [0] * 60, "g": pa.array([0] * 60, pa.int32())})
    values = np.unique(s.runs(np.frombuffer(b"".join(docs.column("text").to_pylist()), np.uint8), np.arange(60) * 214, np.arange(1, 61) * 214)[0])
    answers = pa.table({"vals": [values.tobytes()], "hot": [np.ones(len(values), bool).tobytes()]})
    out = s._send_runs(3, 100, 32)(docs, answers)
    sent = [c for k, m, b in zip(out.column("kind").to_pylist(), out.column("meta").to_pylist(), out.column("content").to_pylist()) if k for c in [b[i : i + 100] for i in range(0, len(b), 100)]]
    assert len(sent) == len(set(sent)) > 60


def test_edges(spark):
    assert s.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        s.suffix_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 100, 30)
