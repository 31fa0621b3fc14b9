import hashlib
import math
import random
import re
import time
from collections import Counter

from folioscan.llm import pii as p

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def report(rows):
    out = Counter()
    for d, text in rows:
        spans = base(text)
        n = Counter(s[3] for s in spans)
        out[(d, *(n[k] for k in p.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest())] += 1
    return out


def test_base_against_python(spark):
    random.seed(11)
    bits = ["a@b.c", "x@y", ".", "1.2.3.4", "255.256.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (462) 555-7216", "+", "1", "22", " ", "-", "é", "@", "%", "_", "(", ")", "\n", "w"]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randrange(25)))) for i in range(400)]
    rows += [(None, None), (3, ""), (3, ""), (None, "a@b.c"), (900, "a" * 4000 + " " + "1" * 4000 + " " + "1." * 3000), (901, "é " * 30_000 + "a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS id", "text AS spans")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in p.pii_report(df).collect())
    assert got == report(rows)


def low(text):
    return "".join(chr(ord(c) | 32) if "A" <= c <= "Z" else c for c in text)


def all_spans(rows, disclosure=p.DISCLOSURE, prior=p.PRIOR, context=p.CONTEXT):
    """Base and term spans of every row, by the definitions."""
    term = re.compile(p.TERM.replace("++", "+"))
    places, base_of = {}, []
    for k, (_, text) in enumerate(rows):
        text = text or ""
        base_of.append(base(text))
        for start, rank, end, kind in base_of[-1]:
            around = [m.span() for m in re.finditer(PATTERNS[kind], text)]
            before = max([b for _, b in around if b <= start], default=0)
            after = min([a for a, _ in around if a >= end], default=len(text))
            low_end = max(before, start - context, text.rfind("\n", 0, start) + 1)
            high_end = min(after, end + context, text.find("\n", end) if "\n" in text[end:] else len(text))
            for m in term.finditer(low(text)):
                if low_end <= m.start() and m.end() <= start or end <= m.start() and m.end() <= high_end:
                    places.setdefault(f"{kind}:{low(text[start:end])}", set()).add((k, m.start(), m.end(), m[0]))
    n_term = Counter(w for _, text in rows for w in term.findall(low(text or "")))
    n = sum(n_term.values())
    out = [list(b) for b in base_of]
    extra = set()
    for held in places.values():
        both = Counter(w for *_, w in held)
        share = len(held) / n
        extra |= {(k, a, b) for k, a, b, w in held if share < 1 and math.log(both[w] / (n_term[w] + prior) / share) >= disclosure * -math.log(share) - 1e-12}
    for k, a, b in extra:
        if not any(s[0] < b and a < s[2] for s in base_of[k]):
            out[k].append((a, len(p.KINDS), b, "term"))
    return [(rows[k][0], ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(x))) for k, x in enumerate(out)]


def test_terms_against_brute_force(spark):
    random.seed(5)
    pool = ["the", "of", "and", "to", "é", *(f"w{i}" for i in range(60))]
    rare = iter(range(10**6))
    values = ["bob@corp.com", "eve@x.org", "+1 (462) 555-7216", "10.0.0.1", "4111 1111 1111 1111", "x.1@y.z"]
    rows = []
    for i in range(120):
        bits = []
        for _ in range(random.randrange(40)):
            bits.append(random.choice([random.choice(pool), random.choice(pool), random.choice(pool), f"Rare{next(rare)}", random.choice([random.choice(values), f"p{i}@x{i}.org"]) if random.random() < 0.2 else "the", random.choice(["\n", "of", "é" + random.choice(values) + "x"])]))
        rows.append((random.choice([i, None, 3]), " ".join(bits)))
    rows += [(None, " ".join(random.choice(pool) for _ in range(50))) for _ in range(400)]
    rows += rows[:3] + [(None, None), (1, ""), (2, "call +1 (462) 555-7216 or 462.555.7216.1 4111111111111111")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS row", "text AS spans").repartition(3)
    expected = all_spans(rows)
    assert sum("term" in x for _, x in expected) > 10
    assert Counter((r.doc_id, r.spans) for r in p.pii_report(df).collect()) == Counter(expected)


def test_what_is_said_of_a_person(spark):
    rows = [(i, f"word{i} Zorblax met bob@corp.com number {i % 3}\nother line {i} with the text") for i in range(5)]
    rows += [(20 + i, f"plain met number {i} with the text of it word{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in p.pii_report(df).collect()}
    for i in range(5):
        assert "term:6:13,email:18:30" in got[i].spans and "term:14:17" not in got[i].spans  # the name, not the verb
    assert all(got[20 + i].spans == "" for i in range(300))
    texts = {r.doc_id: r.text for r in p.sanitise(df).collect()}
    assert "Zorblax" not in texts[1] and "[EMAIL]" in texts[1] and texts[25] == dict(rows)[25] and len(texts) == len(rows)


def test_very_many_matches(spark):
    text = "10.0.0.1 at a@b.co +1 (462) 555-7216 or 12 " * 8000
    began = time.time()
    r = p.pii_report(spark.createDataFrame([(1, text), (2, "1 " * 100_000), (3, "a@b.co\n" * 30_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(x.n_ip, x.n_email, x.n_phone) for x in r] == [(8000, 8000, 8000), (0, 0, 0), (0, 30_000, 0)]
    assert time.time() - began < 120


def test_no_python_in_the_plan(spark):
    plan = p.pii_report(spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    assert p.pii_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
