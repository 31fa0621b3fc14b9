import random
import re
import time

from pyspark.sql import functions as F

from folioscan.functions import text as t


def test_comments_match_python(spark):
    random.seed(1)
    texts = ["".join(random.choice("a%\\\n\r \x85\u2028é") for _ in range(random.randrange(30))) for _ in range(400)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").select("i", t.strip_comments(F.col("s")).alias("x")).collect()
    assert all(r.x == re.sub(r"(?<!\\)%.*", "", texts[r.i]) for r in rows)


def test_strip_matches_python(spark):
    texts = ["  a b ", "\t\n\x0bx\x0c\r", "\u00a0\u2003y\u3000", "", " \x1c\x85"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").select("i", t.strip(F.col("s")).alias("x")).collect()
    assert all(r.x == texts[r.i].strip() for r in rows)


def test_lines_match_splitlines(spark):
    random.seed(2)
    texts = ["".join(random.choice("ab\n\r\x0b\x0c\x1c\x85\u2028") for _ in range(random.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").select("i", t.lines(F.col("s")).alias("x")).collect()
    assert all(r.x == texts[r.i].splitlines() for r in rows)


def test_occurrences_match_finditer(spark):
    random.seed(3)
    pattern = r"(?s)<(.*?)>"
    texts = ["".join(random.choice("<>ab\né") for _ in range(random.randrange(25))) for _ in range(400)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").select("i", t.occurrences(F.col("s"), pattern, 1).alias("m")).collect()
    for r in rows:
        s = texts[r.i]
        found = list(re.finditer(pattern, s))
        assert [(m.start, m.end, m.line, m.end_line, m.text, m.g1) for m in r.m] == [(m.start(), m.end(), s.count("\n", 0, m.start()) + 1, s.count("\n", 0, m.end()) + 1, m[0], m[1]) for m in found]
        assert [m.tail for m in r.m] == [s[m.end() : (found + [None])[k + 1].start() if k + 1 < len(found) else len(s)] for k, m in enumerate(found)]


def test_running_sums(spark):
    random.seed(4)
    rows = [[(random.randrange(9), random.randrange(2)) for _ in range(n)] for n in (0, 1, 127, 128, 129, 256, 1000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<struct<chars:int,lines:int>>")
    for r in df.select("i", t.running(F.col("a")).alias("x")).collect():
        assert [tuple(x) for x in r.x] == [(sum(c for c, _ in rows[r.i][:k]), sum(n for _, n in rows[r.i][:k])) for k in range(len(rows[r.i]))]


def test_time_of_occurrences_is_in_proportion(spark):
    def seconds(n):
        df = spark.createDataFrame([("\\cite{k} a\n" * n,)], "s string").select(t.occurrences(F.col("s"), r"\\cite\{([^}]+)\}", 1).alias("m"))
        began = time.time()
        last = df.select(F.size("m").alias("n"), F.element_at("m", -1).alias("m")).first()
        assert last.n == n and last.m.line == n and last.m.start == 11 * (n - 1)
        return time.time() - began

    seconds(10)
    assert seconds(100_000) < 8 * max(seconds(25_000), 0.5)


def test_quoted(spark):
    texts = ["plain", "it's", 'say "x"', "both ' and \"", "a\nb", "back\\slash"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").select("i", t.quoted(F.col("s")).alias("x")).collect()
    assert all(r.x == repr(texts[r.i]) for r in rows)


def test_prose(spark):
    cases = {r"\maketitle": False, r"\section{Introduction}": False, r"\begin{equation}\end{equation}": False, r"We show that \cite{a} holds.": True, "": False, "ab cd ef": False}
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", t.has_prose(F.col("s")).alias("p")).collect()
    assert {r.s: r.p for r in rows} == cases
