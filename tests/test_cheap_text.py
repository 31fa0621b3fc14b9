"""Cheaper ways through a text give what the plain ones give, and the whole check keeps one set of entries per bibliography."""

from pyspark.sql import functions as F

from folioscan.functions import text as t
from folioscan.operators import checks
from folioscan.plans import check as whole
from folioscan.plans import queries as q
from folioscan.rules import RULES
from folioscan.sources import derived as d


def test_text_functions(spark):
    blanks = t.WHITESPACE
    texts = ["", blanks, f"{blanks}a{blanks}b c{blanks}", "ä\x85", "a\r\nb\rc d\n", "a\n\nb", "\n", "50\\% % gone\nx", "no comment", "x" * 300 + " abc \\cite{abc} defg hij", "abc \\textbf{abc} abc", "abc abc abc \\x", None, "\U0001f600 　"]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    s = F.col("s")
    trimmed = df.select(t.strip(s).alias("a"), F.btrim(s, F.lit(blanks)).alias("b"), t.is_filled(s).alias("c"), (F.btrim(s, F.lit(blanks)) != "").alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in trimmed)
    plain = df.select(t.strip_comments(s).alias("a"), F.regexp_replace(s, t.COMMENT, "").alias("b"), t.has_prose(s).alias("c"), (t.words(s) >= 3).alias("d"), t.newlines(s).alias("e")).collect()
    assert all(r.a == r.b and r.c == r.d for r in plain) and [r.e for r in plain] == [None if x is None else x.count("\n") for x in texts]
    parts = df.select(s, t.lines(s).alias("a"), F.split(s, t.LINE_END, -1).alias("b")).collect()
    assert all(r.a == (r.b[:-1] if r.b and r.b[-1] == "" else r.b) for r in parts)


def test_body_ends_at_the_first_mark(docs_of):
    b, e, bib = t.BEGIN, t.END, t.BIBLIOGRAPHY
    docs = docs_of(f"{e}{b}\nx{bib}y{e}", f"{b}x{e}y{bib}", f"p{b}rest", "none" + e, f"a{b}b{b}c")
    got = docs.withColumn("o", t.body_offset(F.col("source"))).select("doc_path", t.body(F.col("source"), F.col("o")).alias("b"), t.preamble(F.col("source")).alias("p")).orderBy("doc_path").collect()
    assert [(r.b, r.p) for r in got] == [("x", e), ("x", ""), ("rest", "p"), ("none" + e, ""), (f"b{b}c", "a")]


def test_guards_lose_nothing(spark):
    """Every text planted for a rule holds one of its guards and one of its further texts; so do the other forms of the rules that have such."""
    more = ["Here is an analysis", "here is a description", "HERE IS A 3 page overview", "here is an outline", "here is an explanation", "put your results here", "insert here? insert details here", "I don't", "I n't cannot retrieve", "I do not can look up", "I not have access to real-time data", "\\label{ fixme}", "\\label{a replace b}", "\\label{DRAFT}"]
    df = spark.createDataFrame([(x,) for x in more], "b string").unionByName(spark.range(20).selectExpr("id AS doc_id").selectExpr(f"{d.rule_case(0)} AS b")).withColumn("low", F.lower("b"))
    for r in RULES:
        assert df.where(F.col("b").rlike(r.pattern) & (F.size(checks._rule_matches("b", "low", (r,))) == 0)).count() == 0, r.number


def test_one_set_of_entries_per_bibliography(spark, tmp_path, monkeypatch):
    """The entries of a bibliography that many documents name are not copied to each of them before they are checked."""
    spark.createDataFrame([(i, "word " * 5) for i in range(1, 601, 6)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"Title {i}") for i in range(20)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    seen = []
    monkeypatch.setattr(whole, "check", lambda corpus, *a, **b: seen.append(corpus) or corpus.docs)
    q._whole(spark, str(tmp_path))
    assert seen[0].members is not None and seen[0].entries.count() < 100 and seen[0].own_entries().count() >= 100 * 20
