"""Which checks run, by the flags of a check; checks of one's own as table functions."""

import pytest
from pyspark.sql import functions as F

from folioscan.operators import bib, checks
from folioscan.plans import check as plan
from folioscan.plans import own
from folioscan.sources import lookups

SOURCE = "\\begin{document}\n\\section{One}\nWe claim that it holds \\cite{known}.\n\\begin{figure}\nx\n\\end{figure}\n\\includegraphics{gone.png}\nTODO: add it\n\\end{document}\n"


@pytest.fixture
def corpus(spark, docs_of):
    files = spark.createDataFrame([("b.bib", "@comment{none, x}\n@Preamble{pre, y}\n@article{known, title = {T}, eprint = {2401.00001}}\n@book{loose, title = {U}}\n")], "path string, source string")
    entries = bib.bib_file_entries(files).withColumn("doc_path", F.lit("d0.tex"))
    return plan.Corpus(docs_of(SOURCE), entries, spark.createDataFrame([], "path string"))


def model(requests):
    kind = F.substring_index("request_id", "#", 1)
    raw = F.when(kind == "grammar", '{"issues": [{"message": "g"}]}').when(kind == "review", '{"comments": [{"message": "r"}]}').when(kind == "extract", '{"claims": [{"claim": "c", "cite_keys": ["known"]}]}').otherwise("{}")
    return requests.select("request_id", raw.alias("raw"))


PLAIN = {"artifacts", "figures", "images", "citations"}


@pytest.mark.parametrize(
    "flags, more",
    [({}, {"grammar", "reviewer"}), ({"skip_grammar": True}, {"reviewer"}), ({"skip_reviewer": True, "enable_claims": True}, {"grammar", "claims"}), ({"skip_grammar": True, "skip_reviewer": True}, set())],
)
def test_flags(spark, corpus, flags, more):
    papers = spark.createDataFrame([("T", 0, "T", ["A"], "2001", "abstract", "u", None, None)], "query string, rank int, title string, authors array<string>, year string, abstract string, url string, arxiv string, doi string")
    rows = plan.check(corpus, model, None, lookups.from_table(papers), **flags).collect()
    assert {r.checker for r in rows} == PLAIN | more


def test_references(spark, corpus):
    known = spark.createDataFrame([("arxiv", "2401.00001", False, "nothing")], "target_kind string, target_id string, exists boolean, detail string")
    rows = [r for r in plan.check(corpus, verify=lookups.from_table(known)).collect() if r.checker == "references"]
    assert [(r.severity, r.message) for r in rows] == [("error", "Reference 'known' has arXiv ID '2401.00001' but arXiv knows nothing of it: nothing")]
    verdicts = spark.createDataFrame([("d0.tex", "loose", False, "nothing to look up")], "doc_path string, key string, exists boolean, detail string")
    assert [(r.severity, r.message) for r in checks.references(corpus.entries, verdicts).collect()] == [("info", "Reference 'loose' cannot be verified: it has neither an arXiv ID nor a DOI.")]


def test_entries_of_no_kind_are_skipped(corpus):
    assert sorted((r.key, r.entry_type) for r in corpus.entries.collect()) == [("known", "article"), ("loose", "book")]


@own.row_check("long")
def long_lines(doc_path, source):
    for n, line in enumerate(source.split("\n"), 1):
        if len(line) > 30:
            yield "warning", n, f"{len(line)} in {doc_path}"


def test_own_check_as_table_function(spark, corpus):
    rows = plan.check(corpus, extra=[own.as_checker(long_lines)]).where("checker = 'long'").collect()
    assert [(r.severity, r.line, r.message, r.excerpt) for r in rows] == [("warning", 3, "36 in d0.tex", None)]
    spark.udtf.register("long_lines", long_lines)
    spark.createDataFrame([("a", "x" * 31), ("b", None), ("c", "y\n" + "z" * 40)], "doc_path string, source string").createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT doc_path, line, message FROM long_lines(TABLE(some_docs) PARTITION BY doc_path) ORDER BY doc_path").collect()
    assert [tuple(r) for r in got] == [("a", 1, "31 in a"), ("c", 2, "40 in c")]
