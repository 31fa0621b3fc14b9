import pytest
from pyspark.sql import functions as F

from folioscan.operators import checks, parse, report
from folioscan.rules import RULES

HITS = {
    "R01": "Here is a 100-word summary of it.",
    "R02": "Would you like me to expand on this?",
    "R03": "I'd be happy to help.",
    "R04": "Id be glad to.",
    "R05": "Please fill in with the real numbers.",
    "R06": "The data is illustrative.",
    "R07": "This is a sample table.",
    "R08": "Insert your content here.",
    "R09": "[insert figure here]",
    "R10": "As an AI language model it stops.",
    "R11": "I do n't have access to the internet.",
    "R12": "I can't provide that.",
    "R13": "I'm sorry, but I refuse.",
    "R14": "\\caption{Insert caption\nhere}",
    "R15": "\\label{fig:todo}",
    "R16": "\\lipsum[1-2]",
    "R17": "\\blindtext[3]",
    "R18": "TODO: add this",
    "R19": "FIXME now",
    "R20": "\\begin{tabular}{ll}\nA & 1 \\\\\nB & 2 \\\\\nC & 3 \\\\\n\\end{tabular}",
}


def found(df):
    return [(r.severity, r.line, r.message, r.excerpt) for r in report.numbered(df).orderBy("doc_path", "seq").collect()]


def test_each_rule_finds_its_sentence(docs_of):
    docs = docs_of(*[(n, s) for n, s in HITS.items()])
    got = checks.artifacts(docs).select("doc_path", "message").collect()
    for rule in RULES:
        assert (rule.number, rule.message) in {(r.doc_path, r.message) for r in got}, rule.number


def test_clean_text_and_quirks(docs_of):
    docs = docs_of("A clean text about results. I cannot browse it, I don't have access to the internet.", "has an AI model", "\\label{sec:placeholder}\n\\begin{document}\nx\nTODO: add\n\\end{document}\nFIXME")
    got = report.numbered(checks.artifacts(docs)).orderBy("doc_path", "seq").collect()
    assert [(r.doc_path, r.severity, r.line) for r in got] == [("d1.tex", "error", 1), ("d2.tex", "warning", 4), ("d2.tex", "error", 1)]


def test_figures(docs_of):
    good = "\\begin{figure}\n\\includegraphics{a.png}\n\\caption{A curve.}\n\\label{f}\n\\end{figure} \\ref{f}"
    assert found(checks.figures(docs_of(good))) == []
    bare = "\\begin{figure}\n\\includegraphics{a.png}\n\\label{f}\n\\end{figure} \\ref{f}"
    got = found(checks.figures(docs_of(bare)))
    assert len(got) == 1 and got[0][0] == "error" and "missing" in got[0][2]
    got = found(checks.figures(docs_of("\\begin{table}\n\\caption{Insert caption here}\n\\label{t}\n\\end{table} \\autoref{t}")))
    assert [g[0] for g in got] == ["error", "warning", "warning"]
    assert "placeholder" in got[0][2] and "not referenced" in got[1][2] and "Near-empty" in got[2][2]
    assert found(checks.figures(docs_of("\\begin{figure}\n\\caption{}\nsome words here\n\\end{figure}"))) == []


def test_images(docs_of, spark):
    files = spark.createDataFrame([("p/good.png",), ("p/results.pdf",), ("up.eps",)], "path string")
    docs = docs_of(("p/m.tex", "\\includegraphics{good.png}\n\\includegraphics[w]{bad.jpg}\n\\includegraphics{also_missing.png}\\includegraphics{results}\\includegraphics{ }\\includegraphics{appendix.tex}\\includegraphics{../up}\\includegraphics{./good.jpg}"))
    got = found(checks.images(docs, files))
    assert [(g[1], g[3]) for g in got] == [(2, "bad.jpg"), (3, "also_missing.png")]


def entries(spark, *rows):
    full = [("d0.tex", i, k, "article", f, n, title, "", eprint, doi) for i, (k, f, n, title, eprint, doi) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_path string, bib_idx int, key string, entry_type string, file string, line int, title string, author string, eprint string, doi string")


def test_citations(docs_of, spark):
    none = entries(spark, ("x", "b", 1, "", "", "")).limit(0)
    assert [(g[0], g[1], g[3]) for g in found(checks.citations(docs_of("\\cite{ghost}"), none))] == [("error", 1, "\\cite{ghost}")]
    bib = entries(spark, ("k", "a.bib", 10, "", "", ""), ("k", "a.bib", 20, "", "", ""), ("u", "b.bib", 5, "", "", ""), ("k", "b.bib", 30, "", "", ""))
    got = found(checks.citations(docs_of("\\cite{k}"), bib))
    assert [(g[0], g[1]) for g in got] == [("warning", 20), ("warning", 30), ("info", 5)]
    assert "first defined at a.bib:10" in got[1][2]


def test_references(spark):
    bib = entries(spark, ("a", "b", 1, "", "arXiv:2401.12345v2", "10.1/x"), ("b", "b", 2, "", "", "10.1/y"), ("c", "b", 3, "", "", ""), ("a", "b", 4, "", "", ""), ("d", "b", 5, "", "math/9901001", "10.1/z"))
    targets = {r.key: (r.target_kind, r.target_id) for r in checks.verify_targets(bib).where("bib_idx <> 3").collect()}
    assert targets == {"a": ("arxiv", "2401.12345v2"), "b": ("doi", "10.1/y"), "c": (None, None), "d": ("doi", "10.1/z")}
    verdicts = spark.createDataFrame([("d0.tex", k, False, "gone") for k in "abcd"], "doc_path string, key string, exists boolean, detail string")
    got = found(checks.references(bib, verdicts))
    assert [(g[0], g[1]) for g in got] == [("error", 1), ("error", 2), ("info", 3), ("info", 4), ("error", 5)]
    assert "arXiv" in got[0][2] and "DOI" in got[1][2] and "cannot be verified" in got[2][2] and "arXiv" in got[4][2]
    assert found(checks.references(bib, verdicts.selectExpr("doc_path", "key", "true AS exists", "detail"))) == []


@pytest.mark.parametrize("source", ["", None])
def test_empty_documents(docs_of, spark, source):
    docs = docs_of(("d0.tex", source))
    files = spark.createDataFrame([], "path string")
    for df in (checks.artifacts(docs), checks.figures(docs), checks.images(docs, files)):
        assert df.count() == 0
    assert parse.sections(docs).count() == 1


def test_paths_with_many_steps_up(spark):
    cases = {"a/b/c/d/e/f/../../../../../../x.png": "x.png", "./a/./b.png": "a/b.png", "../x.png": "../x.png", "a/../../x.png": "../x.png", "/../x.png": "/../x.png", "/a/b/../x.png": "/a/x.png"}
    got = spark.createDataFrame([(c,) for c in cases], "p string").select("p", checks._clean_path(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in got} == cases
