import json

from folioscan.operators import report

SCHEMA = "doc_path string, seq bigint, checker string, severity string, line int, message string, suggestion string, excerpt string, file string"


def table(spark):
    rows = [("a", 1, "figures", "warning", 9, "w", None, "ex", None), ("a", 2, "citations", "error", 3, "e", "fix", None, None), ("a", 3, "citations", "info", 1, "i", None, None, "z.bib")]
    return spark.createDataFrame([("a",), ("b",)], "doc_path string"), spark.createDataFrame(rows, SCHEMA)


def test_counts_and_status(spark):
    docs, findings = table(spark)
    assert {(r.severity, r.n) for r in report.severity_counts(findings).collect()} == {("warning", 1), ("error", 1), ("info", 1)}
    assert sorted(map(tuple, report.exit_status(docs, findings).collect())) == [("a", 3, True), ("b", 0, False)]


def test_text(spark):
    docs, findings = table(spark)
    lines = [(r.doc_path, r.text) for r in report.report_lines(docs, findings).orderBy("doc_path", "line_no").collect()]
    assert [x for d, x in lines if d == "a"] == ["error a:3 citations e", "    suggest: fix", "warning a:9 figures w", "    > ex", "info z.bib:1 citations i", "", "3 issue(s)"]
    assert [x for d, x in lines if d == "b"] == ["b: no issues found"]


def test_json(spark):
    docs, findings = table(spark)
    got = {r.doc_path: json.loads(r.json) for r in report.report_json(docs, findings).collect()}
    assert got["a"]["total"] == 3 and got["a"]["by_severity"] == {"warning": 1, "error": 1, "info": 1}
    assert got["a"]["findings"][0] == {"checker": "figures", "severity": "warning", "line": 9, "message": "w", "excerpt": "ex"}
    assert got["b"] == {"file": "b", "total": 0, "by_severity": {}, "findings": []}
