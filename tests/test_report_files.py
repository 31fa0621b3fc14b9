"""Reports as files: every field comes back, findings in order, and only committed files count."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from folioscan.sources import reports

FINDINGS = "doc_path string, seq long, checker string, severity string, line int, message string, suggestion string, excerpt string, file string"


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    docs = spark.createDataFrame([("a.tex",), ("b.tex",), ("é \"x\".tex",), ("a.tex",)], "doc_path string")
    rows = [("a.tex", 2, "c", "info", 3, "m\n\"q\"", None, "e", None), ("a.tex", 1, "c", "error", 1, "first", "s", None, "f.tex"), ("é \"x\".tex", 1, "d", "error", None, "ünï", None, None, None)]
    reports.write_reports(docs, spark.createDataFrame(rows, FINDINGS).repartition(3), folder)
    got = {r.file: r for r in reports.read_reports(spark, folder).collect()}
    assert sorted(got) == ["a.tex", "b.tex", "é \"x\".tex"]
    assert (got["a.tex"].total, got["a.tex"].by_severity, [tuple(f) for f in got["a.tex"].findings]) == (2, {"error": 1, "info": 1}, [tuple(r[2:]) for r in sorted(rows[:2], key=lambda r: r[1])])
    assert (got["b.tex"].total, got["b.tex"].by_severity, got["b.tex"].findings) == (0, {}, [])
    assert got["é \"x\".tex"].findings[0].message == "ünï"
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.jsonl") for x in p.read_text().splitlines()]
    assert sorted(x["file"] for x in lines) == sorted(got) and all("suggestion" not in f for x in lines for f in x["findings"] if x["file"] != "a.tex")
    (tmp_path / "out" / "reports-lost.jsonl").write_text('{"file": "lost"}\n')  # what an attempt leaves that was not committed
    assert reports.read_reports(spark, folder).count() == 3


def test_many_findings_of_one_document(spark, tmp_path):
    n, folder = 300_000, f"file://{tmp_path}/many"
    rows = spark.range(n).select(F.lit("d").alias("doc_path"), (F.col("id") + 1).alias("seq"), F.lit("c").alias("checker"), F.lit("info").alias("severity"), F.col("id").cast("int").alias("line"), F.lit("m").alias("message"), *[F.lit(None).cast("string").alias(c) for c in ("suggestion", "excerpt", "file")])
    reports.write_reports(spark.createDataFrame([("d",)], "doc_path string"), rows, folder)
    total, in_order = reports.read_reports(spark, folder).select("total", F.transform("findings", lambda f: f["line"]) == F.sequence(F.lit(0), F.lit(n - 1))).first()
    assert total == n and in_order


def test_python_sees_blocks(spark, tmp_path, monkeypatch):
    """Rows that reach Python are blocks of findings, so their number does not follow that of the findings."""

    class Counting(reports.Reports):
        def writer(self, schema, overwrite):
            class Counted(reports.Writer):
                def write(self, iterator):
                    rows = list(iterator)
                    (tmp_path / f"{uuid.uuid4().hex}.count").write_text(str(len(rows)))
                    return super().write(iter(rows))

            return Counted(self.options["path"])

    monkeypatch.setattr(reports, "Reports", Counting)
    none = [F.lit(None).cast("string").alias(c) for c in ("suggestion", "excerpt", "file")]
    rows = spark.range(20_000).select(F.concat(F.lit("d"), F.col("id") % 10).alias("doc_path"), (F.floor(F.col("id") / 10) + 1).alias("seq"), F.lit("c").alias("checker"), F.lit("info").alias("severity"), F.col("id").cast("int").alias("line"), F.lit("m").alias("message"), *none)
    folder = f"file://{tmp_path}/blocks"
    reports.write_reports(rows.select("doc_path").distinct(), rows, folder)
    assert sum(int(p.read_text()) for p in tmp_path.glob("*.count")) == 10 * (1 + 2_000 // 100)
    got = reports.read_reports(spark, folder).select("file", "total", F.transform("findings", lambda f: f["line"]).alias("lines")).collect()
    assert all(r.total == 2_000 and r.lines == list(range(int(r.file[1:]), 20_000, 10)) for r in got) and len(got) == 10


def test_writer_holds_one_row(tmp_path):
    """The writer takes from a stream and never looks back."""
    from pyspark.sql import Row

    taken = []

    def stream():
        for k in range(1000):
            taken.append(k)
            yield Row(doc_path="d", at=k, text='{"file":"d"}' if k == 0 else '{"line":1}')

    writer = reports.Writer(f"file://{tmp_path}/w")
    message = writer.write(stream())
    assert message.documents == 1 and len(taken) == 1000
    writer.abort([message, None])
    assert not list((tmp_path / "w").glob("*.jsonl"))
    empty = writer.write(iter(()))
    writer.commit([empty, None])
    assert json.loads((tmp_path / "w" / reports.LIST).read_text()) == []


def test_no_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    reports.write_reports(spark.createDataFrame([], "doc_path string"), spark.createDataFrame([], FINDINGS), folder)
    assert reports.read_reports(spark, folder).count() == 0
    with pytest.raises(FileNotFoundError):
        reports.read_reports(spark, f"file://{tmp_path}/nowhere")
