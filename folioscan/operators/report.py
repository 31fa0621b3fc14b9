"""Findings into reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.sources.tables import growing

#: Fixed value: the order in which checks report.
CHECKERS = ("artifacts", "figures", "images", "citations", "references", "grammar", "reviewer", "claims")


def numbered(findings: DataFrame) -> DataFrame:
    """Replaces ord by seq: the findings of a document in the order of the checks, counted from 1."""
    rank = F.array_position(F.array(*map(F.lit, CHECKERS)), F.col("checker"))
    seq = F.row_number().over(Window.partitionBy("doc_path").orderBy(rank, "ord"))
    return findings.select("doc_path", seq.cast("long").alias("seq"), "checker", "severity", "line", "message", "suggestion", "excerpt", "file")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_path", "severity").agg(F.count("*").alias("n"))


def exit_status(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_path, n_findings, has_error) for every document."""
    counts = findings.groupBy("doc_path").agg(F.count("*").alias("n"), F.bool_or(F.col("severity") == "error").alias("e"))
    return docs.select("doc_path").join(growing(counts), "doc_path", "left").select("doc_path", F.coalesce("n", F.lit(0)).alias("n_findings"), F.coalesce("e", F.lit(False)).alias("has_error"))


def ordered_report(findings: DataFrame) -> DataFrame:
    """Adds place: the order by file, line and check, findings of equal rank in the order they were made."""
    order = Window.partitionBy("doc_path").orderBy(F.coalesce("file", F.lit("")), "line", "checker", "seq")
    return findings.withColumn("place", F.row_number().over(order))


def report_lines(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_path, line_no, text): the report of each document as plain text."""
    where = F.concat(F.coalesce("file", "doc_path"), F.lit(":"), F.col("line").cast("string"))
    head = F.concat_ws(" ", "severity", where, "checker", "message")
    shown = F.array_compact(F.array(head, F.when(F.col("excerpt").isNotNull(), F.concat(F.lit("    > "), "excerpt")), F.when(F.col("suggestion").isNotNull(), F.concat(F.lit("    suggest: "), "suggestion"))))
    parts = ordered_report(findings).select("doc_path", F.struct("place", shown.alias("shown")).alias("part"))
    grouped = parts.groupBy("doc_path").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    rows = docs.select("doc_path").join(growing(grouped), "doc_path", "left")
    full = F.concat(F.flatten(F.transform("parts", lambda p: p["shown"])), F.array(F.lit(""), F.concat(F.size("parts").cast("string"), F.lit(" issue(s)"))))
    none = F.array(F.concat("doc_path", F.lit(": no issues found")))
    return rows.select("doc_path", F.posexplode(F.when(F.col("parts").isNotNull(), full).otherwise(none)).alias("line_no", "text"))


def report_json(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_path, json): file, total, by_severity and findings of every document; fields without a value are left out of a finding."""
    entry = F.struct("seq", F.struct("checker", "severity", "line", "message", "suggestion", "excerpt", "file").alias("f"))
    grouped = findings.groupBy("doc_path").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["f"]).alias("findings"))
    levels = F.array_distinct(F.transform("findings", lambda f: f["severity"]))
    by = F.map_from_entries(F.transform(levels, lambda s: F.struct(s, F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("long"))))
    rows = docs.select("doc_path").join(growing(grouped), "doc_path", "left")
    kind = "array<struct<checker:string,severity:string,line:int,message:string,suggestion:string,excerpt:string,file:string>>"
    rows = rows.withColumn("findings", F.coalesce("findings", F.array().cast(kind)))
    return rows.select("doc_path", F.to_json(F.struct(F.col("doc_path").alias("file"), F.size("findings").cast("long").alias("total"), by.alias("by_severity"), "findings")).alias("json"))


def run_stats(docs: DataFrame, paragraphs: DataFrame, entries: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(doc_path, n_paragraphs, n_entries, n_bib_files) for every document. members: see checks.for_members()."""
    p = paragraphs.groupBy("doc_path").agg(F.count("*").alias("np"))
    e = entries.groupBy("doc_path").agg(F.count("*").alias("ne"), F.countDistinct("file").alias("nf"))
    e = e if members is None else members.join(e.withColumnRenamed("doc_path", "collection"), "collection")
    rows = docs.select("doc_path").join(p, "doc_path", "left").join(e, "doc_path", "left")
    return rows.select("doc_path", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("np", "n_paragraphs"), ("ne", "n_entries"), ("nf", "n_bib_files"))])
