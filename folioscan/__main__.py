"""Command line: check sources, look a paper up, or show the version."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from folioscan import __version__
from folioscan.operators import checks, parse, replies, report
from folioscan.plans.check import check, load
from folioscan.sources import files, lookups
from folioscan.sources.tables import written


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioscan")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    paper = commands.add_parser("scholar", help="the first paper found for a title")
    paper.add_argument("title", nargs="+")
    paper.add_argument("--retrieval", default="semantic-scholar", choices=sorted(lookups.BACKENDS))
    c = commands.add_parser("check", help="check LaTeX files, patterns or folders")
    c.add_argument("files", nargs="+")
    c.add_argument("--bib", action="append", default=[])
    c.add_argument("--skip-grammar", action="store_true")
    c.add_argument("--skip-reviewer", action="store_true")
    c.add_argument("--enable-claims", action="store_true")
    c.add_argument("--retrieval", default="semantic-scholar", choices=sorted(lookups.BACKENDS))
    c.add_argument("-j", "--concurrency", type=int, default=1)
    c.add_argument("--base-url")
    c.add_argument("--model")
    c.add_argument("--json", action="store_true")
    return top


def _check(spark: SparkSession, a: argparse.Namespace) -> int:
    roots = files.read_texts(spark, [os.path.abspath(f) for f in a.files]).selectExpr("path AS doc_path").distinct()
    folder = os.path.commonpath([os.path.dirname(os.path.abspath(f.split("*")[0])) for f in a.files])
    corpus = load(spark, folder, roots, a.bib or None)
    if corpus.docs.isEmpty():
        print("no .tex files found", file=sys.stderr)
        return 1
    model = None if a.skip_grammar and a.skip_reviewer and not a.enable_claims else replies.server_model(a.base_url, a.model, max(1, a.concurrency))
    found = written(check(corpus, model, lookups.verify, a.retrieval, a.skip_grammar, a.skip_reviewer, a.enable_claims))  # so that nothing is asked twice
    if not a.bib:
        for r in checks.missing_bib_files(corpus.docs, corpus.files).where("not found").orderBy("doc_path", "res_idx").toLocalIterator():
            print(f"warning: {r.doc_path} names a bibliography file that is not there: {r.path}", file=sys.stderr)
    for r in corpus.docs.join(corpus.members, "doc_path", "left_anti").orderBy("doc_path").toLocalIterator():
        print(f"warning: {r.doc_path} has no bibliography entries, so its citations cannot be checked in full", file=sys.stderr)
    if not a.json:
        for r in report.run_stats(corpus.docs, parse.paragraphs(corpus.docs), corpus.entries, corpus.members).orderBy("doc_path").toLocalIterator():
            print(f"{r.doc_path}: {r.n_paragraphs} paragraph(s), {r.n_entries} bibliography entries from {r.n_bib_files} file(s)")
    shown = report.report_json(corpus.docs, found).orderBy("doc_path").select("json") if a.json else report.report_lines(corpus.docs, found).orderBy("doc_path", "line_no").select("text")
    for r in shown.toLocalIterator():
        print(json.dumps(json.loads(r[0]), indent=2) if a.json else r[0])
    return int(bool(report.exit_status(corpus.docs, found).where("has_error").count()))


def main(arguments: list[str] | None = None) -> int:
    a = _arguments().parse_args(arguments)
    if a.command == "version":
        print(__version__)
        return 0
    spark = SparkSession.builder.appName("folioscan").getOrCreate()
    if a.command == "check":
        return _check(spark, a)
    title = spark.createDataFrame([(" ".join(a.title),)], "query string")
    lines = lookups.paper_card(lookups.papers(title, a.retrieval)).orderBy("line_no").collect()
    print("\n".join(r.text for r in lines) or f"no match for: {' '.join(a.title)}")
    return 0 if lines else 1


if __name__ == "__main__":
    sys.exit(main())
