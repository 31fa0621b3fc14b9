"""Checks of one's own as table functions: from Python for `check(extra=...)`, and in SQL over any table of sources.

    @row_check("margins")
    def margins(doc_path, source):
        for n, line in enumerate(source.split("\\n"), 1):
            if len(line) > 120:
                yield "info", n, "A long line."

    check(corpus, extra=[as_checker(margins)])
    spark.udtf.register("margins", margins)
    spark.sql("SELECT * FROM margins(TABLE(docs) PARTITION BY doc_path)")

The function gets a document at a time and yields (severity, line, message) and, as far as there are any, suggestion, excerpt and file;
its findings keep their order. A null source is the empty text. Columns of the table beside doc_path and source are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

FINDINGS = "doc_path string, checker string, severity string, line int, message string, suggestion string, excerpt string, file string, ord array<bigint>"


def row_check(name: str) -> Callable[[Callable[[str, str], Iterable[tuple]]], Callable]:
    """Makes a table function, with a table argument, of a function of a document's path and source."""

    def decorate(find: Callable[[str, str], Iterable[tuple]]):
        class Check:
            def eval(self, row):
                for k, found in enumerate(find(row["doc_path"], row["source"] or "")):
                    severity, line, message, suggestion, excerpt, file = (*found, None, None, None)[:6]
                    yield row["doc_path"], name, severity, line, message, suggestion, excerpt, file, [k]

        return udtf(Check, returnType=FINDINGS)

    return decorate


def as_checker(function: Callable) -> Callable[..., DataFrame]:
    """A table function as a check of a corpus."""
    return lambda corpus: function(corpus.docs.select("doc_path", "source").asTable().partitionBy("doc_path"))
