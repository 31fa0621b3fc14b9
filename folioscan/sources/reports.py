"""JSON reports as a data source that is written to: one line per document, its findings streamed in order.

Spark joins the findings of a document to blocks of BLOCK, and rows come sorted by document and block, so a task holds one block at
a time, however many a document has, and Python sees few rows. Every task writes a file of its own; the files of the tasks that
Spark has committed are named in a list that the driver writes last. What other attempts leave is not on it and is removed where
possible. read_reports() reads what is on the list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from folioscan.sources.tables import growing, written

LIST = "_committed.json"
#: Findings of a document that reach a writer as one row.
BLOCK = 100
REPORT = "file string, total long, by_severity map<string,long>, findings array<struct<checker:string,severity:string,line:int,message:string,suggestion:string,excerpt:string,file:string>>"


@dataclass
class Written(WriterCommitMessage):
    name: str
    documents: int


class Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        """Rows (doc_path, at, text): at 0 the head of a document's report, a JSON object, and after it its findings, one or more to a row."""
        files, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        files.create_dir(path, recursive=True)
        name, documents, first = f"reports-{uuid.uuid4().hex}.jsonl", 0, True
        with files.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20) as out:
            for row in iterator:
                if row.at == 0:
                    out.write((("]}\n" if documents else "") + row.text[:-1] + ',"findings":[').encode())
                    documents, first = documents + 1, True
                else:
                    out.write((("" if first else ",") + row.text).encode())
                    first = False
            if documents:
                out.write(b"]}\n")
        return Written(name, documents)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        names = [m.name for m in messages if m and m.documents]
        with files.open_output_stream(f"{path}/{LIST}.part") as out:
            out.write(json.dumps(names).encode())
        files.move(f"{path}/{LIST}.part", f"{path}/{LIST}")
        self._remove([m.name for m in messages if m and not m.documents])

    def abort(self, messages: list[Written | None]) -> None:
        self._remove([m.name for m in messages if m])

    def _remove(self, names: list[str]) -> None:
        files, path = pyarrow.fs.FileSystem.from_uri(self.folder)
        for name in names:
            files.delete_file(f"{path}/{name}")


class Reports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folioscan_reports"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_reports(docs: DataFrame, findings: DataFrame, folder: str) -> None:
    """Writes the reports of all documents below a new folder, given by its URI; fields without a value are left out of a finding."""
    text = F.to_json(F.struct("checker", "severity", "line", "message", "suggestion", "excerpt", "file"))
    rows = findings.select("doc_path", (F.floor((F.col("seq") - 1) / BLOCK) + 1).cast("long").alias("at"), "severity", F.struct("seq", text.alias("text")).alias("f"))
    rows = rows.groupBy("doc_path", "at").agg(F.collect_list("severity").alias("severities"), F.array_sort(F.collect_list("f")).alias("fs"))
    blocks = written(rows.select("doc_path", "at", "severities", F.array_join(F.col("fs.text"), ",").alias("text")))  # counted first, then written out
    counts = blocks.select("doc_path", F.explode("severities").alias("severity")).groupBy("doc_path", "severity").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("doc_path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("by_severity"), F.sum("n").alias("total"))
    heads = docs.select("doc_path").distinct().join(growing(counts), "doc_path", "left")
    head = F.struct(F.col("doc_path").alias("file"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("by_severity", F.create_map().cast("map<string,long>")).alias("by_severity"))
    rows = heads.select("doc_path", F.lit(0).cast("long").alias("at"), F.to_json(head).alias("text")).unionByName(blocks.select("doc_path", "at", "text"))
    docs.sparkSession.dataSource.register(Reports)
    rows.repartition("doc_path").sortWithinPartitions("doc_path", "at").write.format("folioscan_reports").mode("append").option("path", folder).save()


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The reports below a folder, one row per document."""
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{path}/{LIST}") as f:
        names = json.loads(f.read())
    return spark.read.schema(REPORT).json([f"{folder}/{n}" for n in names]) if names else spark.createDataFrame([], REPORT)
