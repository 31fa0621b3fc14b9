"""The deterministic checks over source files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators import checks, parse, report


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the findings of each new .tex file to a Parquet table; a file's own bibliography blocks are its bibliography.

    A batch that is repeated after a failure overwrites its own folder, so no finding is written twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        docs = rows.select(F.regexp_replace("path", "^file:/+", "/").alias("doc_path"), F.col("content").cast("string").alias("source"))
        parts = checks.artifacts(docs).unionByName(checks.figures(docs)).unionByName(checks.citations(docs, parse.inline_bibitems(docs)))
        report.numbered(parts).write.mode("overwrite").parquet(f"{out}/batch={number}")

    schema = "path string, modificationTime timestamp, length long, content binary"
    writer = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.tex").load(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
