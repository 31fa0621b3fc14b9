"""Missing, unused and duplicate bibliography keys over sources and bibliographies that arrive in any order.

The stateful steps are native. Each distinct list of bibliographies that documents name is kept once, and a stream-stream
join by file meets it with the entries of its files, whichever comes first. A document passes through with its cited keys and
its list. Batches append what they bring to a table; findings_now() takes the last of each document and of each place in a
list from it and gives them to the checks of the batch engine, with lists as the collections that documents share. What is
known after the last of the files is what a batch over all files finds.

Scale. State holds the distinct lists and the entries of each file, and no document; the table holds what was sent. A file that
very many lists name is joined in MEMBER_PARTS parts, to which its lists are dealt, so its key meets in no single task. For
large state set the session's state store provider to the one backed by RocksDB.

Cases. A document whose files never come, or have no entries, is checked against the entries inside it. A file that nobody
names has no findings. Null or empty sources have no keys. A document that is sent again is checked as sent last, also where a file it no longer names
was known; a file that is sent again stands beside its former version in the join, and lists follow the one that was sent last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.functions import text as t
from folioscan.operators import bib, checks, parse, report
from folioscan.sources import files as f
from folioscan.sources.tables import written

ENTRIES = "array<struct<bib_idx:bigint,key:string,file:string,line:int>>"
CITES = "array<struct<key:string,line:int>>"


def known(sources: DataFrame, bibs: DataFrame) -> DataFrame:
    """(doc_path, collection, place, sent, parsed_citations, entries) from streams of (path, source).

    A row for each document that is sent, with the list of files that it names as its collection and the entries inside it;
    and a row without a document for each place in a list for which entries are known.
    """
    docs = parse.parsed(sources.withColumnRenamed("path", "doc_path"), "citations", "resources", "bibitems")
    docs = docs.withColumn("paths", F.transform("parsed_resources", lambda name: checks.bib_path(name))).withColumn("collection", F.to_json("paths"))
    inside = F.transform(F.filter("parsed_bibitems", lambda e: e["key"] != ""), lambda e: F.struct(e["bib_idx"], e["key"], F.col("doc_path").alias("file"), e["line"]))
    own = docs.select("doc_path", "collection", F.lit(None).cast("int").alias("place"), F.current_timestamp().alias("sent"), F.col("parsed_citations").cast(CITES).alias("parsed_citations"), inside.cast(ENTRIES).alias("entries"))
    lists = docs.where(F.size("paths") > 0).select("collection", "paths").dropDuplicates(["collection"])
    named = lists.select("collection", F.pmod(F.xxhash64("collection"), F.lit(checks.MEMBER_PARTS)).cast("int").alias("part"), F.posexplode("paths").alias("place", "path"))
    rows = F.transform(bib.headers(F.col("source")), lambda m, i: F.struct(i.cast("bigint").alias("bib_idx"), t.strip(m["g2"]).alias("key"), F.col("path").alias("file"), m["line"].alias("line"), F.lower(m["g1"]).alias("kind")))
    entries = F.transform(F.filter(rows, lambda e: ~e["kind"].isin(*bib.NO_ENTRIES)), lambda e: F.struct(*[e[c].alias(c) for c in ("bib_idx", "key", "file", "line")])).cast(ENTRIES)
    dealt = bibs.select("path", F.current_timestamp().alias("sent"), entries.alias("entries")).select("*", F.explode(F.sequence(F.lit(0), F.lit(checks.MEMBER_PARTS - 1))).alias("part"))
    met = named.join(dealt, ["path", "part"]).select(F.lit(None).cast("string").alias("doc_path"), "collection", "place", "sent", F.lit(None).cast(CITES).alias("parsed_citations"), "entries")
    return own.unionByName(met)


def watch_citations(sources: DataFrame, bibs: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps what the check of citations needs to know below out, from streams of (path, source); findings_now() checks it.

    A batch writes a folder of its own, and overwrites it if it is repeated after a failure.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/known/batch={number}")

    writer = known(sources, bibs).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def findings_now(spark: SparkSession, out: str) -> DataFrame:
    """The findings of each document by what is known by now."""
    rows = spark.read.parquet(f"{out}/known")
    docs = rows.where("doc_path is not null").groupBy("doc_path").agg(F.max(F.struct("sent", "collection", "parsed_citations", "entries")).alias("x"))
    found = rows.where("doc_path is null").groupBy("collection", "place").agg(F.max(F.struct("sent", "entries")).alias("x"))
    found = written(found.select("collection", "place", F.inline("x.entries")).select(F.col("collection").alias("doc_path"), (F.col("place") * F.lit(10**12) + F.col("bib_idx")).alias("bib_idx"), "key", "file", "line"))
    # A document whose list has no entries is a collection by itself.
    there = found.select(F.col("doc_path").alias("collection"), F.lit(True).alias("there")).distinct()
    own = F.col("there").isNull()
    docs = docs.select("doc_path", "x.*").join(there, "collection", "left").withColumn("collection", F.when(own, F.concat(F.lit("own|"), "doc_path")).otherwise(F.col("collection")))
    docs = written(docs.select("doc_path", "collection", "parsed_citations", F.when(own, F.col("entries")).alias("entries")))
    inside = docs.select(F.col("collection").alias("doc_path"), F.inline("entries"))
    return report.numbered(checks.shared_citations(docs, found.unionByName(inside), docs.select("doc_path", "collection")))


def arriving(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, source) of files with the suffix as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return f.decoded(spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*{suffix}").load(folder))
