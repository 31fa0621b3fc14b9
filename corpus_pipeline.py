"""A training corpus from documents, stage by stage.

Each stage works on all that the stage before kept; its rows are written to the shared folder and read again. Within a
stage every row has a number of its own, by which the operators name it: whether a row stays depends on its own text,
also where its doc_id is null or stands on several rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import NO_ID, written
from folioscan.llm.decontaminate import decontaminate
from folioscan.llm.exact_dedup import exact_dedup
from folioscan.llm.mixing import mix
from folioscan.llm.simhash import simhash_dedup
from folioscan.llm.toxicity import fit_on, score_toxicity


#: Columns within a stage: a row's number, and the row itself. Whatever a column of documents is called, it only stands inside the latter.
ROW, ALL = "pipeline_row", "pipeline_all"
ID, TEXT, SOURCE = f"{ALL}.doc_id", f"{ALL}.text", f"{ALL}.source"


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ALL))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs, packed, with a different number on every row, written, so that every later read finds the same numbers."""
    return written(_packed(docs).withColumn(ROW, F.monotonically_increasing_id()))


def _without(rows: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows whose number is not in drop, where operators return it as doc_id."""
    return rows.join(drop.select(F.col("doc_id").alias(ROW)), ROW, "left_anti").select(f"{ALL}.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labels of all documents."""
    field = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = _numbered(docs)
    return _without(rows, score_toxicity(rows, field, id_col=ROW, text_col=TEXT).where("predicted = 1"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts stays: the one with the largest doc_id; of rows equal in id and text, one."""
    kept = exact_dedup(docs).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.col("text_sha256").alias("sha"))
    rows = _packed(docs).select(ALL, F.coalesce(ID, F.lit(NO_ID)).alias("key"), F.sha2(F.coalesce(TEXT, F.lit("")), 256).alias("sha"))
    return rows.join(kept, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"]).select(f"{ALL}.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked SimHash fingerprints stays: the one with the smallest doc_id, null after all others; of equal ids one."""
    rows = _numbered(docs)
    order = F.struct(F.col(ID).isNull().alias("none"), F.col(ID).alias("id"), F.xxhash64(ALL).alias("hash"), ROW)
    groups = simhash_dedup(rows, id_col=ROW, text_col=TEXT).select(F.col("doc_id").alias(ROW), "component_id")
    first = rows.select(ROW, order.alias("order")).join(groups, ROW).groupBy("component_id").agg(F.min("order").alias("first"))
    return rows.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").select(f"{ALL}.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim match of a benchmark window go."""
    rows = _numbered(docs)
    found = decontaminate(rows.select(ROW, F.col(TEXT).alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW)
    return _without(rows, found.where("contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the rows of documents, as often as the mix takes them, with shard, place (their order within the shard) and copy, which take the place of columns of these names."""
    rows = _numbered(docs)
    # The random order is by a hash of id and text, so it does not depend on the rows' numbers.
    marked = rows.withColumn("mark", F.xxhash64(ID, TEXT))
    drawn = mix(marked, id_col="mark", text_col=TEXT, source_col=SOURCE, carry=(ROW,)).select(ROW, "shard", "place", "copy")
    own = [F.col(f"{ALL}.`{c}`") for c in docs.columns if c not in ("shard", "place", "copy")]
    return rows.join(drawn, ROW).select(*own, "shard", "place", "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: Fingerprints, models and random draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
