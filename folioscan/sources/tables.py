"""Tables in the cluster's shared folder, for what is read more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, and only if all of Spark runs on this machine, in one of this process's own. The session's settings stay as they are."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="folioscan-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    return f"{base.rstrip('/')}/folioscan-{uuid.uuid4().hex}"


def growing(df: DataFrame) -> DataFrame:
    """The side of a join whose rows grow with the documents: both sides are shuffled, so it never goes through the driver.

    Spark takes the size of a written table from its files, and that of an exploded one from what is exploded; the rows can be a hundred times as large, and would be broadcast.
    """
    return df.hint("merge")


def written(df: DataFrame, *by: str) -> DataFrame:
    """The rows of df from a table in the shared folder: its plan ends there, later reads are of single columns, and a lost executor costs no recomputation."""
    path = folder(df.sparkSession)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
