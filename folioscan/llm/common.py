"""Helpers that the training-data operators share.

Every operator reads only the columns it names, under internal names, so extra columns (also ones that
clash with internal names) never reach it. A null text counts as empty; a null id stays null.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside an operator.
NO_ID = -(2**63)
#: A-Z to a-z, and every ASCII byte that is neither a letter nor a digit to a space.
WORDS_TABLE = bytes((b | 32) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of text that an operator holds in one go within a task.
CHUNK_BYTES = 1 << 20
#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES = 8 << 20
_ARROW_DEFAULT = "67108864b"


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared folder (spark.checkpoint.dir), which is set here only where it is unset, and only if all of Spark runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="folioscan-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folioscan-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary); text is never null.

    Rows go to Python in batches of a few MB, whatever the length of a text, unless the session sets a size itself.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, _ARROW_DEFAULT) == _ARROW_DEFAULT:
        conf.set(key, f"{BATCH_BYTES}b")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about limit bytes of text, or a single row."""
    sizes = np.cumsum(np.diff(offsets(batch.column(column))))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def total(df: DataFrame, column: Column) -> int:
    """A sum over all rows, as one number on the driver."""
    return int(df.agg(F.coalesce(F.sum(column), F.lit(0)).cast("long")).first()[0])


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
