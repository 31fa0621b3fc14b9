"""Stages of the pipeline on documents whose columns are called what the stages and operators use themselves, and on none."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
CLASHING = ("key", "sha", "shard", "copy", "place", "pipeline_row", "pipeline_all", "mark", "order", "none", "component_id", "first", "a.dot", "n_hit", "predicted", "start", "bucket")


@pytest.mark.parametrize("name", [n for n, _ in c.STAGES])
def test_clashing_columns_and_empty_tables(spark, tmp_path, name):
    stage = dict(c.STAGES)[name]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).cache()
    more = docs.select("*", *[F.concat(F.lit(f"{x} of "), "doc_id").alias(x) for x in CLASHING])
    plain, out = stage(spark, docs, str(DATA)), stage(spark, more, str(DATA))
    out.write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in plain.collect())
    own = [x for x in CLASHING if name != "mixing" or x not in ("shard", "copy", "place")]
    assert all(r[x] == f"{x} of {r.doc_id}" for r in out.collect() for x in own)
    assert set(out.columns) == {*more.columns, *(("shard", "place", "copy") if name == "mixing" else ())}
    none = stage(spark, more.where("doc_id < 0"), str(DATA))
    assert none.count() == 0 and set(none.columns) == set(out.columns)


def test_all_stages_on_no_documents(spark, tmp_path):
    for p in DATA.glob("*.parquet"):
        shutil.copy(p, tmp_path / p.name)
    (tmp_path / "documents.parquet").unlink()
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0
