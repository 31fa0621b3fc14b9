from pathlib import Path

import pytest

import corpus_pipeline as c
from folioscan.llm import queries as q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_stages_keep_the_columns_and_do_their_work(spark):
    sf = str(DATA)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in c.STAGES:
        docs = c.written(stage(spark, docs, sf))
        assert docs.columns[: len(columns)] == columns
        if name != "mixing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    rows = docs.collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and max(r.copy for r in rows) <= 2


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "a", "en", "s", 1), (None, "b", None, None, None), (None, "b", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "c", "en", "s", 1), (5, "c", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in c.exact(spark, docs, "").collect())
    assert got == [(False, 2, "a"), (False, 4, ""), (False, 5, "c"), (True, 0, "b")]


def test_every_operator_has_its_query():
    names = list(q.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(q.oracle_sql()) <= set(names)
