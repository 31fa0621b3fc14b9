"""The registered queries: their columns, and their rows against DuckDB."""

from pathlib import Path

import duckdb
import pytest

from folioscan.llm import queries as q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

# The columns that each query promises, with their types.
CONTRACTS = {
    "op1_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op3_lm_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op11_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op12_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op13_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_columns(spark, name):
    got = dict(q.queries()[name](spark, str(DATA)).dtypes)
    assert {c: got.get(c) for c in dict(x.split() for x in CONTRACTS[name].split(", "))} == dict(x.split() for x in CONTRACTS[name].split(", "))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    result = con.execute(q.oracle_sql()[name])
    df = q.queries()[name](spark, str(DATA))
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(result.fetchall(), key=repr)
