"""The core queries against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from folioscan.plans import queries as q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def ordered(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_same_rows(spark, con, name):
    df = q.QUERIES[name](spark, str(DATA))
    result = con.execute(q.ORACLE[name])
    names = [c[0] for c in result.description]
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(result.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
