"""What the checks send through the driver does not grow with the documents."""

from pathlib import Path

import pytest

from folioscan.operators import checks
from folioscan.plans import queries as q

DATA = Path("/root/testdata/sf0.001")


def broadcast_rows(spark, run):
    """The rows of every table that is broadcast while run() works."""
    sc, store = spark.sparkContext, spark._jsparkSession.sharedState().statusStore()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found, executions = [], store.executionsList(before, 10_000)
    for i in range(executions.size()):
        number = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() == "BroadcastExchange":
                metrics = [node.metrics().apply(m) for m in range(node.metrics().size())]
                shown = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                found += [int(v.get().replace(",", "")) for v in shown if v.isDefined()]
    return found


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["whole_check", "whole_report", "report_files"])
def test_broadcasts_do_not_grow(spark, tmp_path, name):
    """Four times the documents, and no larger broadcast."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    n, most = docs.count(), {}
    for times in (1, 4):
        folder = tmp_path / str(times)
        folder.mkdir()
        for table in ("benchmark", "part", "pages"):
            (folder / f"{table}.parquet").symlink_to(DATA / f"{table}.parquet")
        docs.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).selectExpr(f"doc_id + copy * {n * 1000} AS doc_id", "substring(text, 1, 200) AS text").write.parquet(str(folder / "documents.parquet"))
        most[times] = max(broadcast_rows(spark, lambda f=folder: q.QUERIES[name](spark, str(f)).write.format("noop").mode("overwrite").save()))
    assert most[4] == most[1]


def test_rows_go_to_parts_with_members(spark):
    """A collection of one document costs one row for each of its entries, not one for each part."""
    entries = spark.createDataFrame([(f"own|d{i}", i) for i in range(50)], "doc_path string, line int")
    members = spark.createDataFrame([(f"d{i}", f"own|d{i}") for i in range(50)] + [(f"e{i}", "own|d0") for i in range(20)], "doc_path string, collection string")
    rows = checks.for_members(entries, members)
    assert sorted(tuple(r) for r in rows.collect()) == sorted([(f"d{i}", i) for i in range(50)] + [(f"e{i}", 0) for i in range(20)])
    assert "explode" not in rows._jdf.queryExecution().optimizedPlan().toString()
