"""Questions as a data source: pace, commits, and what is asked again after a failure."""

import time

import pytest

from folioscan.sources.asking import Part, Reader, Service, asked


def log_of(path):
    return sorted(path.read_text().split()) if path.exists() else []


def asking(path, fail=()):
    def ask(key):
        with open(path, "a") as f:
            f.write(f"{key}\n")
        if key in fail:
            raise ValueError(f"no {key}")
        return {"said": key.upper()}

    return ask


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "service string, key string")


def test_distinct_questions_are_asked_once_and_kept(spark, tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "answers")
    services = {"one": Service(asking(log, fail=("c",))), "two": Service(asking(log))}
    q = frame(spark, ("one", "a"), ("one", "a"), ("one", "b"), ("two", "a"), ("one", "c"), ("one", None), ("other", "a"))
    rows = sorted(tuple(r) for r in asked(q, services, folder).collect())
    assert [r[:2] for r in rows] == [("one", "a"), ("one", "b"), ("one", "c"), ("two", "a")]
    assert rows[0][2:] == ('{"said": "A"}', None) and rows[2][2:] == (None, "no c")
    assert log_of(log) == ["a", "a", "b", "c"]
    again = asked(frame(spark, ("one", "a"), ("one", "c"), ("one", "d"), ("two", "a")), services, folder)
    assert sorted((r.service, r.key) for r in again.collect()) == [("one", "a"), ("one", "c"), ("one", "d"), ("two", "a")]
    assert log_of(log) == ["a", "a", "b", "c", "c", "d"]
    assert asked(q.limit(0), services).collect() == []


def test_a_lost_task_asks_only_what_it_had_not_committed(spark, tmp_path):
    log, questions, answers = tmp_path / "log", str(tmp_path / "q"), str(tmp_path / "a")
    frame(spark, *[("s", f"k{i}") for i in range(10)]).selectExpr("*", "0 AS range").write.partitionBy("service", "range").parquet(questions)
    real = asking(log)

    def dies(key):
        if key == "k7":
            raise KeyboardInterrupt  # as if the worker were killed
        return real(key)

    with pytest.raises(KeyboardInterrupt):
        list(Reader({"s": Service(dies)}, questions, answers, 3).read(Part("s", "0", 0.0)))
    assert log_of(log) == [f"k{i}" for i in range(7)]
    rows = list(Reader({"s": Service(real)}, questions, answers, 3).read(Part("s", "0", 0.0)))
    assert sorted(r[1] for r in rows) == [f"k{i}" for i in range(10)] and all(r[3] is None for r in rows)
    assert log_of(log) == sorted([f"k{i}" for i in range(10)] + ["k6"])  # k6 was asked, but its file was not written yet


def test_partitions_share_the_pace(spark, tmp_path):
    questions = str(tmp_path / "q")
    frame(spark, *[("s", f"k{i}") for i in range(4)]).selectExpr("*", "CAST(substr(key, 2) AS int) % 2 AS range").write.partitionBy("service", "range").parquet(questions)
    reader = Reader({"s": Service(lambda k: k, 0.1), "t": Service(lambda k: k)}, questions, str(tmp_path / "a"))
    parts = reader.partitions()
    assert [(p.service, p.number, p.pause) for p in parts] == [("s", "0", 0.2), ("s", "1", 0.2)]
    began = time.time()
    assert len(list(reader.read(parts[0]))) == 2 and time.time() - began >= 0.2
