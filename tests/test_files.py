import json
import time

from folioscan.plans import check as plan
from folioscan.sources import files
from folioscan.streaming.watch import watch


def expand(spark, sources, *roots):
    table = spark.createDataFrame(list(sources.items()), "path string, source string")
    rows = files.expand_includes(table, spark.createDataFrame([(r,) for r in roots], "doc_path string"))
    return [(r.text, r.origin_file, r.origin_line) for r in rows.orderBy("doc_path", "combined_line").collect()]


def test_includes(spark):
    got = expand(spark, {"m/main.tex": "a\nx \\input{sections/intro} y\nb", "m/sections/intro.tex": "i1\ni2\n"}, "m/main.tex")
    assert got == [("a", "m/main.tex", 1), ("i1", "m/sections/intro.tex", 1), ("i2", "m/sections/intro.tex", 2), ("b", "m/main.tex", 3)]


def test_include_twice_missing_commented(spark):
    got = expand(spark, {"m.tex": "\\input{c}\n% \\input{c}\n\\include{gone}\n\\input{c.tex}", "c.tex": "c"}, "m.tex")
    assert [g[0] for g in got[:2]] == ["c", "% \\input{c}"] and got[2][1:] == ("gone", 1) and got[2][0].startswith("%") and got[3] == ("c", "c.tex", 1)


def test_cycle_ends(spark):
    got = expand(spark, {"a.tex": "a\n\\input{b}", "b.tex": "b\n\\input{a}"}, "a.tex")
    assert [g[0] for g in got[:2]] == ["a", "b"] and "cycle" in got[2][0] and len(got) == 3


def test_chain_of_thousands(spark):
    n = 5000
    got = expand(spark, {f"c{i}.tex": f"head {i}\n\\input{{c{(i + 1) % n}}}\ntail {i}" for i in range(n)}, "c0.tex")
    assert [g[0] for g in got] == [f"head {i}" for i in range(n)] + ["% folioscan: cycle, not expanded: c0.tex"] + [f"tail {i}" for i in reversed(range(n))]


def test_joined_sources_keep_runs(spark):
    sources = {"a.tex": "1\n\\input{b}\n3\n\\input{b}\\input{c}\n\\input{gone}\n6", "b.tex": "b1\n\nb3", "none.tex": ""}
    table = spark.createDataFrame(list(sources.items()), "path string, source string")
    roots = spark.createDataFrame([("a.tex",), ("none.tex",), ("a.tex",)], "doc_path string")
    docs = {r.doc_path: r for r in files.joined_sources(files.expand_includes(table, roots.distinct()), roots).collect()}
    assert docs["a.tex"].source.split("\n")[:4] == ["1", "b1", "", "b3"] and docs["none.tex"].source == "" and docs["none.tex"].line_runs == []
    assert [tuple(r) for r in docs["a.tex"].line_runs] == [(1, 1, "a.tex", 1), (2, 3, "b.tex", 1), (5, 1, "a.tex", 3), (6, 3, "b.tex", 1), (9, 1, "gone", 1), (10, 1, "a.tex", 6)]


def test_end_to_end(spark, tmp_path):
    (tmp_path / "paper.tex").write_text("\\documentclass{a}\n\\begin{document}\nWe cite \\cite{known} and\n\\cite{ghost}.\n\\bibliography{refs,absent}\n\\end{document}\n")
    (tmp_path / "refs.bib").write_text("@article{known, title = {T}}\n@book{spare, title = {S}}\n@book{spare, title = {S2}}\n")
    (tmp_path / "odd.tex").write_bytes(b"\xff\xfe")
    corpus = plan.load(spark, str(tmp_path))
    rows = plan.check(corpus).orderBy("seq").collect()
    assert [(r.seq, r.checker, r.severity, r.line) for r in rows] == [(1, "citations", "error", 4), (2, "citations", "info", 2), (3, "citations", "warning", 3)]
    assert rows[1].file.endswith("refs.bib") and rows[0].file is None


def test_command_line(spark, tmp_path, capsys):
    from folioscan.__main__ import main

    (tmp_path / "paper.tex").write_text("\\begin{document}\nWe cite \\cite{ghost} here.\n\\end{document}\n")
    assert main(["check", str(tmp_path / "paper.tex"), "--skip-grammar", "--skip-reviewer"]) == 1
    assert "not found in the bibliography" in capsys.readouterr().out
    assert main(["check", str(tmp_path / "*.tex"), "--skip-grammar", "--skip-reviewer", "--json"]) == 1
    shown = capsys.readouterr()
    assert json.loads(shown.out)["total"] == 1 and '\n  "total": 1,\n' in shown.out
    assert "no bibliography entries" in shown.err and "not there" not in shown.err
    (tmp_path / "named.tex").write_text("\\begin{document}\nWords.\n\\bibliography{gone}\n\\end{document}\n")
    main(["check", str(tmp_path / "named.tex"), "--skip-grammar", "--skip-reviewer"])
    assert "not there" in (said := capsys.readouterr().err) and said.count("gone.bib") == 1
    (tmp_path / "notes.txt").write_text("A TODO: add it")
    assert main(["check", str(tmp_path / "notes.txt"), "--skip-grammar", "--skip-reviewer"]) == 0
    assert main(["version"]) == 0


def test_own_check(spark, tmp_path):
    from pyspark.sql import functions as F

    from folioscan.operators import checks

    (tmp_path / "a.tex").write_text("\\begin{document}\nx\n\\end{document}\n")
    corpus = plan.load(spark, str(tmp_path))
    own = lambda c: checks.finding(c.docs, "own", "info", F.lit(1), F.lit("seen"), [0])
    assert [(r.checker, r.message) for r in plan.check(corpus, extra=[own]).collect()] == [("own", "seen")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tex").write_text("TODO: write this")
    for expected in (1, 2):
        q = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        q.awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        time.sleep(0.1)
        (tmp_path / "in" / "b.tex").write_text("FIXME")
