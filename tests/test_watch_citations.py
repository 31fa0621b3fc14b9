import os

import pytest

from folioscan.plans import check as plan
from folioscan.streaming.bibliographies import arriving, findings_now, watch_citations

FILES = {
    "a.tex": "\\begin{document}\nSee \\cite{x, y}.\n\\cite{none}\n\\bibliography{one,two}\n\\end{document}",
    "b.tex": "\\begin{document}\n\\cite{z}\n\\bibliography{one}\n\\end{document}",
    "c.tex": "\\begin{document}\n\\cite{i} \\cite{j}\n\\bibliography{absent}\n\\begin{thebibliography}{9}\n\\bibitem{i} I.\n\\bibitem{k} K.\n\\end{thebibliography}\n\\end{document}",
    "d.tex": "\\begin{document}\nnothing\n\\bibliography{two}\n\\end{document}",
    "one.bib": "@article{x,\n title = {X}}\n@comment{no, }\n@book{x,\n title = {X again}}\n@book{z, title = {Z}}\n",
    "two.bib": "@misc{y, title = {Y}}\n@misc{x, title = {X}}\n% @misc{w, title = {W}}\n",
}


def rows(df):
    return sorted((os.path.basename(r.doc_path), r.seq, r.severity, r.line, r.message.replace(os.path.dirname(r.doc_path) + "/", ""), os.path.basename(r.file or "")) for r in df.collect())


@pytest.fixture(scope="module")
def at_once(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("all")
    for name, text in FILES.items():
        (folder / name).write_text(text)
    found = rows(plan.check(plan.load(spark, str(folder))).where("checker = 'citations'"))
    assert {r[0] for r in found} == {"a.tex", "b.tex", "c.tex", "d.tex"} and {r[2] for r in found} == {"error", "info", "warning"}
    return found


@pytest.mark.parametrize("order", [["one.bib,two.bib", "a.tex,b.tex,c.tex,d.tex"], ["a.tex,c.tex", "two.bib", "b.tex,d.tex", "one.bib"], ["a.tex,b.tex,c.tex,d.tex,one.bib,two.bib"]])
def test_any_order_of_arrival_gives_what_a_batch_finds(spark, tmp_path, at_once, order):
    (tmp_path / "in").mkdir()
    for names in order:
        for name in names.split(","):
            (tmp_path / "in" / name).write_text(FILES[name])
        streams = (arriving(spark, str(tmp_path / "in"), s) for s in (".tex", ".bib"))
        query = watch_citations(*streams, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        assert query.awaitTermination(120) and query.exception() is None
    assert rows(findings_now(spark, str(tmp_path / "out"))) == at_once


def test_a_document_sent_again_is_checked_as_sent_last(spark, tmp_path):
    def send(kind, number, *files):
        spark.createDataFrame(files, "path string, source string").write.parquet(str(tmp_path / kind / f"{number}"))

    sent = [
        ("tex", ("/p/a.tex", "\\cite{x} \\bibliography{one}"), ("/p/empty.tex", None)),
        ("bib", ("/p/one.bib", "@misc{x, title = {X}}\n@misc{u, title = {U}}"), ("/p/none.bib", None), ("/p/unnamed.bib", "@misc{v, title = {V}}")),
        ("tex", ("/p/a.tex", "\\cite{y} \\bibliography{two}")),
        ("bib", ("/p/two.bib", "@misc{y, title = {Y}}\n@misc{u2, title = {U}}")),
    ]
    send("tex", "none")
    send("bib", "none")
    seen = []
    for number, (kind, *files) in enumerate(sent):
        send(kind, number, *files)
        streams = (spark.readStream.schema("path string, source string").option("recursiveFileLookup", "true").parquet(str(tmp_path / kind)) for kind in ("tex", "bib"))
        assert watch_citations(*streams, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)
        seen.append({(r.doc_path, r.message.split("'")[1], r.severity) for r in findings_now(spark, str(tmp_path / "out")).collect()})
    assert seen == [{("/p/a.tex", "x", "error")}, {("/p/a.tex", "u", "info")}, {("/p/a.tex", "y", "error")}, {("/p/a.tex", "u2", "info")}]


def test_state_follows_the_lists_and_not_the_documents(spark, tmp_path):
    def state_rows(n):
        folder = tmp_path / f"{n}"
        spark.createDataFrame([(f"/p/{i}.tex", "\\cite{x} \\bibliography{one,two}") for i in range(n)], "path string, source string").write.parquet(str(folder / "tex"))
        spark.createDataFrame([("/p/one.bib", "@misc{x, title = {X}}\n@misc{u, title = {U}}")], "path string, source string").write.parquet(str(folder / "bib"))
        streams = (spark.readStream.schema("path string, source string").parquet(str(folder / kind)) for kind in ("tex", "bib"))
        query = watch_citations(*streams, str(folder / "out"), str(folder / "cp"), once=True)
        assert query.awaitTermination(120)
        assert findings_now(spark, str(folder / "out")).where("severity = 'info'").count() == n
        return sum(o.numRowsTotal for o in query.recentProgress[-1].stateOperators)

    assert state_rows(60) == state_rows(6)


def test_a_list_that_comes_last_has_the_version_that_was_sent_last(spark, tmp_path):
    def send(kind, number, path, source):
        spark.createDataFrame([(path, source)], "path string, source string").write.parquet(str(tmp_path / kind / f"{number}"))
        for other in ("tex", "bib"):
            (tmp_path / other).mkdir(exist_ok=True)
        streams = (spark.readStream.schema("path string, source string").option("recursiveFileLookup", "true").parquet(str(tmp_path / k)) for k in ("tex", "bib"))
        assert watch_citations(*streams, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(120)

    send("bib", 0, "/p/one.bib", "@misc{z, title = {former}}")
    send("bib", 1, "/p/one.bib", "@misc{a, title = {latter}}")
    send("tex", 0, "/p/a.tex", "\\cite{none} \\bibliography{one}")
    assert [(r.severity, r.message.split("'")[1]) for r in findings_now(spark, str(tmp_path / "out")).orderBy("seq").collect()] == [("error", "none"), ("info", "a")]
