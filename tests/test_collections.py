"""Bibliographies that documents share: the findings of each document are those of its own entries."""

import pytest

from folioscan.operators import checks, replies
from folioscan.plans import check as plan
from folioscan.sources import lookups

DOCS = {
    "a.tex": "\\begin{document}\n\\cite{x}\n\\bibliography{one,two}\n\\end{document}\n",
    "b.tex": "\\begin{document}\n\\cite{x,gone}\n\\bibliography{one,two}\n\\end{document}\n",
    "c.tex": "\\begin{document}\n\\cite{y}\n\\bibliography{two}\n\\end{document}\n",
    "d.tex": "\\begin{document}\n\\cite{own}\n\\begin{thebibliography}{1}\\bibitem{own} ``T''\\bibitem{spare} ``S''\\end{thebibliography}\n\\end{document}\n",
    "e.tex": "\\begin{document}\n\\cite{z}\n\\bibliography{none}\n\\end{document}\n",
}
BIBS = {"one.bib": "@a{x, title={X}, doi={10/x}}\n@a{y, title={Y}}\n", "two.bib": "@a{y, title={Y2}, doi={10/y}}\n@a{w, title={W}}\n", "none.bib": "no entries\n"}


@pytest.fixture
def folder(tmp_path):
    for name, text in {**DOCS, **BIBS}.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def own(rows):
    return sorted((r.doc_path.rpartition("/")[2], r.checker, r.severity, r.line, r.message.replace(str(r.doc_path.rpartition("/")[0]) + "/", "")) for r in rows)


@pytest.mark.parametrize("given", [False, True])
def test_as_with_entries_of_each_document(spark, folder, given):
    corpus = plan.load(spark, str(folder), bib_paths=[f"{folder}/one.bib", f"{folder}/two.bib"] if given else None)
    known = lookups.from_table(spark.createDataFrame([("doi", "10/x", False, "no x"), ("doi", "10/y", False, "no y")], "target_kind string, target_id string, exists boolean, detail string"))
    shared = own(plan.check(corpus, verify=known).collect())
    apart = own(plan.check(plan.Corpus(corpus.docs, corpus.own_entries(), corpus.files), verify=known).collect())
    assert shared == apart and len(shared) > 10
    text = corpus.docs.sparkSession._jvm.PythonSQLUtils.explainString(plan.check(corpus)._jdf.queryExecution(), "simple")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if given:
        assert [m for f, c, _, _, m in shared if c == "citations" and f == "d.tex" and "Cited" in m] == ["Cited key 'own' not found in the bibliography."]
        assert corpus.entries.select("doc_path").distinct().count() == 1
    else:
        assert corpus.members.select("collection").distinct().count() == 3  # a and b share theirs; e has none
        assert [m for f, c, s, _, m in shared if f == "d.tex" and s == "info"] == ["Unused bibliography entry 'spare'."]
        assert [m for f, c, s, _, m in shared if f == "e.tex"] == ["Cited key 'z' not found in the bibliography."]


def test_claims_find_titles_of_their_collection(spark):
    found = spark.createDataFrame([("d1", "k"), ("d2", "k"), ("d3", "k")], "doc_path string, key string")
    entries = spark.createDataFrame([("c", 0, "k", "old"), ("c", 1, "k", "new"), ("e", 0, "k", "other")], "doc_path string, bib_idx int, key string, title string")
    members = spark.createDataFrame([("d1", "c"), ("d2", "e")], "doc_path string, collection string")
    assert sorted((r.doc_path, r.title) for r in replies.claim_titles(found, entries, members).collect()) == [("d1", "new"), ("d2", "other"), ("d3", None)]
    assert sorted(r.doc_path for r in checks.for_members(entries, members).collect()) == ["d1", "d1", "d2"]
