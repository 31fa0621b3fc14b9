import pytest

from folioscan.sources import lookups

HITS = "query string, rank int, title string, authors array<string>, year string, abstract string, url string, arxiv string, doi string"


def test_best_hit(spark):
    rows = [
        ("Exact Title", 0, "Other", ["A", ""], "x", None, None, "2401.1", None),
        ("Exact Title", 1, " exact title ", ["B"], "2001", "abs", "", None, "10.1"),
        ("Exact Title", 3, "Exact Title", [], None, None, None, None, None),
        ("none", 0, "", [], None, None, None, None, None),
        ("first", 0, "F", ["A", ""], "n/a", None, None, None, None),
    ]
    got = {r.query: tuple(r)[1:] for r in lookups.best_hits(spark.createDataFrame(rows, HITS)).collect()}
    assert got == {"Exact Title": ("exact title", ["B"], 2001, "abs", "10.1"), "first": ("F", ["A"], None, "", None)}


def test_hits_of_replies(spark):
    def get(title):
        if title == "fails":
            raise OSError
        return lookups.hits_of({"data": [{"title": title, "authors": [{"name": "A"}, {"name": ""}], "year": 2000, "externalIds": {"DOI": "d"}}] * 5})

    rows = lookups.searching("stub", lookups.Service(get))(spark.createDataFrame([("a",), ("fails",), ("a",), (None,)], "query string")).collect()
    assert len(rows) == 3 and rows[0].authors == ["A"] and rows[0].doi == "d" and rows[0].year == "2000" and rows[0].query == "a" and lookups.hits_of({}) == []


def test_scholar_result():
    assert lookups.scholar_result({"bib": {"title": " T ", "author": "A and B", "pub_year": "1999", "abstract": None}, "eprint_url": "e"}) == ("T", ["A", "B"], 1999, "", "e")
    assert lookups.scholar_result({}) == ("", [], None, "", None)


def test_arxiv_answer():
    space = 'xmlns="http://www.w3.org/2005/Atom"'
    assert lookups.arxiv_answer(f"<feed {space}><entry><title> A title </title></entry></feed>") == (True, "A title")
    assert lookups.arxiv_answer(f"<feed {space}></feed>")[0] is False


def test_backend_names():
    assert lookups.backend("semantic-scholar") is lookups.paper_search
    with pytest.raises(ValueError):
        lookups.backend("bogus")


def test_verdicts_ask_once(spark):
    targets = spark.createDataFrame([("d", 0, "a", "arxiv", "1"), ("d", 1, "a", "doi", "2"), ("e", 0, "b", "arxiv", "1"), ("e", 1, "c", None, None)], "doc_path string, bib_idx int, key string, target_kind string, target_id string")
    table = spark.createDataFrame([("arxiv", "1", False, "gone"), ("doi", "2", True, "")], "target_kind string, target_id string, exists boolean, detail string")
    assert sorted(map(tuple, lookups.verdicts(targets, lookups.from_table(table)).collect())) == [("d", "a", False, "gone"), ("e", "b", False, "gone")]


def test_card(spark):
    rows = spark.createDataFrame([("q", "T", [], None, "", None)], "query string, title string, authors array<string>, year int, abstract string, url string")
    assert [r.text for r in lookups.paper_card(rows).orderBy("line_no").collect()] == ["title: T", "authors: (unknown)", "year: (unknown)", "url: (none)", "abstract: (no abstract)"]


def test_kept_answers_are_not_asked_again(spark, tmp_path):
    asked = []

    def lookup(questions):
        asked.append(sorted(r.query for r in questions.collect()))
        return questions.selectExpr("query", "upper(query) AS title")

    stored = lookups.kept(lookup, str(tmp_path / "answers"), ("query",))
    frame = lambda *q: spark.createDataFrame([(x,) for x in q], "query string")
    assert sorted(tuple(r) for r in stored(frame("a", "b", "a")).collect()) == [("a", "A"), ("b", "B")]
    assert sorted(tuple(r) for r in stored(frame("b", "c")).collect()) == [("a", "A"), ("b", "B"), ("c", "C")]
    assert asked == [["a", "b"], ["c"]]
