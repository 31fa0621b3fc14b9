import json

import pytest
from pyspark.sql import functions as F

from folioscan.operators import parse, replies, report
from folioscan.sources import lookups


def findings(df):
    return [(r.severity, r.line, r.message, r.suggestion, r.excerpt) for r in report.numbered(df).orderBy("doc_path", "seq").collect()]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('Sure: {"a": {"b": 2}} done', {"a": {"b": 2}}),
        ('{"x": "\\cite{k}"}', {"x": "\\cite{k}"}),
        ("no json", None),
        ("", None),
    ],
)
def test_decoding(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "raw string").select(F.to_json(replies.decoded(F.col("raw"))).alias("v")).first().v
    assert (None if got is None else json.loads(got)) == expected


def para(spark, text, line=5):
    return spark.createDataFrame([("d", 0, text, line, line, "f.tex")], "doc_path string, para_idx int, text string, start_line int, end_line int, file string")


def test_grammar(spark):
    units = replies.grammar_units(para(spark, "The first line here\nand teh second one"))
    issues = {"issues": [{"excerpt": " teh ", "message": " typo ", "suggestion": "the"}, {"message": None, "severity": "BOGUS", "suggestion": ""}, {"excerpt": "nowhere", "message": "m", "severity": "error"}]}
    model = replies.python_model(lambda s, u: json.dumps(issues))
    got = findings(replies.grammar_findings(units, model(replies.grammar_requests(units))))
    assert got == [("warning", 6, "typo", "the", "teh"), ("warning", 5, "", None, None), ("error", 5, "m", None, "nowhere")]
    assert replies.grammar_units(para(spark, "\\maketitle")).count() == 0
    dead = replies.python_model(lambda s, u: None)
    assert findings(replies.grammar_findings(units, dead(replies.grammar_requests(units)))) == []


def test_review(docs_of):
    units = replies.review_units(parse.sections(docs_of("\\section{A}\n" + "x" * 2000 + "\n\\section{ }\nb")))
    prompts = [r.user for r in replies.review_requests(units, 500).orderBy("request_id").collect()]
    assert len(prompts[0]) < 1000 and "cut for length" in prompts[0] and prompts[0].startswith("Section title: A") and prompts[1].startswith("\\section")
    model = replies.python_model(lambda s, u: '{"comments": [{"category": "clarity", "severity": "BOGUS", "message": "vague"}, {"message": "x", "severity": "warning"}]}', 3)
    got = findings(replies.review_findings(units, model(replies.review_requests(units))))
    assert got[:2] == [("info", 1, "[clarity] vague", None, None), ("warning", 1, "x", None, None)] and len(got) == 4


def claims(spark, verdict, keys=("foo",), title="Paper", abstract="About it.", hits=True):
    units = replies.claim_units(para(spark, "It is so \\cite{foo, bar}."))
    assert "bar, foo" in replies.claim_requests(units).first().user
    reply = json.dumps({"claims": [{"claim": "it is so", "cite_keys": [*keys, " "]}, {"claim": ""}, "odd"]})
    found = replies.claims(units, replies.python_model(lambda s, u: reply)(replies.claim_requests(units)))
    entries = spark.createDataFrame([("d", 0, "foo", "old"), ("d", 1, "foo", title)], "doc_path string, bib_idx int, key string, title string")
    titled = replies.claim_titles(found, entries)
    table = spark.createDataFrame([(title, 0, title, ["A"], "2001", abstract, "u", None, None)] if hits else [], "query string, rank int, title string, authors array<string>, year string, abstract string, url string, arxiv string, doi string")
    units = replies.judge_units(titled, lookups.papers(replies.paper_questions(titled), lookups.from_table(table)))
    return findings(replies.claim_findings(units, replies.python_model(lambda s, u: verdict)(replies.judge_requests(units))))


def test_claims(spark):
    assert claims(spark, '{"verdict": " Supports "}') == []
    assert claims(spark, '{"verdict": "contradicts", "rationale": "no"}')[0][:3] == ("error", 5, "[contradicts] claim 'it is so' vs foo: no")
    assert claims(spark, "{}")[0][0] == "warning"
    assert [g[0] for g in claims(spark, "{}", keys=("none",))] == ["info"] and "Unknown cite key" in claims(spark, "{}", keys=("none",))[0][2]
    assert "No title in bib" in claims(spark, "{}", title="")[0][2]
    assert "Could not retrieve abstract" in claims(spark, "{}", hits=False)[0][2]
    assert "no abstract" in claims(spark, "{}", abstract="")[0][2]


def test_each_request_has_one_reply(spark):
    units = replies.grammar_units(para(spark, "The first line here is long enough"))
    request = units.first().request_id
    said = lambda *raw: spark.createDataFrame([(request, r) for r in raw], "request_id string, raw string")
    assert findings(replies.grammar_findings(units, said('{"issues": [{"message": "m"}]}'))) == [("warning", 5, "m", None, None)]
    assert findings(replies.grammar_findings(units, said(None))) == []
    with pytest.raises(Exception, match="no reply to request grammar#d#0"):
        replies.grammar_findings(units, said()).collect()
    with pytest.raises(Exception, match="2 replies to request grammar#d#0"):
        replies.grammar_findings(units, said("{}", "{}")).collect()


def test_prompts(spark):
    """What is sent, word for word."""
    sections = spark.createDataFrame([("d", 0, "T", "text", 1, 2, "f"), ("d", 1, "", "x" * 12_001, 3, 4, "f"), ("d", 2, "E", " \n", 5, 6, "f")], "doc_path string, sec_idx int, title string, text string, start_line int, end_line int, file string")
    sent = {r.request_id: (r.system, r.user) for r in replies.review_requests(replies.review_units(sections)).collect()}
    assert sent == {"review#d#0": (replies.REVIEW, "Section title: T\n\ntext"), "review#d#1": (replies.REVIEW, "x" * 12_000 + replies.CUT_NOTE)}
    units = replies.claim_units(para(spark, "It is so \\cite{b, a} and \\cite{b}."))
    assert [(r.system, r.user) for r in replies.claim_requests(units).collect()] == [(replies.EXTRACT, "Cite keys present: a, b\n\nParagraph:\nIt is so \\cite{b, a} and \\cite{b}.")]
    judged = spark.createDataFrame([("r", "c", "P", "A", "ready"), ("s", "c", None, None, "unknown")], "request_id string, claim string, paper_title string, abstract string, state string")
    assert [tuple(r) for r in replies.judge_requests(judged).collect()] == [("r", replies.JUDGE, "Claim: c\n\nCited paper title: P\n\nAbstract: A")]
