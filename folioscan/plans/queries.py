"""The registered queries: each operator over derived relations, and the SQL that DuckDB answers it with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as t
from folioscan.operators import bib, checks, parse, replies, report
from folioscan.plans import check as whole
from folioscan.plans import oracle as o
from folioscan.plans import own
from folioscan.rules import RULES
from folioscan.sources import derived as d
from folioscan.sources import files, lookups, reports, tables
from folioscan.streaming import bibliographies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return d.relation(spark, sf, d.TEX_DOCS).select("doc_path", "source")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """One shared bibliography, under the name of one collection."""
    rows = d.relation(spark, sf, d.BIB_ROWS)
    return rows.select(F.lit("all").alias("doc_path"), F.col("line").alias("bib_idx"), F.col("bib_key").alias("key"), "entry_type", "file", "line", "title", F.lit("").alias("author"), "eprint", "doi")


def _cites(spark: SparkSession, sf: str) -> DataFrame:
    return parse.citations(_docs(spark, sf))


def _longs(rows: DataFrame) -> DataFrame:
    return rows.select([F.col(c).cast("long").alias(c) if kind in ("int", "smallint") else F.col(c) for c, kind in rows.dtypes])


def _plain(rows: DataFrame) -> DataFrame:
    """Findings with the columns that the SQL gives."""
    return _longs(rows.select("doc_path", "checker", "severity", "line", "message", "excerpt", "file"))


@query(f"WITH {o.TEX} SELECT doc_path, {o.strip_comments('source')} AS text FROM tex")
def comment_strip(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_path", t.strip_comments(F.col("source")).alias("text"))


@query(f"WITH {o.BODY} SELECT doc_path, body, CAST(start_line AS BIGINT) AS start_line FROM body")
def body_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(parse.with_body(_docs(spark, sf)))


@query(f"WITH {o.TEX} SELECT doc_path, split_part(source, '{t.BEGIN}', 1) AS preamble FROM tex")
def preamble_extract(spark: SparkSession, sf: str) -> DataFrame:
    return parse.with_preamble(_docs(spark, sf))


@query(f"WITH {o.TEX} SELECT doc_path, CAST({o.newlines('source')} AS BIGINT) AS n FROM tex")
def newline_count(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(_docs(spark, sf).select("doc_path", t.newlines(F.col("source")).alias("n")))


@query(f"WITH {o.TEX}, {o.LINES} SELECT doc_path, combined_line, text FROM lines")
def source_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(parse.source_lines(_docs(spark, sf)).select("doc_path", "combined_line", "text"))


@query(f"WITH {o.TEX}, {o.CITES} SELECT doc_path, cite_idx, key, line FROM cites")
def cite_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(_cites(spark, sf))


@query(f"WITH {o.TEX}, {o.RESOURCES} SELECT doc_path, res_idx, name FROM resources")
def bib_resource_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(parse.bib_resources(_docs(spark, sf)))


@query(f"WITH {o.TEX}, {o.GRAPHICS} SELECT doc_path, img_idx, raw_path, line FROM graphics")
def graphics_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(parse.graphics(_docs(spark, sf)))


@query(f"WITH {o.TEX}, {o.REFS} SELECT doc_path, label FROM refs")
def ref_scan(spark: SparkSession, sf: str) -> DataFrame:
    return parse.refs(_docs(spark, sf))


@query(f"WITH {o.TEX}, {o.FLOATS}, {o.LABELS} SELECT * FROM labels")
def label_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(parse.labels(parse.floats(_docs(spark, sf))))


@query(f"WITH {o.TEX}, {o.FLOATS} SELECT doc_path, float_idx, env_type, content, start_line, end_line, caption, array_to_string(labels, ',') AS labels FROM floats")
def float_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(parse.floats(_docs(spark, sf)).withColumn("labels", F.array_join("labels", ",")))


@query(f"WITH {o.BIB_HEADERS} SELECT file, bib_idx, key, entry_type, line FROM headers")
def bib_header_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(bib.bib_headers(d.relation(spark, sf, d.BIB_FILES)))


@query(f"""WITH {o.BIB_HEADERS} SELECT file, bib_idx, key, entry_type, line,
  CASE WHEN entry_type = 'book' THEN 'Next' ELSE 'The Part ' || substr(key, 5) END AS title,
  CASE WHEN entry_type = 'book' THEN '' ELSE 'Some Body and Others' END AS author,
  regexp_extract(block, 'eprint = .(2401[.][0-9]+)', 1) AS eprint, regexp_extract(block, 'doi = "([^"]*)"', 1) AS doi FROM headers""")
def bib_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(bib.bib_file_entries(d.relation(spark, sf, d.BIB_FILES)))


def _artifacts(spark: SparkSession, sf: str, severity: str, column: str) -> DataFrame:
    docs = _docs(spark, sf)
    rows = parse.with_body(docs) if column == "body" else parse.with_preamble(docs).withColumn("start_line", F.lit(1))
    found = checks.scan_rules(rows, column, tuple(r for r in RULES if r.severity == severity))
    return _longs(found.select("doc_path", "rule_idx", "match_idx", "category", "message", (F.col("line") + F.col("start_line") - 1).alias("line"), "excerpt"))


@query(f"WITH {o.BODY}, {o.artifacts('body', 'error')} SELECT * FROM found")
def artifact_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _artifacts(spark, sf, "error", "body")


@query(f"WITH {o.BODY}, {o.artifacts('body', 'warning')} SELECT * FROM found")
def artifact_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return _artifacts(spark, sf, "warning", "body")


@query(f"WITH {o.PREAMBLE}, {o.artifacts('preamble', 'error')} SELECT * FROM found")
def artifact_preamble(spark: SparkSession, sf: str) -> DataFrame:
    return _artifacts(spark, sf, "error", "preamble")


@query(o.RULE_FINDINGS)
def artifact_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule on texts planted for it, in body and preamble."""
    rows = checks.artifacts(d.relation(spark, sf, d.RULE_DOCS).select("doc_path", "source"))
    order = F.col("ord")
    return _longs(rows.select("doc_path", (order[2] + 1).alias("rule"), (order[0] == 1).alias("in_preamble"), "severity", "line", "excerpt"))


def _all(cites: DataFrame) -> DataFrame:
    return cites.withColumn("doc_path", F.lit("all"))


@query(f"WITH {o.TEX}, {o.CITES}, {o.BIB} SELECT 'all' AS doc_path, 'citations' AS checker, 'error' AS severity, line, 'Cited key ''' || key || ''' not found in the bibliography.' AS message, chr(92) || 'cite{{' || key || '}}' AS excerpt, CAST(NULL AS VARCHAR) AS file FROM cites WHERE key NOT IN (SELECT key FROM bib)")
def missing_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(checks.missing_citations(_all(_cites(spark, sf)), _entries(spark, sf)))


@query(f"WITH {o.TEX}, {o.CITES}, {o.BIB} SELECT 'all' AS doc_path, 'citations' AS checker, 'info' AS severity, line, 'Unused bibliography entry ''' || key || '''.' AS message, CAST(NULL AS VARCHAR) AS excerpt, file FROM ranked WHERE n = 1 AND key NOT IN (SELECT key FROM cites)")
def unused_bib(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(checks.unused_entries(_all(_cites(spark, sf)), _entries(spark, sf)))


@query(f"WITH {o.BIB} SELECT 'all' AS doc_path, 'citations' AS checker, 'warning' AS severity, line, 'Duplicate bibliography key ''' || key || ''' (first defined at ' || file || ':' || CAST(first_line AS VARCHAR) || ').' AS message, CAST(NULL AS VARCHAR) AS excerpt, file FROM ranked WHERE n > 1")
def duplicate_bib(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(checks.duplicate_entries(_entries(spark, sf)))


@query(f"WITH {o.TEX}, {o.FLOATS} SELECT doc_path, float_idx, env_type, start_line AS line FROM floats WHERE caption IS NULL")
def missing_caption(spark: SparkSession, sf: str) -> DataFrame:
    rows = checks.missing_captions(parse.floats(_docs(spark, sf)))
    return _longs(rows.select("doc_path", F.col("ord")[0].alias("float_idx"), F.substring_index("message", " ", 1).alias("env_type"), "line"))


@query(f"WITH {o.TEX}, {o.FLOATS} SELECT doc_path, float_idx, start_line AS line, substr(caption, 1, 80) AS excerpt FROM floats WHERE regexp_matches(caption, '{o.CAPTIONS}')")
def placeholder_caption(spark: SparkSession, sf: str) -> DataFrame:
    rows = checks.placeholder_captions(parse.floats(_docs(spark, sf)))
    return _longs(rows.select("doc_path", F.col("ord")[0].alias("float_idx"), "line", "excerpt"))


@query(f"WITH {o.TEX}, {o.FLOATS}, {o.LABELS}, {o.REFS} SELECT doc_path, float_idx, label_idx, line FROM labels l WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_path = l.doc_path AND r.label = l.label)")
def orphan_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    rows = checks.orphan_labels(parse.floats(docs), parse.refs(docs))
    return _longs(rows.select("doc_path", F.col("ord")[0].alias("float_idx"), F.col("ord")[2].alias("label_idx"), "line"))


@query(f"WITH {o.TEX}, {o.FLOATS} SELECT doc_path, float_idx, start_line AS line FROM floats WHERE {o.NEAR_EMPTY}")
def near_empty_floats(spark: SparkSession, sf: str) -> DataFrame:
    rows = checks.near_empty_floats(parse.floats(_docs(spark, sf)))
    return _longs(rows.select("doc_path", F.col("ord")[0].alias("float_idx"), "line"))


@query(f"WITH {o.BODY}, {o.PARAGRAPHS} SELECT * FROM paragraphs")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(parse.paragraphs(_docs(spark, sf)).drop("file"))


@query(f"WITH {o.BODY}, {o.PARAGRAPHS} SELECT doc_path, para_idx, start_line FROM paragraphs WHERE {o.PROSE}")
def prose_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(parse.prose_paragraphs(parse.paragraphs(_docs(spark, sf))).select("doc_path", "para_idx", "start_line"))


@query(f"WITH {o.BODY}, {o.SECTIONS} SELECT * FROM sections")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(parse.sections(_docs(spark, sf)).drop("file"))


@query(f"WITH {o.BODY}, {o.SECTIONS} SELECT doc_path, sec_idx, length(text) AS n_chars FROM sections WHERE text <> ''")
def nonempty_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = replies.review_units(parse.sections(_docs(spark, sf)))
    return _longs(rows.select("doc_path", "sec_idx", F.length("text").alias("n_chars")))


@query(f"WITH {o.TEX}, {o.INLINE} SELECT doc_path, bib_idx, key, line, title FROM inline_items")
def inline_bibitems(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(parse.inline_bibitems(_docs(spark, sf)).select("doc_path", "bib_idx", "key", "line", "title"))


@query(f"""WITH {o.TEX}, {o.INLINE}, {o.RESOURCES}, {o.BIB}, named AS (SELECT doc_path, key, bib.line AS line, title FROM resources, bib WHERE name = 'refs')
SELECT * FROM named UNION ALL SELECT doc_path, key, line, title FROM inline_items WHERE doc_path NOT IN (SELECT doc_path FROM named)""")
def bib_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(_own_entries(spark, sf, _docs(spark, sf)).select("doc_path", "key", "line", "title"))


def _own_entries(spark: SparkSession, sf: str, docs: DataFrame) -> DataFrame:
    """Each document's bibliography: the files that it names, else the entries inside it."""
    named = checks.missing_bib_files(docs, d.relation(spark, sf, d.BIB_LISTING)).where("found").select("doc_path", F.col("path").alias("file"))
    columns = ["doc_path", "bib_idx", "key", "entry_type", "file", "line", "title", "author", "eprint", "doi"]
    entries = named.join(_entries(spark, sf).drop("doc_path"), "file").select(columns)
    return bib.with_fallback(entries, parse.inline_bibitems(docs).select(columns))


def _includes(spark: SparkSession, sf: str, pages: str = d.INCLUDE_FILES) -> DataFrame:
    """Every page is a root."""
    sources = d.relation(spark, sf, pages)
    return files.expand_includes(sources, sources.selectExpr("path AS doc_path"))


@query(f"WITH RECURSIVE {o.INCLUDES} SELECT doc_path, combined_line, text FROM expanded")
def include_expand(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(_includes(spark, sf).select("doc_path", "combined_line", "text"))


@query(f"WITH RECURSIVE {o.INCLUDES} SELECT doc_path, combined_line, origin_file, origin_line FROM expanded")
def line_origin(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(_includes(spark, sf).select("doc_path", "combined_line", "origin_file", "origin_line"))


def _expanded(spark: SparkSession, sf: str) -> DataFrame:
    return files.joined_sources(_includes(spark, sf, d.TREE_FILES), d.relation(spark, sf, d.TREE_FILES).selectExpr("path AS doc_path"))


@query(f"WITH RECURSIVE {o.SOURCES}")
def expanded_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The sources with their includes in place, put together again."""
    return _expanded(spark, sf).select("doc_path", "source")


@query(f"WITH RECURSIVE {o.ORIGINS}")
def paragraph_origins(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of expanded sources, by the files and lines that they came from."""
    return _longs(parse.paragraphs(_expanded(spark, sf)).drop("text"))


@query(f"WITH {o.TEX}, {o.GRAPHICS}, listing AS ({o.duck(d.IMAGE_FILES)}) SELECT doc_path, 'images' AS checker, 'error' AS severity, line, 'Image file not found: ''' || raw_path || '''' AS message, raw_path AS excerpt, CAST(NULL AS VARCHAR) AS file FROM graphics WHERE raw_path NOT IN (SELECT path FROM listing)")
def missing_images(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(checks.images(_docs(spark, sf), d.relation(spark, sf, d.IMAGE_FILES)))


@query(f"WITH {o.TEX}, {o.RESOURCES} SELECT doc_path, res_idx, name, path, path IN ({d.BIB_LISTING}) AS found FROM (SELECT *, CASE WHEN suffix(name, '.bib') THEN name ELSE name || '.bib' END AS path FROM resources) r")
def missing_bib_files(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(checks.missing_bib_files(_docs(spark, sf), d.relation(spark, sf, d.BIB_LISTING)))


def _verdicts(spark: SparkSession, sf: str, entries: DataFrame) -> DataFrame:
    table = d.relation(spark, sf, d.VERIFICATION_ROWS).withColumnRenamed("found", "exists")
    return lookups.verdicts(checks.verify_targets(entries), lookups.from_table(table))


@query(f"""WITH {o.BIB}, v AS ({o.duck(d.VERIFICATION_ROWS)}), firsts AS (SELECT key, CASE WHEN eprint <> '' THEN eprint ELSE doi END AS target FROM ranked WHERE n = 1)
SELECT 'all' AS doc_path, 'references' AS checker, 'error' AS severity, ranked.line, 'Reference ''' || key || '''' || CASE WHEN eprint <> '' THEN ' has arXiv ID ''' || eprint || ''' but arXiv knows nothing of it: ' ELSE ' has DOI ''' || doi || ''' but doi.org knows nothing of it: ' END || v.detail AS message, CAST(NULL AS VARCHAR) AS excerpt, file
FROM ranked JOIN firsts USING (key) JOIN v ON v.target_id = firsts.target WHERE NOT v.found""")
def reference_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    entries = _entries(spark, sf)
    return _plain(checks.references(entries, _verdicts(spark, sf, entries)))


def _stub_verdict(key: str) -> tuple[bool, str]:
    """What a service says of an entry: every fifth is unknown to it."""
    item = int(key.rpartition("/")[2]) if "/" in key else int(key.rpartition(".")[2]) - 10000
    return item % 5 != 0, f"detail {item}"


@query(f"WITH {o.BIB}, v AS ({o.duck(d.VERIFICATION_ROWS)}) SELECT DISTINCT target_kind, target_id, found AS exists, detail FROM v JOIN bib ON target_id = CASE WHEN eprint <> '' THEN eprint ELSE doi END")
def asked_references(spark: SparkSession, sf: str) -> DataFrame:
    """The targets of all entries, asked of services that stand for the live ones."""
    service = lookups.Service(_stub_verdict)
    return lookups.verifying({"arxiv": service, "doi": service})(checks.verify_targets(_entries(spark, sf)))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.relation(spark, sf, d.PAPER_HITS)
    return rows.select("query", F.col("hit_rank").alias("rank"), "title", F.array(F.lit("A"), F.lit("")).alias("authors"), "year", "abstract", "url", "arxiv", F.lit(None).cast("string").alias("doi"))


@query(f"WITH {o.PAPERS} SELECT query, title, year, abstract, url FROM papers")
def best_title_match(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(lookups.best_hits(_hits(spark, sf)).select("query", "title", "year", "abstract", "url"))


@query(f"""WITH {o.BIB}, {o.PAPERS} SELECT key, ranked.title, CASE WHEN ranked.title = '' THEN 'untitled' WHEN p.query IS NULL THEN 'unfound' WHEN p.abstract = '' THEN 'empty' ELSE 'ready' END AS state, p.abstract
FROM ranked LEFT JOIN papers p ON p.query = ranked.title WHERE n_last = 1""")
def paper_lookup(spark: SparkSession, sf: str) -> DataFrame:
    entries = _entries(spark, sf)
    asked = bib.last_by_key(entries).select("doc_path", F.lit(0).alias("para_idx"), F.lit(0).alias("claim_idx"), F.lit(0).alias("key_idx"), F.lit("").alias("claim"), "key", "title")
    units = replies.judge_units(asked, lookups.best_hits(_hits(spark, sf)))
    return units.select("key", "title", "state", "abstract")


def _canned(spark: SparkSession, sf: str) -> DataFrame:
    return d.relation(spark, sf, d.GRAMMAR_REPLIES)


@query(o.GRAMMAR)
def grammar_findings(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.relation(spark, sf, "SELECT doc_id, coalesce(text, '') AS text FROM documents")
    paras = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_path"), F.lit(0).alias("para_idx"), "text", F.lit(5).alias("start_line"), F.lit(None).cast("string").alias("file"))
    units = replies.grammar_units(paras)
    canned = _canned(spark, sf).select(F.concat(F.lit("grammar#d"), F.col("doc_id").cast("string"), F.lit("#0")).alias("request_id"), "raw")
    return _plain(replies.grammar_findings(units, canned))


@query(f"""WITH {o.BODY}, {o.SECTIONS} SELECT doc_path, 'reviewer' AS checker, CASE sec_idx % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'error' ELSE 'info' END AS severity, start_line AS line,
  CASE sec_idx % 3 WHEN 0 THEN '[clarity] c' WHEN 1 THEN 'no category' ELSE '[scope] s' END AS message, CAST(NULL AS VARCHAR) AS excerpt, doc_path AS file FROM sections WHERE text <> ''""")
def reviewer_findings(spark: SparkSession, sf: str) -> DataFrame:
    units = replies.review_units(parse.sections(_docs(spark, sf)))
    raw = F.when(F.col("sec_idx") % 3 == 0, '{"comments": [{"category": "clarity", "message": "c", "severity": "LOUD"}]}').when(F.col("sec_idx") % 3 == 1, '{"comments": [{"message": "no category", "severity": "error"}]}').otherwise('{"comments": [{"category": "scope", "message": " s "}]}')
    return _plain(replies.review_findings(units, units.select("request_id", raw.alias("raw"))))


@query(o.CLAIMS)
def claim_findings(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    units = replies.claim_units(parse.paragraphs(docs))
    raw = F.concat(F.lit('{"claims": [{"claim": "it holds", "cite_keys": ["'), F.col("keys")[0], F.lit('", " "]}, {"claim": ""}]}'))
    found = replies.claims(units, units.select("request_id", raw.alias("raw")))
    last = bib.last_by_key(_entries(spark, sf)).select("key", "title")
    judged = replies.judge_units(found.join(last, "key", "left"), lookups.best_hits(_hits(spark, sf)))
    verdict = F.when(F.col("para_idx") % 3 == 0, '{"verdict": "Supports"}').when(F.col("para_idx") % 3 == 1, '{"verdict": "contradicts", "rationale": "r"}').otherwise("{}")
    return _plain(replies.claim_findings(judged, judged.where("state = 'ready'").select("request_id", verdict.alias("raw"))))


def _stored_replies(requests: DataFrame) -> DataFrame:
    """A reply to each kind of request, by the number of its paragraph or section."""
    requests = requests.select("request_id", "user", F.split("request_id", "#").alias("part"))  # once, not in each condition
    kind, turn = F.col("part")[0], F.col("part")[2].cast("int") % 3
    key = F.regexp_extract("user", r"\ACite keys present: ([^,\n]*)", 1)
    grammar = F.when(turn == 0, '{"issues": []}').when(turn == 1, '```json\n{"issues": [{"excerpt": "See", "message": "m", "severity": "info"}]}\n```').otherwise('{"issues": [{"message": "vague", "severity": "BOGUS"}, {"message": "second"}]}')
    review = F.when(turn == 0, '{"comments": [{"category": "clarity", "message": "c", "severity": "LOUD"}]}').when(turn == 1, '{"comments": [{"message": "no category", "severity": "error"}]}').otherwise('{"comments": [{"category": "scope", "message": " s "}]}')
    extract = F.concat(F.lit('{"claims": [{"claim": "it holds", "cite_keys": ["'), key, F.lit('", " "]}, {"claim": ""}]}'))
    judge = F.when(turn == 0, '{"verdict": "Supports"}').when(turn == 1, '{"verdict": "contradicts", "rationale": "r"}').otherwise("{}")
    return requests.select("request_id", F.when(kind == "grammar", grammar).when(kind == "review", review).when(kind == "extract", extract).otherwise(judge).alias("raw"))


@query(o.WHOLE)
def whole_check(spark: SparkSession, sf: str) -> DataFrame:
    """All eight checks over all documents, with stored answers for the model, the references and the search."""
    return _longs(_whole(spark, sf)[1].drop("suggestion"))


def _whole(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(documents, findings of all eight checks)"""
    docs = whole.parse_once(_docs(spark, sf))
    entries, members = whole.shared(docs, d.relation(spark, sf, d.BIB_LISTING), _entries(spark, sf).drop("doc_path"))
    corpus = whole.Corpus(docs, entries, d.relation(spark, sf, d.IMAGE_FILES), members)
    known = lookups.from_table(d.relation(spark, sf, d.VERIFICATION_ROWS).withColumnRenamed("found", "exists"))
    return docs, whole.check(corpus, _stored_replies, known, lookups.from_table(_hits(spark, sf)), enable_claims=True)


@query(f"""SELECT *, count(*) OVER (PARTITION BY doc_path) AS total, count(*) FILTER (severity = 'error') OVER (PARTITION BY doc_path) AS errors,
  count(*) FILTER (severity = 'warning') OVER (PARTITION BY doc_path) AS warnings, count(*) FILTER (severity = 'info') OVER (PARTITION BY doc_path) AS infos FROM ({o.WHOLE}) w""")
def whole_report(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON reports of all eight checks, read back field by field from their text."""
    kind = "file string, total long, by_severity map<string,long>, findings array<struct<checker:string,severity:string,line:long,message:string,excerpt:string,file:string>>"
    rows = report.report_json(*_whole(spark, sf)).select(F.from_json("json", kind).alias("j")).select("j.*").withColumnRenamed("file", "doc_path")
    count = lambda s: F.coalesce(F.try_element_at("by_severity", F.lit(s)), F.lit(0)).cast("long")
    rows = rows.select("doc_path", "total", count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"), F.posexplode("findings").alias("at", "f"))
    return rows.select("doc_path", (F.col("at") + 1).cast("long").alias("seq"), "f.*", "total", "errors", "warnings", "infos")


@query(f"""WITH all_findings AS ({o.WHOLE}), {o.TEX} SELECT tex.doc_path, count(f.seq) AS total, count(f.seq) FILTER (f.severity = 'error') AS errors,
  sha256(coalesce(string_agg(concat_ws('|', f.checker, f.severity, f.line, f.message, coalesce(f.excerpt, '-'), coalesce(f.file, '-')), chr(10) ORDER BY f.seq), '')) AS findings_sha256 FROM tex LEFT JOIN all_findings f USING (doc_path) GROUP BY tex.doc_path""")
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """The reports of all documents over all eight checks, written as files and read back."""
    folder = tables.folder(spark)
    reports.write_reports(*_whole(spark, sf), folder)
    rows = reports.read_reports(spark, folder)
    text = F.transform("findings", lambda f: F.concat_ws("|", f["checker"], f["severity"], f["line"].cast("string"), f["message"], F.coalesce(f["excerpt"], F.lit("-")), F.coalesce(f["file"], F.lit("-"))))
    errors = F.coalesce(F.try_element_at("by_severity", F.lit("error")), F.lit(0)).cast("long")
    return rows.select(F.col("file").alias("doc_path"), "total", errors.alias("errors"), F.sha2(F.array_join(text, "\n"), 256).alias("findings_sha256"))


@own.row_check("closings")
def _closings(doc_path: str, source: str):
    """A check of one's own: lines that say that they close."""
    for n, line in enumerate(source.split("\n"), 1):
        if "closing" in line:
            yield "info", n, f"Line of {len(line)} characters closes.", None, line


@query(f"""WITH {o.TEX}, {o.LINES} SELECT doc_path, 'closings' AS checker, 'info' AS severity, combined_line AS line, 'Line of ' || CAST(length(text) AS VARCHAR) || ' characters closes.' AS message, text AS excerpt, CAST(NULL AS VARCHAR) AS file
FROM lines WHERE contains(text, 'closing')""")
def own_check(spark: SparkSession, sf: str) -> DataFrame:
    """A check of one's own as a table function in SQL."""
    view = f"docs_{uuid.uuid4().hex}"
    _docs(spark, sf).createOrReplaceTempView(view)
    spark.udtf.register("closings", _closings)
    return _plain(spark.sql(f"SELECT * FROM closings(TABLE({view}) PARTITION BY doc_path)"))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return report.numbered(checks.figures(docs).unionByName(checks.images(docs, d.relation(spark, sf, d.IMAGE_FILES))))


@query(f"WITH {o.FINDINGS} SELECT doc_path, severity, count(*) AS n FROM findings GROUP BY ALL")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.severity_counts(_findings(spark, sf))


@query(f"WITH {o.FINDINGS} SELECT tex.doc_path, count(f.doc_path) AS n_findings, coalesce(bool_or(f.severity = 'error'), false) AS has_error FROM tex LEFT JOIN findings f USING (doc_path) GROUP BY ALL")
def any_error(spark: SparkSession, sf: str) -> DataFrame:
    return report.exit_status(_docs(spark, sf), _findings(spark, sf))


@query(f"WITH {o.FINDINGS} SELECT doc_path, row_number() OVER (PARTITION BY doc_path ORDER BY line, checker, seq) AS place, checker, severity, line FROM findings")
def report_order(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(report.ordered_report(_findings(spark, sf)).select("doc_path", "place", "checker", "severity", "line"))


@query(f"""WITH {o.FINDINGS} SELECT tex.doc_path AS file, count(f.doc_path) AS total, count(*) FILTER (f.severity = 'error') AS errors, count(*) FILTER (f.severity = 'warning') AS warnings,
  array_to_string(list(f.severity ORDER BY f.seq) FILTER (f.seq IS NOT NULL), ',') AS severities FROM tex LEFT JOIN findings f USING (doc_path) GROUP BY ALL""")
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of the JSON reports, read back from their text."""
    rows = report.report_json(_docs(spark, sf), _findings(spark, sf))
    j = F.from_json("json", "file string, total long, by_severity map<string,long>, findings array<struct<severity:string>>")
    count = lambda s: F.coalesce(F.try_element_at(F.col("j.by_severity"), F.lit(s)), F.lit(0)).cast("long")
    severities = F.when(F.size("j.findings") > 0, F.array_join(F.transform("j.findings", lambda f: f["severity"]), ","))
    return rows.select(j.alias("j")).select("j.file", "j.total", count("error").alias("errors"), count("warning").alias("warnings"), severities.alias("severities"))


@query(f"""WITH {o.BODY}, {o.PARAGRAPHS}, {o.INLINE}, p AS (SELECT doc_path, count(*) AS n FROM paragraphs GROUP BY ALL), e AS (SELECT doc_path, count(*) AS n FROM inline_items GROUP BY ALL)
SELECT tex.doc_path, coalesce(p.n, 0) AS n_paragraphs, coalesce(e.n, 0) AS n_entries, CASE WHEN e.n > 0 THEN 1 ELSE 0 END AS n_bib_files FROM tex LEFT JOIN p USING (doc_path) LEFT JOIN e USING (doc_path)""")
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return report.run_stats(docs, parse.paragraphs(docs), parse.inline_bibitems(docs))


@query(o.REPORT_TEXT)
def report_text(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(report.report_lines(_docs(spark, sf), _findings(spark, sf)))


@query(f"""WITH {o.PAPERS} SELECT query, line_no, text FROM (SELECT query, unnest([0, 1, 2, 3, 4]) AS line_no, unnest(['title: ' || title, 'authors: A', 'year: ' || coalesce(CAST(year AS VARCHAR), '(unknown)'), 'url: ' || coalesce(nullif(url, ''), '(none)'), 'abstract: ' || coalesce(nullif(abstract, ''), '(no abstract)')]) AS text FROM papers) x""")
def paper_cards(spark: SparkSession, sf: str) -> DataFrame:
    return _longs(lookups.paper_card(lookups.best_hits(_hits(spark, sf))))


_CITATION_SQL = ", ".join(("'all' AS doc_path", "'citations' AS checker", "CAST(NULL AS VARCHAR) AS suggestion"))


@query(f"""WITH {o.TEX}, {o.CITES}, {o.BIB}
SELECT {_CITATION_SQL}, 'error' AS severity, line, 'Cited key ''' || key || ''' not found in the bibliography.' AS message, chr(92) || 'cite{{' || key || '}}' AS excerpt, CAST(NULL AS VARCHAR) AS file FROM cites WHERE key NOT IN (SELECT key FROM bib)
UNION ALL SELECT {_CITATION_SQL}, 'info', line, 'Unused bibliography entry ''' || key || '''.', CAST(NULL AS VARCHAR), file FROM ranked WHERE n = 1 AND key NOT IN (SELECT key FROM cites)
UNION ALL SELECT {_CITATION_SQL}, 'warning', line, 'Duplicate bibliography key ''' || key || ''' (first defined at ' || file || ':' || CAST(first_line AS VARCHAR) || ').', CAST(NULL AS VARCHAR), file FROM ranked WHERE n > 1""")
def citation_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: all findings about citations of one shared bibliography."""
    entries = _entries(spark, sf)
    cites = _all(_cites(spark, sf))
    parts = checks.missing_citations(cites, entries).unionByName(checks.unused_entries(cites, entries)).unionByName(checks.duplicate_entries(entries))
    return _longs(parts.drop("ord"))


@query(f"""WITH tex AS ({d.NAMING_DOCS}), {o.CITES}, {o.RESOURCES}, {o.BIB_HEADERS}, {o.INLINE},
of_files AS (SELECT doc_path, res_idx * 1000000000000 + bib_idx AS place, key, file, line FROM resources JOIN headers ON file = CASE WHEN suffix(name, '.bib') THEN name ELSE name || '.bib' END),
entries AS (SELECT * FROM of_files UNION ALL SELECT doc_path, bib_idx, key, doc_path, line FROM inline_items WHERE doc_path NOT IN (SELECT doc_path FROM of_files)),
ranked AS (SELECT *, row_number() OVER w AS n, first_value(file) OVER w AS first_file, first_value(line) OVER w AS first_line FROM entries WINDOW w AS (PARTITION BY doc_path, key ORDER BY place))
SELECT doc_path, 'citations' AS checker, 'error' AS severity, line, 'Cited key ''' || key || ''' not found in the bibliography.' AS message, chr(92) || 'cite{{' || key || '}}' AS excerpt, CAST(NULL AS VARCHAR) AS file FROM cites WHERE (doc_path, key) NOT IN (SELECT doc_path, key FROM entries)
UNION ALL SELECT doc_path, 'citations', 'info', line, 'Unused bibliography entry ''' || key || '''.', NULL, file FROM ranked WHERE n = 1 AND (doc_path, key) NOT IN (SELECT doc_path, key FROM cites)
UNION ALL SELECT doc_path, 'citations', 'warning', line, 'Duplicate bibliography key ''' || key || ''' (first defined at ' || first_file || ':' || CAST(first_line AS VARCHAR) || ').', NULL, file FROM ranked WHERE n > 1""")
def watched_citations(spark: SparkSession, sf: str) -> DataFrame:
    """The check of citations by streams: documents and bibliographies arrive a few files at a time."""
    arrived, out = tables.folder(spark), tables.folder(spark)
    d.relation(spark, sf, d.NAMING_DOCS).select(F.col("doc_path").alias("path"), "source").write.parquet(f"{arrived}/tex")
    d.relation(spark, sf, d.BIB_FILES).write.parquet(f"{arrived}/bib")
    streams = [spark.readStream.schema("path string, source string").option("maxFilesPerTrigger", n).parquet(f"{arrived}/{kind}") for kind, n in (("tex", 8), ("bib", 1))]
    done = bibliographies.watch_citations(*streams, f"{out}/found", f"{out}/progress", once=True)
    done.awaitTermination()
    return _plain(bibliographies.findings_now(spark, f"{out}/found"))
