"""The deterministic checks. Each returns findings without a seq: (doc_path, checker, severity, line, message, suggestion, excerpt, file, ord).

ord orders the findings of one checker within a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import text as t
from folioscan.operators import parse
from folioscan.rules import PLACEHOLDER_CAPTION, RULES, Rule
from folioscan.sources.tables import growing

FINDING = ("doc_path", "checker", "severity", "line", "message", "suggestion", "excerpt", "file", "ord")
#: Image suffixes tried in this order.
IMAGE_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".eps", ".svg", ".gif", ".tiff")


def finding(rows: DataFrame, checker: str, severity: str | Column, line: str | Column, message: Column, order: list, suggestion: Column | None = None, excerpt: Column | None = None, file: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    text = lambda c: (none if c is None else c).cast("string")
    severity = F.lit(severity) if isinstance(severity, str) else severity
    ordinal = F.array(*[(F.col(o) if isinstance(o, str) else o if isinstance(o, Column) else F.lit(o)).cast("bigint") for o in order])
    line = F.col(line) if isinstance(line, str) else line
    return rows.select("doc_path", F.lit(checker).alias("checker"), severity.alias("severity"), line.cast("int").alias("line"), message.alias("message"), text(suggestion).alias("suggestion"), text(excerpt).alias("excerpt"), text(file).alias("file"), ordinal.alias("ord"))


def _holds(column: str, texts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(F.col(column), F.lit(x)) for x in texts], F.lit(False))


def _rule_matches(column: str, low: str, rules: tuple[Rule, ...]) -> Column:
    """Every match of every rule in a text column as an array, rule by rule; low is the text in lower case.

    Patterns are literals, so each is compiled once; a pattern only runs on texts that hold one of its guards.
    """
    found = []
    for rule in rules:
        guard = _holds(low, rule.guards) & _holds(low, rule.also) if rule.also else _holds(low, rule.guards)
        about = F.struct(F.lit(RULES.index(rule) if rule in RULES else len(RULES) + rules.index(rule)).alias("rule_idx"), *[F.lit(v).alias(n) for n, v in (("severity", rule.severity), ("category", rule.category), ("message", rule.message))])
        found.append(F.when(guard, F.struct(about.alias("rule"), t.pieces(F.col(column), rule.pattern).alias("parts"))))
    # The patterns are done with; one expression places the matches of all rules.
    some = F.filter(F.array(*found), lambda r: r["parts"].isNotNull())
    return F.flatten(F.transform(some, lambda r: F.transform(t.placed(r["parts"]), lambda m, i: _match(r["rule"], m, i))))


def scan_rules(rows: DataFrame, column: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_path, start_line, rule_idx, match_idx, severity, category, message, line, excerpt): every match of every rule in a text column."""
    low = rows.withColumn("low", F.lower(F.col(column)))
    return low.select("doc_path", "start_line", F.inline(_rule_matches(column, "low", rules)))


def _match(rule: Column, m: Column, i: Column) -> Column:
    return F.struct(rule["rule_idx"].alias("rule_idx"), i.alias("match_idx"), rule["severity"].alias("severity"), rule["category"].alias("category"), rule["message"].alias("message"), m["line"].alias("line"), t.strip(F.substring(m["text"], F.lit(1), F.lit(80))).alias("excerpt"))


def with_artifacts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with parsed_artifacts: the matches of all rules in the body and then in the preamble."""
    rows = docs.withColumn("a_source", F.coalesce("source", F.lit(""))).withColumn("a_offset", t.body_offset(F.col("a_source")))
    rows = rows.withColumn("a_body", t.body(F.col("a_source"), F.col("a_offset"))).withColumn("a_front", t.preamble(F.col("a_source")))
    rows = rows.withColumn("a_low", F.lower("a_body")).withColumn("a_front_low", F.lower("a_front")).withColumn("a_above", t.newlines(F.substring("a_source", F.lit(1), F.col("a_offset"))))
    placed = lambda matches, part, above: F.transform(matches, lambda m: F.struct(F.lit(part).alias("part"), *[m[c].alias(c) for c in ("rule_idx", "match_idx", "severity", "message", "excerpt")], (m["line"] + above).alias("line")))
    # let(): the lines above are counted once, not for each match.
    both = F.concat(t.let(F.col("a_above"), lambda above: placed(_rule_matches("a_body", "a_low", rules), 0, above)), placed(_rule_matches("a_front", "a_front_low", rules), 1, F.lit(0)))
    return rows.select(*docs.columns, both.alias("parsed_artifacts"))


def artifacts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Leftovers of machine-written text, in the body and then in the preamble; errors before warnings."""
    rows = docs if "parsed_artifacts" in docs.columns and rules is RULES else with_artifacts(docs, rules)
    rows = parse.exploded(rows, "parsed_artifacts", "at").select("doc_path", "x.*").withColumn("level", (F.col("severity") == "warning").cast("int"))
    advice = F.lit("Write this part yourself, or take it out before submission.")
    return finding(rows, "artifacts", F.col("severity"), "line", F.col("message"), ["part", "level", "rule_idx", "match_idx"], advice, F.col("excerpt"))


def missing_captions(floats: DataFrame) -> DataFrame:
    rows = floats.where(F.col("caption").isNull())
    return finding(rows, "figures", "error", "start_line", F.concat("env_type", F.lit(" is missing a \\caption{}")), ["float_idx", 0, 0], F.lit("Give this float a caption that says what it shows."))


def placeholder_captions(floats: DataFrame) -> DataFrame:
    rows = floats.where(F.col("caption").rlike(PLACEHOLDER_CAPTION))
    message = F.concat("env_type", F.lit(" has a placeholder caption: "), F.substring("caption", 1, 60))
    return finding(rows, "figures", "error", "start_line", message, ["float_idx", 1, 0], F.lit("Put a real caption here."), F.substring("caption", 1, 80))


def orphan_labels(floats: DataFrame, refs: DataFrame) -> DataFrame:
    rows = parse.labels(floats).join(growing(refs), ["doc_path", "label"], "left_anti")
    message = F.concat("env_type", F.lit(" label '"), "label", F.lit("' is not referenced by any \\ref{}"))
    return finding(rows, "figures", "warning", "line", message, ["float_idx", 2, "label_idx"], F.concat(F.lit("Refer to it with \\ref{"), "label", F.lit("}, or drop the label.")))


def near_empty_floats(floats: DataFrame) -> DataFrame:
    """Floats without an image, a table, a drawing or an input, and with fewer than two words outside commands."""
    content = F.col("content")
    # Fixed value: what counts as content.
    solid = content.rlike(r"\\includegraphics|\\begin\{(?:tabular|tabularx|tabulary|longtable|array|tikzpicture|pgfpicture|asy|pspicture)\}|(?U)(?:\\lstinputlisting|\\input|\\import)\s*\{")
    rest = t.strip(F.regexp_replace(content, t.COMMAND, ""))
    few = F.size(F.filter(F.split(rest, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")) < 2
    message = F.concat(F.lit("Near-empty "), "env_type", F.lit(" at line "), F.col("start_line").cast("string"), F.lit(": nothing of substance inside"))
    return finding(floats.where(~solid & few), "figures", "warning", "start_line", message, ["float_idx", 3, 0], F.lit("Add an image, a table or a diagram."))


def figures(docs: DataFrame) -> DataFrame:
    floats = parse.floats(docs)
    return missing_captions(floats).unionByName(placeholder_captions(floats)).unionByName(orphan_labels(floats, parse.refs(docs))).unionByName(near_empty_floats(floats))


def _clean_path(c: Column) -> Column:
    """Without single dots and steps up: the parts of a path are taken in turn, and a step up takes the name before it away."""
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        up = (part == "..") & ~F.coalesce(last.isin("", ".."), F.lit(True))
        return F.when(part == ".", kept).when(up, F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(c, "/"), none, step), "/")


def image_candidates(images: DataFrame) -> DataFrame:
    """(doc_path, img_idx, candidate): the path as it stands, and with each image suffix in place of its own or behind it."""
    folder = F.regexp_extract("doc_path", r"^(.*/)?[^/]*$", 1)
    path = _clean_path(F.when(F.startswith(F.col("raw_path"), F.lit("/")), F.col("raw_path")).otherwise(F.concat(folder, "raw_path")))
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    return images.select("doc_path", "img_idx", F.explode(F.concat(F.array(path), F.array(*[F.concat(stem, F.lit(s)) for s in IMAGE_SUFFIXES]))).alias("candidate"))


def images(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Images for which files(path) has no candidate."""
    wanted = parse.graphics(docs)
    there = image_candidates(wanted).join(files.select(F.col("path").alias("candidate")), "candidate", "left_semi").select("doc_path", "img_idx").distinct()
    rows = wanted.join(growing(there), ["doc_path", "img_idx"], "left_anti")
    advice = F.concat(F.lit("Add the file for \\includegraphics{"), "raw_path", F.lit("}, or drop the command."))
    return finding(rows, "images", "error", "line", F.concat(F.lit("Image file not found: '"), "raw_path", F.lit("'")), ["img_idx"], advice, F.substring("raw_path", 1, 80))


def bib_path(name: Column) -> Column:
    """Where a bibliography that doc_path names as name is."""
    folder = F.regexp_extract("doc_path", r"^(.*/)?[^/]*$", 1)
    return F.concat(folder, F.when(F.endswith(name, F.lit(".bib")), name).otherwise(F.concat(name, F.lit(".bib"))))


def missing_bib_files(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_path, res_idx, name, path, found): each bibliography a document names, and whether files(path) has it."""
    rows = parse.bib_resources(docs).withColumn("path", bib_path(F.col("name")))
    return rows.join(files.select("path", F.lit(True).alias("there")).distinct(), "path", "left").select("doc_path", "res_idx", "name", "path", F.coalesce("there", F.lit(False)).alias("found"))


def missing_citations(cites: DataFrame, entries: DataFrame) -> DataFrame:
    return _missing(cites.join(entries.select("doc_path", "key").distinct(), ["doc_path", "key"], "left_anti"))


def _missing(rows: DataFrame) -> DataFrame:
    message = F.concat(F.lit("Cited key '"), "key", F.lit("' not found in the bibliography."))
    return finding(rows, "citations", "error", "line", message, [0, "cite_idx", 0], excerpt=F.concat(F.lit("\\cite{"), "key", F.lit("}")))


def _ranked(entries: DataFrame) -> DataFrame:
    by_key = Window.partitionBy("doc_path", "key").orderBy("bib_idx")
    first = F.first(F.struct("file", "line", "bib_idx")).over(by_key)
    return entries.select("doc_path", "bib_idx", "key", "file", "line", F.row_number().over(by_key).alias("n"), first.alias("first"))


def unused_entries(cites: DataFrame, entries: DataFrame) -> DataFrame:
    return _unused(_ranked(entries).where("n = 1").join(cites.select("doc_path", "key").distinct(), ["doc_path", "key"], "left_anti"))


def _unused(rows: DataFrame) -> DataFrame:
    return finding(rows, "citations", "info", "line", F.concat(F.lit("Unused bibliography entry '"), "key", F.lit("'.")), [1, "bib_idx", 0], file=F.col("file"))


def duplicate_entries(entries: DataFrame) -> DataFrame:
    message = F.concat(F.lit("Duplicate bibliography key '"), "key", F.lit("' (first defined at "), "first.file", F.lit(":"), F.col("first.line").cast("string"), F.lit(")."))
    return finding(_ranked(entries).where("n > 1"), "citations", "warning", "line", message, [1, "first.bib_idx", "n"], file=F.col("file"))


#: Parts that the documents of one collection are dealt to where its rows meet them.
MEMBER_PARTS = 32


def for_members(rows: DataFrame, members: DataFrame, *kept: str) -> DataFrame:
    """Rows of collections as rows of their documents: doc_path is that of a collection before, and of each of its members(doc_path, collection) after. kept: columns of members that are added.

    A collection may be that of all documents, so its members are dealt to parts, and its rows, which are far fewer, go to each part that has members.
    """
    by = F.pmod(F.xxhash64("doc_path"), F.lit(MEMBER_PARTS)).cast("int")
    dealt = members.select(F.col("collection").alias("of"), by.alias("part"), F.col("doc_path").alias("member"), *kept)
    copied = rows.withColumnRenamed("doc_path", "of").join(growing(dealt.select("of", "part").distinct()), "of")
    return copied.join(growing(dealt), ["of", "part"]).withColumnRenamed("member", "doc_path").select(*rows.columns, *kept)


def shared_citations(docs: DataFrame, entries: DataFrame, members: DataFrame) -> DataFrame:
    """citations() where documents share collections of entries: doc_path of entries is a collection. Keys are ranked and looked for once per collection; rows per document are findings only.

    A member brings the keys that it cites along, so its entries, which are most of the findings, are not shuffled to be told apart.
    """
    cites = parse.citations(docs)
    keys = entries.select(F.col("doc_path").alias("collection"), "key").distinct()
    missing = cites.join(growing(members), "doc_path", "left").join(growing(keys), ["collection", "key"], "left_anti")
    cited = members.join(growing(cites.groupBy("doc_path").agg(F.collect_set("key").alias("cited"))), "doc_path", "left")
    unused = for_members(_ranked(entries).where("n = 1").select("doc_path", "bib_idx", "key", "file", "line"), cited, "cited").where(~F.array_contains(F.coalesce("cited", F.array().cast("array<string>")), F.col("key")))
    return _missing(missing).unionByName(_unused(unused)).unionByName(for_members(duplicate_entries(entries), members))


def citations(docs: DataFrame, entries: DataFrame) -> DataFrame:
    return citations_against(parse.citations(docs), entries)


def citations_against(cites: DataFrame, entries: DataFrame) -> DataFrame:
    return missing_citations(cites, entries).unionByName(unused_entries(cites, entries)).unionByName(duplicate_entries(entries))


#: Fixed value: what an arXiv identifier looks like.
ARXIV_ID = r"(?:\d{4}\.\d{4,5})(?:v\d+)?"


def verify_targets(entries: DataFrame) -> DataFrame:
    """(doc_path, bib_idx, key, target_kind, target_id): what to look an entry up by; an arXiv id before a DOI, neither: nulls."""
    arxiv, doi = t.filled(F.regexp_extract("eprint", ARXIV_ID, 0)), t.filled(t.strip(F.col("doi")))
    kind = F.when(arxiv.isNotNull(), "arxiv").when(doi.isNotNull(), "doi")
    return entries.select("doc_path", "bib_idx", "key", kind.alias("target_kind"), F.coalesce(arxiv, doi).alias("target_id"))


def references(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings for entries that verdicts(doc_path, key, exists, detail) say do not exist; every definition of such a key is reported."""
    rows = entries.join(growing(verdicts.where("not exists").select("doc_path", "key", "detail")), ["doc_path", "key"])
    eprint, doi = t.strip(F.col("eprint")) != "", t.strip(F.col("doi")) != ""
    name = F.concat(F.lit("Reference '"), "key", F.lit("'"))
    message = F.when(eprint, F.concat(name, F.lit(" has arXiv ID "), t.quoted(F.col("eprint")), F.lit(" but arXiv knows nothing of it: "), "detail")).when(doi, F.concat(name, F.lit(" has DOI "), t.quoted(F.col("doi")), F.lit(" but doi.org knows nothing of it: "), "detail")).otherwise(F.concat(name, F.lit(" cannot be verified: it has neither an arXiv ID nor a DOI.")))
    advice = F.when(eprint, "Check the arXiv ID by hand; the paper may not exist.").when(doi, "Check the DOI by hand; the paper may not exist.").otherwise("Add an eprint or doi field.")
    return finding(rows, "references", F.when(eprint | doi, "error").otherwise("info"), "line", message, ["bib_idx"], advice, file=F.col("file"))
