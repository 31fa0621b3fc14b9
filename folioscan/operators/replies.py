"""Checks that ask a language model: units to requests, replies to findings.

Requests are (request_id, system, user), replies (request_id, raw); a model stage is any function between the two, so a
table of stored replies serves as well. Filters stand below the stage, so nothing is asked that is not needed.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as t
from folioscan.operators import parse
from folioscan.operators.bib import last_by_key
from folioscan.operators.checks import finding
from folioscan.schemas import SEVERITIES
from folioscan.sources.tables import growing

Model = Callable[[DataFrame], DataFrame]

GRAMMAR = """You check the grammar and style of one paragraph of a scientific LaTeX paper. Name concrete mistakes of grammar,
spelling, punctuation or style; take LaTeX commands as they are, and leave content, structure and citations alone.
Answer with JSON: {"issues": [{"excerpt": "words copied from the paragraph", "message": "what is wrong", "suggestion": "better words", "severity": "info" or "warning" or "error"}]}; with nothing to report {"issues": []}."""
REVIEW = """You review one section of a scientific paper. Raise only points of substance about motivation, clarity, argumentation,
methodology, evaluation or structure, each short and something the author can act on; leave language and formatting alone.
Answer with JSON: {"comments": [{"category": "one of the six", "severity": "info" or "warning" or "error", "message": "the point", "suggestion": "optional"}]}; with nothing to raise {"comments": []}."""
EXTRACT = """You list the claims that a paragraph of a scientific paper attributes to citations. A claim without a citation does not count.
Answer with JSON: {"claims": [{"claim": "the claim in plain English", "cite_keys": ["keys it is attributed to"]}]}; without any {"claims": []}."""
JUDGE = """You judge whether an abstract backs a claim. Verdicts: "supports", "contradicts", "unrelated" (another topic), "unclear" (too little to say).
Answer with JSON: {"verdict": "one of the four", "rationale": "one sentence"}."""
#: Fixed value: characters of a section that are sent at most.
SECTION_CHARS = 12_000
CUT_NOTE = "\n\n[... section cut for length ...]"


def json_part(c: Column) -> Column:
    """The JSON inside a reply: the content of a fence around all of it, else from the first to the last brace, else all."""
    fence = r"(?sU)\A\s*```(?:json)?\s*(.*?)\s*```\s*\z"
    first, last = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    inner = F.when((first > 0) & (F.instr(c, "}") > 0) & (first < last), F.substring(c, first, last - first + 1)).otherwise(c)
    return F.when(c.rlike(fence), F.regexp_extract(c, fence, 1)).otherwise(inner)


def decoded(c: Column) -> Column:
    """A reply as a variant; if it is no JSON, once more with every backslash doubled; else null."""
    part = json_part(c)
    return F.coalesce(F.try_parse_json(part), F.try_parse_json(F.replace(part, F.lit("\\"), F.lit("\\\\"))))


def _items(reply: Column, field: str) -> Column:
    return F.coalesce(F.try_variant_get(reply, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))


def _text(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "string")


def _severity(v: Column, other: str) -> Column:
    found = _text(v, "severity")
    return F.when(found.isin(*SEVERITIES), found).otherwise(F.lit(other))


def answered(units: DataFrame, replies: DataFrame, asked: Column | None = None) -> DataFrame:
    """Units with their reply, by request_id. The query fails if a unit that was asked (all, unless said otherwise) has no reply or more than one; a reply without content (raw null) is one."""
    given = replies.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_replies"), F.first("raw").alias("raw"))
    none = F.raise_error(F.concat(F.lit("no reply to request "), "request_id"))
    several = F.raise_error(F.concat("n_replies", F.lit(" replies to request "), "request_id"))
    missing = F.col("n_replies").isNull() & (F.lit(True) if asked is None else asked)
    reply = F.when(missing, none).when(F.col("n_replies") > 1, several).otherwise(decoded(F.col("raw")))
    return units.join(growing(given), "request_id", "left").withColumn("reply", reply).drop("n_replies", "raw")


def unanswered(requests: DataFrame, replies: DataFrame) -> DataFrame:
    return requests.join(replies, "request_id", "left_anti")


def _request_id(kind: str, *columns: str) -> Column:
    return F.concat_ws("#", F.lit(kind), *[F.col(c).cast("string") for c in columns])


def grammar_units(paras: DataFrame) -> DataFrame:
    rows = parse.prose_paragraphs(paras)
    return rows.withColumn("request_id", _request_id("grammar", "doc_path", "para_idx"))


def grammar_requests(units: DataFrame) -> DataFrame:
    return units.select("request_id", F.lit(GRAMMAR).alias("system"), F.col("text").alias("user"))


def grammar_findings(units: DataFrame, replies: DataFrame) -> DataFrame:
    """An issue's line is that of its excerpt within the paragraph; the paragraph's first line if it is not there."""
    rows = answered(units, replies).select("doc_path", "para_idx", "text", "start_line", "file", F.posexplode(_items(F.col("reply"), "issues")).alias("issue", "v"))
    rows = rows.withColumn("excerpt", t.strip(F.coalesce(_text(F.col("v"), "excerpt"), F.lit(""))))
    at = F.when(F.col("excerpt") != "", F.instr(F.col("text"), F.col("excerpt"))).otherwise(0)
    line = F.col("start_line") + F.when(at > 0, t.newlines(F.substring("text", F.lit(1), at - 1))).otherwise(0)
    message = t.strip(F.coalesce(_text(F.col("v"), "message"), F.lit("")))
    return finding(rows, "grammar", _severity(F.col("v"), "warning"), line, message, ["para_idx", "issue"], t.filled(_text(F.col("v"), "suggestion")), t.filled(F.col("excerpt")), F.col("file"))


def review_units(sections: DataFrame) -> DataFrame:
    return sections.where(t.strip(F.col("text")) != "").withColumn("request_id", _request_id("review", "doc_path", "sec_idx"))


def review_prompt(title: Column, text: Column, chars: int = SECTION_CHARS) -> Column:
    cut = F.when(F.length(text) > chars, F.concat(F.substring(text, F.lit(1), F.lit(chars)), F.lit(CUT_NOTE))).otherwise(text)
    return F.when(title != "", F.concat(F.lit("Section title: "), title, F.lit("\n\n"), cut)).otherwise(cut)


def review_requests(units: DataFrame, chars: int = SECTION_CHARS) -> DataFrame:
    return units.select("request_id", F.lit(REVIEW).alias("system"), review_prompt(F.col("title"), F.col("text"), chars).alias("user"))


def review_findings(units: DataFrame, replies: DataFrame) -> DataFrame:
    rows = answered(units, replies).select("doc_path", "sec_idx", "start_line", "file", F.posexplode(_items(F.col("reply"), "comments")).alias("comment", "v"))
    category, said = (t.strip(F.coalesce(_text(F.col("v"), k), F.lit(""))) for k in ("category", "message"))
    message = F.concat(F.when(category != "", F.concat(F.lit("["), category, F.lit("] "))).otherwise(F.lit("")), said)
    return finding(rows, "reviewer", _severity(F.col("v"), "info"), "start_line", message, ["sec_idx", "comment"], t.filled(_text(F.col("v"), "suggestion")), file=F.col("file"))


def claim_units(paras: DataFrame) -> DataFrame:
    rows = paras.withColumn("keys", parse.cite_keys(F.col("text"))).where(F.size("keys") > 0)
    return rows.withColumn("request_id", _request_id("extract", "doc_path", "para_idx"))


def claim_requests(units: DataFrame) -> DataFrame:
    keys = F.array_join(F.array_sort(F.array_distinct("keys")), ", ")
    return units.select("request_id", F.lit(EXTRACT).alias("system"), F.concat(F.lit("Cite keys present: "), keys, F.lit("\n\nParagraph:\n"), F.col("text")).alias("user"))


def claims(units: DataFrame, replies: DataFrame) -> DataFrame:
    """(doc_path, para_idx, claim_idx, key_idx, claim, key, start_line, file): one row for each key a claim is attributed to."""
    rows = answered(units, replies).select("doc_path", "para_idx", "start_line", "file", F.posexplode(_items(F.col("reply"), "claims")).alias("claim_idx", "v"))
    rows = rows.withColumn("claim", _text(F.col("v"), "claim")).where(F.coalesce("claim", F.lit("")) != "")
    keys = F.coalesce(F.try_variant_get(F.col("v"), "$.cite_keys", "array<string>"), F.array().cast("array<string>"))
    keys = F.filter(F.transform(keys, lambda k: t.strip(F.coalesce(k, F.lit("None")))), lambda k: k != "")
    return rows.select("doc_path", "para_idx", "claim_idx", "start_line", "file", t.strip(F.col("claim")).alias("claim"), F.posexplode(keys).alias("key_idx", "key"))


def claim_titles(found: DataFrame, entries: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Claims with the title of their key's last definition: title null for an unknown key. members: see checks.for_members()."""
    last = last_by_key(entries).select("doc_path", "key", "title")
    if members is None:
        return found.join(growing(last), ["doc_path", "key"], "left")
    return found.join(growing(members), "doc_path", "left").join(growing(last.withColumnRenamed("doc_path", "collection")), ["collection", "key"], "left").drop("collection")


def paper_questions(titled: DataFrame) -> DataFrame:
    return titled.where("title <> ''").select(F.col("title").alias("query")).distinct()


def judge_units(titled: DataFrame, papers: DataFrame) -> DataFrame:
    """Claims with the paper found for their title, and the state they are in: unknown, untitled, unfound, empty or ready."""
    found = papers.select(F.col("query").alias("title"), F.col("title").alias("paper_title"), "abstract", F.lit(True).alias("hit"))
    rows = titled.join(found, "title", "left")
    state = F.when(F.col("title").isNull(), "unknown").when(F.col("title") == "", "untitled").when(F.col("hit").isNull(), "unfound").when(F.coalesce("abstract", F.lit("")) == "", "empty").otherwise("ready")
    return rows.withColumn("state", state).withColumn("request_id", _request_id("judge", "doc_path", "para_idx", "claim_idx", "key_idx"))


def judge_requests(units: DataFrame) -> DataFrame:
    user = F.concat(F.lit("Claim: "), "claim", F.lit("\n\nCited paper title: "), "paper_title", F.lit("\n\nAbstract: "), "abstract")
    return units.where("state = 'ready'").select("request_id", F.lit(JUDGE).alias("system"), user.alias("user"))


def claim_findings(units: DataFrame, replies: DataFrame) -> DataFrame:
    """Claims that cannot be judged, and those that are not supported. A reply without a verdict counts as unclear."""
    rows = answered(units, replies, F.col("state") == "ready")
    verdict = F.lower(t.strip(F.coalesce(_text(F.col("reply"), "verdict"), F.lit("unclear"))))
    why = t.strip(F.coalesce(_text(F.col("reply"), "rationale"), F.lit("")))
    rows = rows.where((F.col("state") != "ready") | (verdict != "supports"))
    message = (
        F.when(F.col("state") == "unknown", F.concat(F.lit("Unknown cite key '"), "key", F.lit("' in claim: "), "claim"))
        .when(F.col("state") == "untitled", F.concat(F.lit("No title in bib for '"), "key", F.lit("', so the claim cannot be checked: "), "claim"))
        .when(F.col("state") == "unfound", F.concat(F.lit("Could not retrieve abstract for '"), "key", F.lit("' ("), t.quoted(F.col("title")), F.lit("); claim not checked.")))
        .when(F.col("state") == "empty", F.concat(F.lit("The record found for '"), "key", F.lit("' has no abstract; claim not checked.")))
        .otherwise(F.concat(F.lit("["), verdict, F.lit("] claim '"), "claim", F.lit("' vs "), "key", F.lit(": "), why))
    )
    severity = F.when(F.col("state") != "ready", "info").when(verdict == "contradicts", "error").otherwise("warning")
    return finding(rows, "claims", severity, "start_line", message, ["para_idx", "claim_idx", "key_idx"], file=F.col("file"))


def server_model(base_url: str | None = None, model: str | None = None, concurrency: int = 1, wait: float = 1200.0, temperature: float = 0.2) -> Model:
    """A model stage that calls a chat server; no retries, and a failing call answers null. Write the replies before using them twice."""
    url = (base_url or os.environ.get("FOLIOSCAN_BASE_URL", "http://localhost:8080/v1")).rstrip("/") + "/chat/completions"
    model = model or os.environ.get("FOLIOSCAN_MODEL", "local-model")

    def ask(system: str, user: str) -> str | None:
        body = {"model": model, "temperature": temperature, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": "Bearer none"})
        try:
            with urllib.request.urlopen(request, timeout=wait) as r:
                return json.loads(r.read())["choices"][0]["message"]["content"] or "{}"
        except Exception:
            return None

    return python_model(ask, concurrency)


def python_model(ask: Callable[[str, str], str | None], concurrency: int = 1) -> Model:
    """A model stage from a function of (system, user); concurrency is the number of partitions that call it at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"request_id": batch["request_id"], "raw": [ask(s, u) for s, u in zip(batch["system"], batch["user"])]})

    return lambda requests: requests.repartition(max(1, concurrency)).mapInPandas(run, "request_id string, raw string")
