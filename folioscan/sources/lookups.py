"""Lookups behind table-shaped stages.

A lookup is a function from a DataFrame of distinct questions to a DataFrame of answers, so a test or a batch job can put
a table in its place. The live ones ask services through asking.asked(): a task for each service and range of questions, at the
pace the services ask for over all, with answers that are committed as they come.
"""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import text as t
from folioscan.sources.asking import Service, asked
from folioscan.sources.files import is_file

Lookup = Callable[[DataFrame], DataFrame]

# Addresses, paces and limits of the services.
SEARCH = "https://api.semanticscholar.org/graph/v1/paper/search?query={}&limit=3&fields=title,authors,year,abstract,externalIds,url"
ARXIV = "https://export.arxiv.org/api/query?id_list={}"
DOI = "https://doi.org/{}"
SEARCH_PAUSE, ARXIV_PAUSE = 1.0, 3.1
SEARCH_WAIT, ARXIV_WAIT, DOI_WAIT = 15.0, 15.0, 10.0
HITS = 3



def from_table(table: DataFrame) -> Lookup:
    """A lookup that answers from a table, whatever is asked; the asker joins."""
    return lambda questions: table


def kept(lookup: Lookup, folder: str, keys: tuple[str, ...] = ("target_kind", "target_id")) -> Lookup:
    """A lookup that keeps its answers as Parquet in a shared folder and asks only what is not among them, so that lost tasks and later runs cost no answer twice.

    For searches keys is ("query",); what has no hits is asked again.
    """

    def run(questions: DataFrame) -> DataFrame:
        spark = questions.sparkSession
        new = questions.select(*keys).distinct()
        if is_file(spark, f"{folder}/_SUCCESS"):
            new = new.join(spark.read.parquet(folder), list(keys), "left_anti")
        lookup(new).write.mode("append").parquet(folder)
        return spark.read.parquet(folder)

    return run


def _open(url: str, wait: float):
    return urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "folioscan"}), timeout=wait)


def hits_of(reply: dict) -> list[dict]:
    """The raw hits in a reply of the search service, as texts."""
    text = lambda v: None if v is None else str(v)
    out = []
    for rank, h in enumerate((reply.get("data") or [])[:HITS]):
        ids = h.get("externalIds") or {}
        authors = [a["name"] for a in h.get("authors") or [] if a.get("name")]
        out.append({"rank": rank, "authors": authors, **{k: text(h.get(k)) for k in ("title", "year", "abstract", "url")}, "arxiv": ids.get("ArXiv"), "doi": ids.get("DOI")})
    return out


def _search(title: str) -> list[dict]:
    with _open(SEARCH.format(urllib.parse.quote(title)), SEARCH_WAIT) as r:
        return hits_of(json.loads(r.read().decode()))


def searching(name: str, service: Service, folder: str | None = None) -> Lookup:
    """Raw hits (query, rank, ...) for titles(query) from a service that answers with a list of them; a failing call gives none."""

    def run(titles: DataFrame) -> DataFrame:
        answers = asked(titles.select(F.lit(name).alias("service"), F.col("query").alias("key")), {name: service}, folder)
        hits = F.from_json("answer", "array<struct<rank:int,title:string,authors:array<string>,year:string,abstract:string,url:string,arxiv:string,doi:string>>")
        return answers.select(F.col("key").alias("query"), F.inline(hits))

    return run


def best_hits(hits: DataFrame) -> DataFrame:
    """(query, title, authors, year, abstract, url), at most one row per query: of the first hits one whose title is the query, in any case, else the first; none if its title is empty."""
    same = F.lower(t.strip(F.coalesce("title", F.lit("")))) == F.lower(t.strip(F.col("query")))
    order = Window.partitionBy("query").orderBy(F.desc(same), "rank")
    rows = hits.where(F.col("rank") < HITS).withColumn("n", F.row_number().over(order)).where("n = 1")
    url = F.coalesce(t.filled(F.col("url")), t.filled(F.col("arxiv")), t.filled(F.col("doi")))
    rows = rows.select("query", t.strip(F.col("title")).alias("title"), F.filter("authors", lambda a: a != "").alias("authors"), F.expr("try_cast(trim(year) AS int)").alias("year"), t.strip(F.coalesce("abstract", F.lit(""))).alias("abstract"), url.alias("url"))
    return rows.where(F.coalesce("title", F.lit("")) != "")


def scholar_result(raw: dict) -> tuple[str, list[str], int | None, str, str | None]:
    """(title, authors, year, abstract, url) of a publication record of the scraping backend."""
    bib = raw.get("bib") or {}
    text = lambda v: "" if v is None else str(v).strip()
    authors = bib.get("author")
    authors = [] if authors is None else authors if isinstance(authors, list) else str(authors).split(" and ")
    year = re.fullmatch(r"\s*[+-]?\d+\s*", text(bib.get("pub_year")))
    return text(bib.get("title")), [text(a) for a in authors if text(a)], int(year[0]) if year else None, text(bib.get("abstract")), raw.get("pub_url") or raw.get("eprint_url")


def _scholar(query: str) -> list[dict]:
    """The first hit of the scraping backend; needs the optional package scholarly."""
    from scholarly import scholarly

    first = next(iter(scholarly.search_pubs(query)), None)
    if first is None:
        return []
    title, authors, year, abstract, url = scholar_result(first)
    return [{"rank": 0, "title": title, "authors": authors, "year": None if year is None else str(year), "abstract": abstract, "url": url, "arxiv": None, "doi": None}]


paper_search = searching("semantic-scholar", Service(_search, SEARCH_PAUSE))
scholar_search = searching("google-scholar", Service(_scholar))
BACKENDS: dict[str, Lookup] = {"semantic-scholar": paper_search, "google-scholar": scholar_search}


def backend(name: str) -> Lookup:
    if name not in BACKENDS:
        raise ValueError(f"unknown retrieval backend {name!r}; there are {sorted(BACKENDS)}")
    return BACKENDS[name]


def arxiv_answer(body: str) -> tuple[bool, str]:
    """(whether there is an entry, its title or why not) from a reply of the arXiv service."""
    import xml.etree.ElementTree as ET

    space = "{http://www.w3.org/2005/Atom}"
    entry = ET.fromstring(body).find(f"{space}entry")
    if entry is None:
        return False, "arXiv returned no entry"
    title = entry.find(f"{space}title")
    return True, "(no title)" if title is None or title.text is None else title.text.strip()


def _arxiv(x: str) -> tuple[bool, str]:
    with _open(ARXIV.format(x), ARXIV_WAIT) as r:
        return arxiv_answer(r.read().decode())


def _doi(x: str) -> tuple[bool, str]:
    with _open(DOI.format(x), DOI_WAIT) as r:
        return True, r.url


def verifying(services: dict[str, Service], folder: str | None = None) -> Lookup:
    """(target_kind, target_id, exists, detail) for targets, from services by kind that answer (exists, detail); a failing call counts as not existing."""

    def run(targets: DataFrame) -> DataFrame:
        answers = asked(targets.select(F.col("target_kind").alias("service"), F.col("target_id").alias("key")), services, folder)
        pair = F.from_json("answer", "array<string>")
        exists = F.coalesce(F.get(pair, F.lit(0)) == "true", F.lit(False))
        return answers.select(F.col("service").alias("target_kind"), F.col("key").alias("target_id"), exists.alias("exists"), F.coalesce(F.get(pair, F.lit(1)), "error").alias("detail"))

    return run


verify = verifying({"arxiv": Service(_arxiv, ARXIV_PAUSE), "doi": Service(_doi)})


def verdicts(targets: DataFrame, lookup: Lookup = verify) -> DataFrame:
    """(doc_path, key, exists, detail): the first definition of a key decides what is looked up, once per distinct target."""
    order = Window.partitionBy("doc_path", "key").orderBy("bib_idx")
    first = targets.withColumn("n", F.row_number().over(order)).where("n = 1 AND target_id IS NOT NULL")
    return first.join(lookup(first), ["target_kind", "target_id"]).select("doc_path", "key", "exists", "detail")


def papers(titles: DataFrame, search: Lookup | str = "semantic-scholar") -> DataFrame:
    """The best paper for each of titles(query)."""
    return best_hits((backend(search) if isinstance(search, str) else search)(titles))


def paper_card(rows: DataFrame) -> DataFrame:
    """(query, line_no, text): a paper as lines of text, with a word in place of what is not known."""
    known = lambda c, other: F.coalesce(t.filled(c.cast("string")), F.lit(other))
    shown = [("title", F.col("title")), ("authors", known(F.array_join("authors", ", "), "(unknown)")), ("year", known(F.col("year"), "(unknown)")), ("url", known(F.col("url"), "(none)")), ("abstract", known(F.col("abstract"), "(no abstract)"))]
    lines = F.array(*[F.concat(F.lit(f"{name}: "), value) for name, value in shown])
    return rows.select("query", F.posexplode(lines).alias("line_no", "text"))
