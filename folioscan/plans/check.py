"""A whole check: from documents and what surrounds them to one table of findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import bib, checks, parse, replies, report
from folioscan.sources import files as f
from folioscan.sources import lookups
from folioscan.sources.tables import growing, written


@dataclass
class Corpus:
    """docs(doc_path, source; line_runs, where sources are expanded), bibliography entries, and a listing files(path).

    Without members, doc_path of an entry is its document. With members(doc_path, collection) it is the collection that documents share.
    """

    docs: DataFrame
    entries: DataFrame
    files: DataFrame
    members: DataFrame | None = None

    def own_entries(self) -> DataFrame:
        """The entries of each document: a row for each document that shares them."""
        return self.entries if self.members is None else checks.for_members(self.entries, self.members)


#: A check of one's own: a function from a corpus to findings with the columns checks.FINDING.
Checker = Callable[[Corpus], DataFrame]


def parse_once(docs: DataFrame) -> DataFrame:
    """docs with all that the checks look for in a source, found in one pass and written, so that each check reads just its own columns."""
    return docs if "parsed_artifacts" in docs.columns else written(checks.with_artifacts(parse.parsed(docs)))


def load(spark: SparkSession, folder: str, roots: DataFrame | None = None, bib_paths: list[str] | None = None) -> Corpus:
    """Reads the sources below a folder, puts included files in place, and finds each document's bibliography.

    Without roots(doc_path) every file with a document mark is one. Bibliographies are those given, else those a document
    names, else the ones inside its sources.
    """
    sources = f.read_texts(spark, folder + "/**")
    listing = f.list_files(spark, folder)
    roots = sources.where("instr(source, '\\\\begin{document}') > 0").selectExpr("path AS doc_path") if roots is None else roots
    docs = parse_once(f.joined_sources(f.expand_includes(sources, roots), roots))
    bibs = bib.bib_file_entries(f.read_texts(spark, bib_paths or folder + "/**", ".bib"))
    if bib_paths:
        members = docs.select("doc_path", F.lit("given").alias("collection"))  # every document is checked against all the files given
        entries = bibs.withColumn("doc_path", F.lit("given"))
    else:
        entries, members = shared(docs, listing, bibs)
        return Corpus(docs, entries, listing, members)
    entries, members = _with_own(docs, entries, members)
    return Corpus(docs, entries, listing, members)


def shared(docs: DataFrame, listing: DataFrame, bibs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, members) of documents that name files of the listing, from the entries bibs(file, bib_idx, ...) of these files: those that name the same files in the same order share a collection."""
    named = checks.missing_bib_files(docs, listing).where("found").groupBy("doc_path").agg(F.array_sort(F.collect_list(F.struct("res_idx", "path"))).alias("named"))
    named = written(named.withColumn("collection", F.array_join(F.transform("named", lambda n: F.concat(n["res_idx"].cast("string"), F.lit(":"), n["path"])), "|")))
    of_files = named.dropDuplicates(["collection"]).select("collection", F.inline("named"))
    entries = of_files.withColumnRenamed("path", "file").join(bibs, "file").withColumn("bib_idx", F.col("res_idx").cast("bigint") * 10**12 + F.col("bib_idx")).withColumnRenamed("collection", "doc_path")
    return _with_own(docs, entries, named.select("doc_path", "collection"))


def _with_own(docs: DataFrame, entries: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and members with the entries inside those documents whose collection has none, as a collection of their own."""
    columns = ["doc_path", "bib_idx", "key", "entry_type", "file", "line", "title", "author", "eprint", "doi"]
    entries = written(entries.select(columns))
    members = members.join(entries.select(F.col("doc_path").alias("collection")).distinct(), "collection", "left_semi").select("doc_path", "collection")
    inline = parse.inline_bibitems(docs).select(columns).join(growing(members), "doc_path", "left_anti")
    own = inline.select("doc_path", F.concat(F.lit("own|"), "doc_path").alias("collection")).distinct()
    inline = inline.withColumn("doc_path", F.concat(F.lit("own|"), "doc_path"))
    return written(entries.unionByName(inline)), written(members.unionByName(own))


def check(corpus: Corpus, model: replies.Model | None = None, verify: lookups.Lookup | None = None, search: lookups.Lookup | str = "semantic-scholar", skip_grammar: bool = False, skip_reviewer: bool = False, enable_claims: bool = False, extra: Sequence[Checker] = ()) -> DataFrame:
    """The findings of all documents. Without a model no language model is asked, without verify no reference is looked up. extra adds checks of one's own."""
    docs, entries, members = parse_once(corpus.docs), corpus.entries, corpus.members
    cited = checks.citations(docs, entries) if members is None else checks.shared_citations(docs, entries, members)
    parts = [checks.artifacts(docs), checks.figures(docs), checks.images(docs, corpus.files), cited]
    if verify is not None:
        unknown = checks.references(entries, lookups.verdicts(checks.verify_targets(entries), verify))
        parts.append(unknown if members is None else checks.for_members(unknown, members))
    if model is not None:
        paras = parse.paragraphs(docs)
        if not skip_grammar:
            units = replies.grammar_units(paras)
            parts.append(replies.grammar_findings(units, model(replies.grammar_requests(units))))
        if not skip_reviewer:
            units = replies.review_units(parse.sections(docs))
            parts.append(replies.review_findings(units, model(replies.review_requests(units))))
        if enable_claims:
            units = replies.claim_units(paras)
            # Written: what the model has answered is read for the search, for the judge and for the findings.
            titled = written(replies.claim_titles(replies.claims(units, model(replies.claim_requests(units))), entries, members))
            units = written(replies.judge_units(titled, lookups.papers(replies.paper_questions(titled), search)))
            parts.append(replies.claim_findings(units, model(replies.judge_requests(units))))
    parts += [own(corpus) for own in extra]
    return report.numbered(reduce(DataFrame.unionByName, parts))
