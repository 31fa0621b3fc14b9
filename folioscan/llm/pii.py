"""PII: personal data by pattern, and information-theoretic sanitisation of the terms that give it away.

Base spans are emails, IP addresses, payment cards and phone numbers. Each distinct value found is a protected entity.
The context of an occurrence of an entity are the words that stand whole in the CONTEXT characters before or after it, on
its line and not beyond the next match of its pattern. Corpus co-occurrence tells how much a term reveals an entity. All counts are
of occurrences of words in the rows as they are, copies included: n(term), n(term in contexts of the entity), n(words
in contexts of the entity), n(all words). With p(entity | term) = n(term in contexts) / (n(term) + PRIOR), where the
prior stands for occurrences not seen, and p(entity) the share of all words that stand in its contexts, a term whose
pointwise mutual information log p(entity | term) / p(entity) reaches DISCLOSURE of the entity's own information
-log p(entity) discloses it: a rare word beside a rare entity does, a common word or one beside an entity that stands
everywhere does not. Its places in contexts of that entity become spans of kind "term". sanitise() generalises base
spans to their kind and removes disclosing terms.

All of it is DataFrame and SQL functions. Scale: only rows with an entity are written out with their text; the words of
their contexts, a bounded number for each occurrence, carry the pair counts, so no pairs within a group are formed. How
often a term occurs at all is counted over every word of every document, with partial sums per task before the shuffle,
and only if there is an entity; a very common word is a row per task. Terms are joined by (entity, term), never gathered
per entity.

Cases. Null or empty text: no spans, empty strings. Null doc_id: a row like any other. Repeated rows: each is a row of
the result and counts. Long digit or letter runs and texts with very many matches take linear time: patterns are
possessive and start only where a match can, and places are running sums. Empty table: no rows. Extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import text as t
from folioscan.llm.common import written

#: Share of an entity's information that a term may give away.
DISCLOSURE = 0.9
#: Occurrences of a term, beside those seen, that are taken to stand elsewhere.
PRIOR = 1.0
#: Characters on either side of an entity.
CONTEXT = 100

# The patterns of each kind. A match starts at the end of the one before or where the character before
# does not belong to the leading run, which are the only places where a leftmost match can start.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    digits = F.reverse(_digits(s))
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    added = lambda i: F.when(i % 2 == 1, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda a, i: a + F.coalesce(added(i), F.lit(0))) % 10 == 0


def _holds(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(s)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
_FOUND = "array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>>"


def _base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind, each with the texts up to the matches of its pattern around it."""
    possible = {"email": F.contains(text, F.lit("@")), "ip": F.contains(text, F.lit(".")), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": F.contains(text, F.lit("+"))}

    # A line end stands for either end of the text.
    before = lambda gaps, i: F.when(i == 0, F.concat(F.lit("\n"), F.get(gaps, i))).otherwise(F.get(gaps, i))
    after = lambda gaps, m, i: F.when(i == F.size(gaps) - 2, F.concat(m["tail"], F.lit("\n"))).otherwise(m["tail"])

    def spans(rank: int, kind: str):
        span = lambda parts: lambda m, i: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["text"].alias("value"), before(parts["gaps"], i).alias("before"), after(parts["gaps"], m, i).alias("after"))
        return lambda parts: F.filter(F.transform(t.placed(parts), span(parts)), lambda m: _holds(kind, m["value"]))

    kinds = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        found = t.let(F.when(possible[kind], t.pieces(text, pattern)), spans(rank, kind)).cast(_FOUND)
        kinds.append(F.coalesce(found, F.array().cast(_FOUND)))
    return F.array_sort(F.concat(*kinds))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _found(docs: DataFrame, context: int, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """(row, id, text, n_words, spans, near), written: row numbers the rows, near holds the contexts. text is null for rows without spans, unless asked for."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text", F.regexp_count(_lower(F.col("text")), F.lit(TERM)).cast("long").alias("n_words"), _base_spans(F.col("text")).alias("found"))
    # What is left of a word at the end of a context is none.
    left = lambda s: F.substring_index(F.regexp_replace(_lower(F.right(s["before"], F.lit(context))), f"^{TERM}", ""), "\n", -1)
    right = lambda s: F.substring_index(F.regexp_replace(_lower(F.left(s["after"], F.lit(context))), f"{TERM}$", ""), "\n", 1)
    near = lambda s: F.struct(F.concat(s["kind"], F.lit(":"), _lower(s["value"])).alias("entity"), (s["start"] - F.length(left(s))).alias("at"), left(s).alias("left"), s["end"].alias("end"), right(s).alias("right"))
    plain = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")])
    kept = F.col("text") if with_text else F.lit(None).cast("string")
    return written(rows.select("row", "id", kept.alias("text"), "n_words", F.transform("found", plain).alias("spans"), F.transform("found", near).alias("near")))


def _context_words(found: DataFrame) -> DataFrame:
    """(row, entity, term, start, end): every word of every context with its place in the text."""
    contexts = found.select("row", F.explode("near").alias("c"))
    # A word that goes on into the entity is none of the context.
    left, right = F.regexp_replace("c.left", f"{TERM}$", ""), F.regexp_replace("c.right", f"^{TERM}", "")
    end = F.col("c.end") + F.length("c.right") - F.length(right)
    sides = contexts.select("row", "c.entity", F.explode(F.array(F.struct(F.col("c.at").alias("at"), left.alias("s")), F.struct(end.alias("at"), right.alias("s")))).alias("side"))
    words = sides.select("row", "entity", F.col("side.at").alias("at"), F.explode(t.occurrences(F.col("side.s"), TERM)).alias("w"))
    # A word between two occurrences of an entity stands in the contexts of both; it is one place.
    return words.select("row", "entity", F.col("w.text").alias("term"), (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end")).distinct()


def disclosing_terms(words: DataFrame, texts: DataFrame, n_words: int, disclosure: float = DISCLOSURE, prior: float = PRIOR) -> DataFrame:
    """(entity, term): the terms whose mutual information with the entity reaches disclosure times the entity's own information.

    words(entity, term): the places in contexts; texts(text): the corpus, of n_words words.
    """
    of_entity = words.groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = words.groupBy("entity", "term").agg(F.count("*").alias("n_both")).join(of_entity, "entity")
    everywhere = texts.select(F.explode(F.regexp_extract_all(_lower(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
    known = pairs.join(everywhere.groupBy("term").agg(F.count("*").alias("n_term")), "term")
    share = F.col("n_entity") / F.lit(float(max(1, n_words)))
    mutual = F.log(F.col("n_both") / (F.col("n_term") + F.lit(prior)) / share)
    return known.where((mutual >= F.lit(disclosure) * -F.log(share)) & (share < 1)).select("entity", "term")


def _free(spans: DataFrame) -> DataFrame:
    """The terms of spans(row, span) that no base span overlaps."""
    start, end, base = F.col("span.start"), F.col("span.end"), F.col("span.kind") != "term"
    earlier = Window.partitionBy("row").orderBy(start, F.col("span.rank")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row").orderBy(start.desc(), F.col("span.rank").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.select("row", "span", F.max(F.when(base, end)).over(earlier).alias("reached"), F.min(F.when(base, start)).over(later).alias("next"))
    return marked.where(~base & (F.coalesce("reached", F.lit(0)) <= start) & (F.coalesce("next", end) >= end)).select("row", "span")


def find_pii(docs: DataFrame, disclosure: float = DISCLOSURE, prior: float = PRIOR, context: int = CONTEXT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, spans), and text if asked for: for each row of docs its spans struct<start, rank, end, kind, value>, ordered; end exclusive, in code points."""
    found = _found(docs, context, id_col, text_col, with_text)
    result = ["id", *["text"] * with_text]
    n_words = found.agg(F.sum("n_words"), F.sum(F.size("spans"))).first()
    if not n_words[1]:
        return found.select(*result, "spans")
    words = written(_context_words(found.where(F.size("spans") > 0)))
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    flagged = words.join(disclosing_terms(words, texts, n_words[0], disclosure, prior), ["entity", "term"], "left_semi").select("row", "term", "start", "end").distinct()
    term = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit("term").alias("kind"), F.col("term").alias("value")).cast(_SPAN)
    base = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("span"))
    more = _free(base.unionByName(flagged.select("row", term.alias("span")))).groupBy("row").agg(F.collect_list("span").alias("more"))
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))))
    return found.join(more, "row", "left").select(*result, every.alias("spans"))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_spans), one row per row of docs. spans: kind:start:end, comma-joined."""
    found = find_pii(docs, **options)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _text_of(F.filter("spans", lambda s: s["kind"] != "term"))
    return found.select(F.col("id").alias("doc_id"), *[of(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), of("term"), F.size("spans").cast("long").alias("n_spans"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text): base spans become their kind in brackets, disclosing terms are removed. Of overlapping spans the first decides."""
    found = find_pii(docs, with_text=True, **options)
    shown = lambda s: F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), shown(s)).alias("out")))
    done = F.aggregate("spans", zero, step)
    rest = lambda d: F.concat(d["out"], F.substring(F.col("text"), d["at"] + 1, F.length("text")))
    return found.select(F.col("id").alias("doc_id"), t.let(done, rest).alias("text"))
