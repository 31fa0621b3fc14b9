"""LaTeX sources into relations. All of it happens within a row: no shuffle, and the scan reads two columns.

parsed() adds what is found in a source as columns of arrays, one for each kind. Each relation explodes one of them: of docs
that have been parsed (once, for all checks), or else of just what it needs itself.

Inputs have (doc_path, source). Where they also have line_runs, the line map that files.joined_sources() makes of expanded
includes, line numbers of paragraphs, sections and bibliography blocks are those of the files they came from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as t

# What counts as a command of each kind.
CITE = r"\\(?:no|paren|text|auto|foot)?cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]+)\}"
BIBLIOGRAPHY = r"\\bibliography\{([^}]+)\}"
BIB_RESOURCE = r"\\addbibresource\{([^}]+)\}"
SECTION = r"(?U)\\section\*?\s*\{([^}]*)\}"
FLOAT = r"(?sU)\\begin\{(figure|table)(?:\*)?\}\s+(.*?)\s+\\end\{\1(?:\*)?\}"
CAPTION = r"(?sU)\\caption\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}"
LABEL = r"(?sU)\\label\s*\{([^}]*)\}"
REF = r"(?sU)\\ref\s*\{([^}]*)\}"
GRAPHICS = r"(?U)\\includegraphics(?:\s*\[[^\]]*\])?\s*\{([^}]+)\}"
BIB_BLOCK = r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}"
BIB_ITEM = r"(?U)\\bibitem\s*(?:\[[^\]]*\])?\s*\{([^}]+)\}"


def _source(docs: DataFrame) -> DataFrame:
    return docs.select("doc_path", F.coalesce("source", F.lit("")).alias("source"))


def with_body(docs: DataFrame) -> DataFrame:
    """(doc_path, body, start_line): the text between the document marks, and the line it starts at."""
    at = _source(docs).withColumn("offset", t.body_offset(F.col("source")))
    return at.select("doc_path", t.body(F.col("source"), F.col("offset")).alias("body"), (t.newlines(F.substring("source", F.lit(1), F.col("offset"))) + 1).alias("start_line"))


def with_preamble(docs: DataFrame) -> DataFrame:
    return _source(docs).select("doc_path", t.preamble(F.col("source")).alias("preamble"))


def source_lines(docs: DataFrame) -> DataFrame:
    """The line map of sources that include nothing."""
    rows = _source(docs).select("doc_path", F.posexplode(t.lines(F.col("source"))).alias("at", "text"))
    return rows.select("doc_path", (F.col("at") + 1).alias("combined_line"), "text", F.col("doc_path").alias("origin_file"), (F.col("at") + 1).alias("origin_line"))


def _run_of(runs: Column, line: Column) -> Column:
    """The run that a line stands in, by binary search over the starts of the runs; null outside of all."""
    rounds = F.ceil(F.log2(F.size(runs) + 1)).cast("int")
    low = F.aggregate(F.sequence(F.lit(0), rounds), F.struct(F.lit(0).alias("low"), F.size(runs).alias("high")), lambda b, _: _halved(runs, b, line))["low"]
    return t.let(F.get(runs, low), lambda r: F.when((r["start"] <= line) & (line < r["start"] + r["length"]), r))


def _halved(runs: Column, bounds: Column, line: Column) -> Column:
    mid = F.floor((bounds["low"] + bounds["high"]) / 2).cast("int")
    right = F.get(runs, mid)["start"] <= line
    halves = F.when(right, F.struct(mid.alias("low"), bounds["high"].alias("high"))).otherwise(F.struct(bounds["low"].alias("low"), mid.alias("high")))
    return F.when(bounds["high"] - bounds["low"] <= 1, bounds).otherwise(halves)


def _moved(docs: DataFrame, array: str, *lines: str) -> DataFrame:
    """docs whose array has its line fields moved to the files they came from, and a field file: that of the first line. Lines outside the map stay as they are.

    The line map is the column line_runs of docs, so this happens within the row; without it all lines are the document's own.
    """
    fields = [x.name for x in docs.schema[array].dataType.elementType.fields]
    if "line_runs" not in docs.columns:
        return docs.withColumn(array, F.transform(array, lambda x: F.struct(*[x[f].alias(f) for f in fields], F.col("doc_path").alias("file"))))

    def moved(x: Column, all_runs: Column) -> Column:
        def to(runs: Column) -> Column:
            run_of = {line: F.get(runs, i) for i, line in enumerate(lines)}
            place = lambda f: F.coalesce(run_of[f]["origin"] + x[f] - run_of[f]["start"], x[f])
            return F.struct(*[(place(f) if f in lines else x[f]).alias(f) for f in fields], F.coalesce(run_of[lines[0]]["file"], F.col("doc_path")).alias("file"))

        return t.let(F.array(*[_run_of(all_runs, x[f]) for f in lines]), to)

    return docs.withColumn(array, t.let(F.col("line_runs"), lambda runs: F.transform(array, lambda x: moved(x, runs))))


def exploded(rows: DataFrame, array: str, at: str) -> DataFrame:
    """(doc_path, at, x) of the elements of an array. Outer, and then without the empty ones: else the optimiser filters by the array's size further down, where it would compute it a second time."""
    return rows.select("doc_path", F.posexplode_outer(array).alias(at, "x")).where(F.col(at).isNotNull())


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_path, para_idx, text, start_line, end_line, file): runs of lines that are not blank once comments are gone."""
    rows = _moved(parsed(docs, "paragraphs"), "parsed_paragraphs", "start_line", "end_line")
    return exploded(rows, "parsed_paragraphs", "para_idx").select("doc_path", "para_idx", "x.*")


def prose_paragraphs(paras: DataFrame, least: int = 3) -> DataFrame:
    return paras.where(t.has_prose(F.col("text"), least))


def sections(docs: DataFrame) -> DataFrame:
    """(doc_path, sec_idx, title, text, start_line, end_line, file): from one section command to the next; without any, the whole body."""
    rows = _moved(parsed(docs, "sections"), "parsed_sections", "start_line", "end_line")
    return exploded(rows, "parsed_sections", "sec_idx").select("doc_path", "sec_idx", "x.*")


def _keys(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), t.strip), lambda k: k != "")


def citations(docs: DataFrame) -> DataFrame:
    """(doc_path, cite_idx, key, line): every cited key outside comments; all keys of a command have its line."""
    return exploded(parsed(docs, "citations"), "parsed_citations", "cite_idx").select("doc_path", "cite_idx", "x.*")


def cite_keys(c: Column) -> Column:
    """The cited keys of a text as an array."""
    found = F.flatten(F.transform(F.regexp_extract_all(t.strip_comments(c), F.lit(CITE), F.lit(1)), _keys))
    return F.when(F.contains(c, F.lit("cite")), found).otherwise(F.when(c.isNotNull(), F.array().cast("array<string>")))


def bib_resources(docs: DataFrame) -> DataFrame:
    """(doc_path, res_idx, name): bibliography names, those of bibliography commands first."""
    return exploded(parsed(docs, "resources"), "parsed_resources", "res_idx").withColumnRenamed("x", "name")


def floats(docs: DataFrame) -> DataFrame:
    """(doc_path, float_idx, env_type, content, start_line, end_line, caption, labels); caption is null if there is none."""
    return exploded(parsed(docs, "floats"), "parsed_floats", "float_idx").select("doc_path", "float_idx", "x.*")


def labels(float_rows: DataFrame) -> DataFrame:
    """(doc_path, float_idx, label_idx, env_type, label, line)."""
    return float_rows.select("doc_path", "float_idx", F.posexplode("labels").alias("label_idx", "label"), "env_type", F.col("start_line").alias("line")).select("doc_path", "float_idx", "label_idx", "env_type", "label", "line")


def refs(docs: DataFrame) -> DataFrame:
    """(doc_path, label): the distinct labels each document refers to."""
    return exploded(parsed(docs, "refs"), "parsed_refs", "at").select("doc_path", F.col("x").alias("label"))


def graphics(docs: DataFrame) -> DataFrame:
    """(doc_path, img_idx, raw_path, line): included images; paths to sources, classes, styles and bibliographies are left out."""
    rows = exploded(parsed(docs, "graphics"), "parsed_graphics", "img_idx").select("doc_path", "img_idx", "x.*")
    return rows.where((F.col("raw_path") != "") & ~F.lower("raw_path").rlike(r"\.(?:tex|cls|sty|bib|bst)$"))


def title_guess(body: Column) -> Column:
    """The first text in quotes, else in an italic, emphasised or bold command, else empty."""
    # How a title is written.
    quoted = r"``([^']+?)''|\"([^\"]+?)\""
    macro = r"(?U)\\(?:textit|emph|textbf)\s*\{([^}]+)\}"
    first = F.coalesce(t.filled(F.regexp_extract(body, quoted, 1)), F.regexp_extract(body, quoted, 2))
    return F.when(body.rlike(quoted), t.strip(first)).otherwise(t.strip(F.regexp_extract(body, macro, 1)))


def inline_bibitems(docs: DataFrame) -> DataFrame:
    """Bibliography entries of bibliography blocks inside the sources, comments included."""
    rows = exploded(_moved(parsed(docs, "bibitems"), "parsed_bibitems", "line"), "parsed_bibitems", "at").select("doc_path", "x.*")
    rows = rows.where("key <> ''").withColumn("entry_type", F.lit("bibitem"))
    return rows.select("doc_path", "bib_idx", "key", "entry_type", "file", "line", "title", F.lit("").alias("author"), F.lit("").alias("eprint"), F.lit("").alias("doi"))


# What a lambda uses beside its element is bound by let(): else the optimiser may put the expression behind a column into the lambda, to be computed for each element.
def _found_paragraphs() -> Column:
    def runs(full: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(full), F.lit(1)))
        is_full = lambda i: F.coalesce(F.get(full, i - 1), F.lit(False))
        return F.arrays_zip(F.filter(at, lambda i: is_full(i) & ~is_full(i - 1)).alias("first"), F.filter(at, lambda i: is_full(i) & ~is_full(i + 1)).alias("last"))

    def rows(about: Column) -> Column:
        text = lambda r: t.strip(F.array_join(F.slice(about["lines"], r["first"], r["last"] - r["first"] + 1), "\n"))
        return F.transform(t.let(about["full"], runs), lambda r: F.struct(text(r).alias("text"), (about["line"] + r["first"] - 1).alias("start_line"), (about["line"] + r["last"] - 1).alias("end_line")))

    return t.let(F.struct(F.col("p_lines").alias("lines"), F.col("p_full").alias("full"), F.col("p_line").alias("line")), rows)


def _found_sections() -> Column:
    kind = "array<struct<title:string,text:string,start_line:int,end_line:int>>"

    def row(line: Column, m: Column) -> Column:
        return F.struct(t.strip(m["g1"]).alias("title"), t.strip(F.concat(m["text"], m["tail"])).alias("text"), (line + m["line"] - 1).alias("start_line"), (line + m["end_line"] + t.newlines(m["tail"]) - 1).alias("end_line"))

    several = t.let(F.col("p_line"), lambda line: F.transform("p_sections", lambda m: row(line, m))).cast(kind)
    one = F.array(F.struct(F.lit("").alias("title"), t.strip(F.col("p_text")).alias("text"), F.col("p_line").alias("start_line"), (F.col("p_line") + t.newlines(F.col("p_text"))).alias("end_line"))).cast(kind)
    return F.when(F.size("p_sections") > 0, several).otherwise(one)


def _found_citations() -> Column:
    return F.flatten(F.transform("p_cites", lambda m: F.transform(_keys(m["g1"]), lambda k: F.struct(k.alias("key"), m["line"].alias("line")))))


def _found_resources() -> Column:
    many = F.flatten(F.transform(F.regexp_extract_all("p_plain", F.lit(BIBLIOGRAPHY), F.lit(1)), _keys))
    return F.concat(many, F.filter(F.transform(F.regexp_extract_all("p_plain", F.lit(BIB_RESOURCE), F.lit(1)), t.strip), lambda n: n != ""))


def _found_floats() -> Column:
    def row(m: Column) -> Column:
        caption = F.when(m["g2"].rlike(CAPTION), t.strip(F.regexp_extract(m["g2"], CAPTION, 1)))
        labels = F.transform(F.regexp_extract_all(m["g2"], F.lit(LABEL), F.lit(1)), t.strip)
        return F.struct(m["g1"].alias("env_type"), m["g2"].alias("content"), m["line"].alias("start_line"), m["end_line"].alias("end_line"), caption.alias("caption"), labels.alias("labels"))

    return F.transform("p_floats", row)


def _found_graphics() -> Column:
    return F.transform("p_graphics", lambda m: F.struct(t.strip(m["g1"]).alias("raw_path"), m["line"].alias("line")))


def _found_bibitems() -> Column:
    def item(b: Column, block: Column, m: Column, i: Column) -> Column:
        return F.struct((block.cast("bigint") * 10**12 + i).alias("bib_idx"), t.strip(m["g1"]).alias("key"), (b["line"] + m["line"] - 1).alias("line"), title_guess(m["tail"]).alias("title"))

    return F.flatten(F.transform("p_blocks", lambda b, k: F.transform(t.occurrences(b["text"], BIB_ITEM, 1), lambda m, i: item(b, k, m, i))))


def _matches(column: str, guard: str, pattern: str, *groups: int) -> Column:
    """occurrences() in a column, looked for only where the guard stands."""
    return t.occurrences(F.when(F.contains(column, F.lit(guard)), F.col(column)).otherwise(""), pattern, *groups)


#: Columns that others are made of, in the order in which they are made.
_STEPS: dict[str, Callable[[], Column]] = {
    "p_source": lambda: F.coalesce("source", F.lit("")),
    "p_plain": lambda: t.strip_comments(F.col("p_source")),
    "p_offset": lambda: t.body_offset(F.col("p_source")),
    "p_line": lambda: t.newlines(F.substring("p_source", F.lit(1), F.col("p_offset"))) + 1,
    "p_body": lambda: t.body(F.col("p_source"), F.col("p_offset")),
    "p_text": lambda: t.strip_comments(F.col("p_body")),
    "p_lines": lambda: t.lines(F.col("p_text")),
    "p_full": lambda: F.transform("p_lines", t.is_filled),
    "p_sections": lambda: _matches("p_text", "\\section", SECTION, 1),
    "p_cites": lambda: _matches("p_plain", "cite", CITE, 1),
    "p_floats": lambda: _matches("p_source", "\\begin{", FLOAT, 1, 2),
    "p_graphics": lambda: _matches("p_source", "\\includegraphics", GRAPHICS, 1),
    "p_blocks": lambda: _matches("p_source", t.BIBLIOGRAPHY, BIB_BLOCK),
}
#: What each kind is made of, and how.
FOUND: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "citations": (("p_source", "p_plain", "p_cites"), _found_citations),
    "resources": (("p_source", "p_plain"), _found_resources),
    "floats": (("p_source", "p_floats"), _found_floats),
    "refs": (("p_source",), lambda: F.array_distinct(F.transform(F.regexp_extract_all("p_source", F.lit(REF), F.lit(1)), t.strip))),
    "graphics": (("p_source", "p_graphics"), _found_graphics),
    "bibitems": (("p_source", "p_blocks"), _found_bibitems),
    "paragraphs": (("p_source", "p_offset", "p_line", "p_body", "p_text", "p_lines", "p_full"), _found_paragraphs),
    "sections": (("p_source", "p_offset", "p_line", "p_body", "p_text", "p_sections"), _found_sections),
}


def parsed(docs: DataFrame, *kinds: str) -> DataFrame:
    """docs with a column parsed_<kind> for each of kinds (all of FOUND, if none are named): everything of that kind in the source, in order, in one pass over it."""
    missing = [k for k in kinds or FOUND if f"parsed_{k}" not in docs.columns]
    if not missing:
        return docs
    steps, rows = {s for k in missing for s in FOUND[k][0]}, docs
    for name in _STEPS:
        if name in steps:
            rows = rows.withColumn(name, _STEPS[name]())
    return rows.select(*docs.columns, *[FOUND[k][1]().alias(f"parsed_{k}") for k in missing])
