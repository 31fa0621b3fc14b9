from folioscan.operators import parse


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(df.columns[0], df.columns[1]).collect()]


def test_paragraph_lines(docs_of):
    docs = docs_of("\\begin{document}\nOne.\nStill one.\n\nTwo.\n\\end{document}\n")
    assert rows(parse.paragraphs(docs), "text", "start_line", "end_line") == [("One.\nStill one.", 2, 3), ("Two.", 5, 5)]


def test_paragraphs_without_marks(docs_of):
    assert rows(parse.paragraphs(docs_of("First line.\n\nSecond line.")), "start_line") == [(1,), (3,)]


def test_paragraph_details(docs_of):
    assert rows(parse.paragraphs(docs_of("50\\% efficiency.")), "text") == [("50\\% efficiency.",)]
    assert rows(parse.paragraphs(docs_of("a\n% only a comment\nb")), "start_line", "end_line") == [(1, 1), (3, 3)]
    docs = docs_of("\\begin{document}\nText here.\n\\begin{thebibliography}{1}\n\\bibitem{a} A\n\\end{thebibliography}\n\\end{document}")
    assert rows(parse.paragraphs(docs), "text") == [("Text here.",)]
    assert rows(parse.paragraphs(docs_of("", None, "\n \n")), "text") == []


def test_sections(docs_of):
    docs = docs_of("\\begin{document}\nText only.\n\\end{document}")
    assert rows(parse.sections(docs), "title", "text", "start_line", "end_line") == [("", "Text only.", 2, 3)]
    docs = docs_of("\\begin{document}\n\\section{Intro}\nA\n\n\\section*{Method}\nB\n% \\section{fake}\n\\end{document}")
    assert rows(parse.sections(docs), "title", "text", "start_line", "end_line") == [("Intro", "\\section{Intro}\nA", 2, 5), ("Method", "\\section*{Method}\nB", 5, 8)]


def test_citations(docs_of):
    docs = docs_of("\\cite{a,b, c}", "\\citep[see][p.~42]{jones1999}", "first line\n\\cite{a}\n\n\\citet{b}\n", "% \\cite{no}\nyes \\parencite*{p} \\nocite{*}")
    assert rows(parse.citations(docs), "doc_path", "key", "line") == [("d0.tex", "a", 1), ("d0.tex", "b", 1), ("d0.tex", "c", 1), ("d1.tex", "jones1999", 1), ("d2.tex", "a", 2), ("d2.tex", "b", 4), ("d3.tex", "p", 2), ("d3.tex", "*", 2)]


def test_bib_resources(docs_of):
    docs = docs_of("\\addbibresource{bibliography.bib}\n\\bibliography{refs, extra,}")
    assert rows(parse.bib_resources(docs), "name") == [("refs",), ("extra",), ("bibliography.bib",)]


def test_floats(docs_of):
    docs = docs_of("x\n\\begin{figure*}\n\\caption[short]{ A } \\label{ a }\\label{b}\n\\end{figure*}\n\\begin{table} y \\end{table}\n\\begin{figure}[t]\nz\n\\end{figure}")
    assert rows(parse.floats(docs), "env_type", "start_line", "end_line", "caption", "labels") == [("figure", 2, 4, "A", ["a", "b"]), ("table", 5, 5, None, [])]


def test_inline_bibitems(docs_of, spark):
    source = "text\n\n\\begin{thebibliography}{9}\n\\bibitem{foo} A. ``A title''. x\n\\bibitem[B]{bar} \\emph{Other}\n\\bibitem{ } none\n\\end{thebibliography}"
    items = parse.inline_bibitems(docs_of(source))
    assert rows(items, "key", "line", "title", "entry_type") == [("foo", 4, "A title", "bibitem"), ("bar", 5, "Other", "bibitem")]
    from pyspark.sql import functions as F

    runs = F.array(*[F.struct(F.lit(start).alias("start"), F.lit(length).alias("length"), F.lit(file).alias("file"), F.lit(origin).alias("origin")) for start, length, file, origin in ((1, 2, "d0.tex", 1), (3, 3, "refs.tex", 10))])
    assert rows(parse.inline_bibitems(docs_of(source).withColumn("line_runs", runs)), "file", "line") == [("refs.tex", 11), ("refs.tex", 12)]
