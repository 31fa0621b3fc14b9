"""Every page is a root of the include expansion: compared with a plain recursion over a small table of pages."""

from folioscan.plans import queries as q


def brute(n):
    """(root, combined line, text, file, line) of every page, straight from the definition."""
    out = []
    names = {f"p{i}.tex" for i in range(n)}

    def lines(path):
        i = int(path[1:-4])
        first = 0 if i % 13 == 12 else i * 2 + 1
        return [f"head {i}", f"\\input{{p{first}}}", "% \\input{p0}", "middle", f"\\include{{p{i * 2 + 2}.tex}}", "tail"]

    def walk(path, stack, rows):
        if path not in names:
            rows.append((f"% folioscan: could not read {path}", path, 1))
            return
        for at, text in enumerate(lines(path), 1):
            if not text.startswith("\\"):
                rows.append((text, path, at))
                continue
            name = text[text.index("{") + 1 : -1]
            child = f"{name}.tex" if f"{name}.tex" in names else name
            if child in stack:
                rows.append((f"% folioscan: cycle, not expanded: {child}", child, 1))
            else:
                walk(child, [*stack, child], rows)

    for root in sorted(names):
        rows = []
        walk(root, [root], rows)
        out += [(root, k, *r) for k, r in enumerate(rows, 1)]
    return out


def test_every_page_is_expanded(spark, tmp_path):
    n = 60
    spark.createDataFrame([(i,) for i in range(n)], "page_id long").write.parquet(str(tmp_path / "pages.parquet"))
    rows = brute(n)
    assert len({r[0] for r in rows}) == n
    text = [tuple(r) for r in q.QUERIES["include_expand"](spark, str(tmp_path)).collect()]
    assert sorted(text) == sorted(r[:3] for r in rows)
    origin = [tuple(r) for r in q.QUERIES["line_origin"](spark, str(tmp_path)).collect()]
    assert sorted(origin) == sorted((r[0], r[1], r[3], r[4]) for r in rows)


def test_back_to_the_first_page(spark, tmp_path):
    """Below page 12 all of the first page is expanded, with the places that its lines have."""
    spark.createDataFrame([(i,) for i in range(14)], "page_id long").write.parquet(str(tmp_path / "pages.parquet"))
    rows = q.QUERIES["line_origin"](spark, str(tmp_path)).where("doc_path = 'p12.tex'").collect()
    assert sorted(tuple(r) for r in rows) == sorted((r[0], r[1], r[3], r[4]) for r in brute(14) if r[0] == "p12.tex")
    assert {"p0.tex", "p2.tex", "p5.tex"} <= {r.origin_file for r in rows}
