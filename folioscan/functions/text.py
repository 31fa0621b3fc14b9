"""Text expressions. All regex dialect decisions live here: patterns are Java's, with (?U) where Unicode classes are meant."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space when text is stripped.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE)
#: From the first to the last character that is no white space; the middle is taken whole and given back from the end, so it is read once.
STRIPPED = rf"(?s)\A[{_SPACE}]*+(.*[^{_SPACE}])"
NOT_BLANK = f"[^{_SPACE}]"
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: The ends of lines that are no simple one.
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
COMMENT = r"(?<!\\)%[^\n]*"
COMMAND = r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?(?:\{[^}]*\})?"
#: Numbers that running() sums in one go.
RUN = 128
#: Characters in which words are looked for first.
PROSE_HEAD = 200
BEGIN, END, BIBLIOGRAPHY = r"\begin{document}", r"\end{document}", r"\begin{thebibliography}"


def strip(c: Column) -> Column:
    return F.regexp_extract(c, STRIPPED, 1)


def is_filled(c: Column) -> Column:
    """Whether anything but white space stands in a text."""
    return c.rlike(NOT_BLANK)


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def strip_comments(c: Column) -> Column:
    """Drops from each unescaped percent sign to the end of its line; the line end stays."""
    return F.when(F.contains(c, F.lit("%")), F.regexp_replace(c, COMMENT, "")).otherwise(c)


def newlines(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))


def lines(c: Column) -> Column:
    """The lines of a text; a line end at the end begins no further line."""
    other = reduce(Column.__or__, [F.contains(c, F.lit(x)) for x in OTHER_LINE_ENDS])
    parts = F.when(other, F.split(c, LINE_END, -1)).otherwise(F.split(c, "\n", -1))
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def body_offset(source: Column) -> Column:
    """Characters in front of the body: up to the begin mark and one line end behind it; 0 without a mark."""
    at = F.instr(source, BEGIN)
    after = at + len(BEGIN) - 1
    return F.when(at == 0, 0).otherwise(after + (F.substring(source, after + 1, F.lit(1)) == "\n").cast("int"))


def body(source: Column, offset: Column) -> Column:
    """From the offset to the end mark or the bibliography, whichever comes first; the whole text without a begin mark."""
    rest = F.substring(source, offset + 1, F.lit(2**31 - 1))
    return F.when(F.contains(source, F.lit(BEGIN)), F.substring_index(F.substring_index(rest, END, 1), BIBLIOGRAPHY, 1)).otherwise(source)


def preamble(source: Column) -> Column:
    return F.when(F.contains(source, F.lit(BEGIN)), F.substring_index(source, BEGIN, 1)).otherwise("")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


_PLACE = "struct<chars:int,lines:int>"


def _plus(a: Column, b: Column) -> Column:
    return F.struct((a["chars"] + b["chars"]).alias("chars"), (a["lines"] + b["lines"]).alias("lines"))


def _sums(steps: Column, begin: Column) -> Column:
    zero = F.struct(begin.alias("at"), F.array().cast(f"array<{_PLACE}>").alias("out"))
    return F.aggregate(steps, zero, lambda acc, n: F.struct(_plus(acc["at"], n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def running(steps: Column) -> Column:
    """For each of an array of struct<chars, lines> the sum of those before it.

    Runs of RUN steps are summed by themselves and the sums of the runs after that, so what is copied stays in proportion
    to the array.
    """
    zero = F.lit(0)
    zero = F.struct(zero.alias("chars"), zero.alias("lines"))
    runs_of = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / RUN).cast("int")), lambda k: F.slice(a, k * RUN + 1, F.lit(RUN)))
    starts = lambda runs: _sums(F.transform(runs, lambda r: F.aggregate(r, zero, _plus)), zero)
    of = lambda a: let(runs_of(a), lambda runs: F.flatten(F.zip_with(runs, starts(runs), _sums)))
    return let(steps, lambda a: F.when(F.size(a) > 0, of(a)).otherwise(F.array().cast(f"array<{_PLACE}>")))


def pieces(text: Column, pattern: str, *groups: int) -> Column:
    """struct<whole, gaps, g1, ...>: the matches of a pattern, the texts around them, and the groups asked for; null without a match."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return let(found(0), lambda w: F.when(F.size(w) > 0, F.struct(w.alias("whole"), F.split(text, pattern, -1).alias("gaps"), *[found(g).alias(f"g{g}") for g in groups])))


def placed(parts: Column, *groups: int) -> Column:
    """The matches of pieces() with their places; see occurrences()."""

    def at(places: Column) -> Column:
        def row(w: Column, i: Column) -> Column:
            gap, place = F.get(parts["gaps"], i), F.get(places, i)
            start, line = place["chars"] + F.length(gap), place["lines"] + newlines(gap) + 1
            return F.struct(start.alias("start"), line.alias("line"), (start + F.length(w)).alias("end"), (line + newlines(w)).alias("end_line"), w.alias("text"), F.get(parts["gaps"], i + 1).alias("tail"), *[F.get(parts[f"g{g}"], i).alias(f"g{g}") for g in groups])

        return F.transform(parts["whole"], row)

    whole = lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))
    steps = F.transform(F.zip_with(parts["gaps"], parts["whole"], whole), lambda x: F.struct(F.length(x).alias("chars"), newlines(x).alias("lines")))
    return let(running(steps), at)


def occurrences(text: Column, pattern: str, *groups: int) -> Column:
    """Every match in order: array<struct<start, line, end, end_line, text, tail, g1, g2, ...>>.

    start and end are character offsets (end exclusive), line and end_line count from 1, tail is the text up to the next
    match, and one field per group asked for. Offsets and lines are running sums over the lengths of matches and gaps, so
    the time is in proportion to the text, whatever the number of matches.
    """
    kind = "array<struct<start:int,line:int,end:int,end_line:int,text:string,tail:string" + "".join(f",g{g}:string" for g in groups) + ">>"
    return let(pieces(text, pattern, *groups), lambda s: F.coalesce(placed(s, *groups).cast(kind), F.array().cast(kind)))


def quoted(c: Column) -> Column:
    """A text in quotes as a message shows it: single ones, or double ones around a text that has only single ones."""
    escaped = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def words(c: Column) -> Column:
    """Number of runs of letters, three or more each, outside commands."""
    return F.regexp_count(F.regexp_replace(c, COMMAND, " "), F.lit("[A-Za-z]{3,}"))


def has_prose(c: Column, least: int = 3) -> Column:
    """Whether there are so many words. A beginning without commands that has them is enough, so most texts are not read to their end."""
    head = F.substring(c, F.lit(1), F.lit(PROSE_HEAD))
    early = ~F.contains(head, F.lit("\\")) & (F.regexp_count(head, F.lit("[A-Za-z]{3,}")) >= least)
    return F.when(early, True).otherwise(words(c) >= least)
