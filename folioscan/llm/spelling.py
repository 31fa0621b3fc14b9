"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of length l is cut into two even segments, its first l // 2 code points and the rest. One edit can touch only one
of them, so of two near words the longer (or equal) one holds the shorter one's first segment at its start or its second
segment at its end, where it stands shifted by the difference in length. Every word is indexed under its two segments, and
probes with the substrings at those places for indexed words of its own length and of one code point less. Both segments
match only where the inserted code point stands right between them; such a candidate is taken from the first segment
alone, so no pair comes twice. What is left of the two words beside the segment is then verified to differ by one edit.

Scale. Counting words is a partial count per batch and a grouped sum. A segment that many words share would pair them
all: where a group has more than GROUP_PAIRS candidates, its words are split again in the same way by the rest of the word,
and so on (the rests halve each time). Groups that remain hold words that differ in one or two code points only. A form
has ten times the count of its word, so chains of forms are short (at most 19 steps); roots follow by pointer doubling.

Cases. Null text: no words. Null doc_id: the empty string in the key of the checksum. Repeated rows count again. Empty
table, or no word twice: no rows. Extra columns are ignored. Of equally frequent near words the smallest in code-point
order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import doc_rows, written

#: Least code points and occurrences of a word, and how many times a form's count is its word's.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One in so many (document, run) pairs loses a code point.
DROPS = 31
#: Candidates of a group beyond which its words are split further.
GROUP_PAIRS = 1024
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 100_000

_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))


def _counter(least_length: int, drops: int, held_words: int):
    #: Runs shorter than the least length can't become words, so they are passed over by the pattern.
    runs = re.compile(rf"[A-Za-zÀ-ÿ]{{{least_length},}}").findall

    def counted(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                name = b"" if doc_id.as_py() is None else str(doc_id.as_py()).encode()
                seed = zlib.crc32(name + b":")
                for word, n in Counter(runs(text.as_py().translate(_LOWER).decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % drops == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                if len(counts) >= held_words:
                    yield counted(counts)
                    counts = Counter()
        yield counted(counts)

    return run


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drops: int = DROPS, held_words: int = HELD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): every word of docs and how often it occurs."""
    counts = doc_rows(docs, id_col, text_col).mapInArrow(_counter(least_length, drops, held_words), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _split(rows: DataFrame) -> DataFrame:
    """Each row under its two segments: key grows by the segment, rest loses it; size is the length of an indexed word's rest."""
    p = F.floor(F.col("size") / 2).cast("int")
    q = F.col("size") - p
    rest, cut = F.col("rest"), F.length("rest") - q
    first = F.struct(F.concat("key", F.lit("1"), F.substring(rest, F.lit(1), p)).alias("key"), F.substring(rest, p + 1, F.length("rest")).alias("rest"), q.alias("size"), F.col("second"))
    last = F.struct(F.concat("key", F.lit("2"), F.substring(rest, cut + 1, q)).alias("key"), F.substring(rest, F.lit(1), cut).alias("rest"), p.alias("size"), F.lit(True).alias("second"))
    return rows.select("word", "n", "probe", F.explode(F.array(first, last)).alias("s")).select("word", "n", "probe", "s.*")


def _sized(rows: DataFrame) -> DataFrame:
    """The rows whose group has a candidate, with the number of its candidates. Each indexed row's word also probes its group."""
    groups = rows.groupBy("key").agg(F.count_if("probe").alias("probes"), F.count_if(~F.col("probe")).alias("indexed"))
    groups = groups.where("probes > 1 and indexed > 0").select("key", (F.col("probes") * F.col("indexed")).alias("candidates"))
    return rows.join(groups, "key")


def _verified(rows: DataFrame) -> DataFrame:
    """(word, n, other, other_n): the one-edit pairs of each group, a longer word first; of equal lengths both ways."""
    a = rows.where("probe").select("key", "second", F.col("rest").alias("a"), "word", "n")
    b = rows.where("not probe").select("key", F.col("rest").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    between: Column = F.col("second") & F.startswith("a", "b")
    return a.join(b, "key").where((F.col("word") != F.col("other")) & (F.levenshtein("a", "b", 1) == 1) & ~between).select("word", "n", "other", "other_n")


def near_pairs(vocabulary: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of words of vocabulary (word, n; each word once) that are one edit apart, once."""
    base = vocabulary.where("length(word) > 1").select("word", "n", F.col("word").alias("rest"), F.length("word").alias("size"), F.lit(False).alias("second"))
    indexed = base.withColumn("probe", F.lit(False))
    probing = base.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") - 1))).withColumn("probe", F.lit(True))
    rows = indexed.unionByName(probing).withColumn("key", F.col("size").cast("string"))
    found = None
    while True:
        sized = written(_sized(_split(rows)))
        more = (F.col("candidates") > group_pairs) & (F.col("size") > 1)
        pairs = _verified(sized.where(~more))
        found = pairs if found is None else found.unionByName(pairs)
        if not sized.where(more).take(1):
            break
        rows = sized.where(more).drop("candidates")
    shorter = F.length("word") > F.length("other")
    back = F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = F.when(shorter, F.array(F.struct("word", "n", "other", "other_n"), back)).otherwise(F.array(F.struct("word", "n", "other", "other_n")))
    return found.select(F.explode(both).alias("p")).select("p.*")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words in links (word, form): each round doubles the steps that a pointer has taken."""
    at = written(links.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        doubled = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = doubled.drop("moved")
        if not doubled.where("moved").take(1):
            return at


def spelling_variants(docs: DataFrame, ratio: int = RATIO, group_pairs: int = GROUP_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word."""
    vocabulary = written(words(docs, id_col=id_col, text_col=text_col))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_pairs(vocabulary, group_pairs).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    rows = written(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
        )
    )
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
