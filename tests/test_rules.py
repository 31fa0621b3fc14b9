"""The rule for rows of tables: as the plain pattern says it, and in time in proportion to the table."""

import random
import re
import time

from pyspark.sql import functions as F

from folioscan.operators import checks
from folioscan.rules import RULES, TABLE_ROWS

# Fixed value: what the rule finds, said without regard to time.
PLAIN = r"(?s)\\begin\s*\{tabular\}\s*\{[^}]*\}\s*\n?\s*[A-Za-z].*?&.*?\d+\s*\\\\\s*\n?\s*[A-Za-z].*?&.*?\d+\s*\\\\\s*\n?\s*(?:[A-Za-z].*?&.*?\d+|\\\\\s*(?:bottomrule|hline|hline))"
PARTS = ("a", "B", "&", "12", "7", "\\\\", "\\\\hline", "\\\\bottomrule", "\n", " ", "-", "\\end{tabular}", "\\begin{tabular}{ll}", "\\begin {tabular} {c}\n", "a & 1\\\\\n", "b & 22 \\\\ ", "\\hline")


def test_same_matches_as_the_plain_pattern():
    rng, found = random.Random(3), 0
    for _ in range(100_000):
        text = "\\begin{tabular}{l}" + "".join(rng.choices(PARTS, k=rng.randrange(4, 24)))
        plain = [m.span() for m in re.finditer(PLAIN, text)]
        found += len(plain)
        assert [m.span() for m in re.finditer(TABLE_ROWS.replace("(?sU)", "(?s)"), text)] == plain, text
    assert found > 5000


def test_time_grows_with_the_table(spark):
    """A table whose first rows are whole but that has no third: every gap would be tried in every way."""
    rule = tuple(r for r in RULES if r.number == "R20")

    def seconds(rows):
        text = "\\begin{tabular}{ll}\na & b 1 \\\\\nc & d\n" + "- & - 5 \\\\ -\n" * rows + "\\end{tabular}"
        docs = spark.createDataFrame([(f"{i}.tex", text) for i in range(4)], "doc_path string, source string").withColumn("start_line", F.lit(1)).cache()
        docs.count()
        best = []
        for _ in range(3):
            began = time.time()
            assert checks.scan_rules(docs, "source", rule).count() == 0
            best.append(time.time() - began)
        return min(best)

    seconds(1000)
    once, twice = seconds(50_000), seconds(100_000)
    assert twice < 3 * once + 1, (once, twice)
