"""Every operator on documents whose other columns are called what operators use inside: the same rows as without them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscan.llm import decontaminate, exact_dedup, licenses, lm_score, mixing, pii, quality, simhash, spelling, suffix_dedup, toxicity, wand, warc

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
NAMES = ("bucket", "batch", "uid", "local", "shard", "key", "sha", "word", "n", "probe", "rest", "term", "df", "docs", "start", "order", "size", "target", "score", "fp", "row", "digest", "payload", "item", "label", "hash", "places", "q")
RUN = {
    "op1": lambda d, t: decontaminate.decontaminate(d, t("benchmark")),
    "op2": lambda d, t: licenses.license_scan(d),
    "op3": lambda d, t: lm_score.lm_score(d),
    "op4": lambda d, t: suffix_dedup.suffix_dedup(d),
    "op5": lambda d, t: quality.quality(d, t("labels")),
    "op6": lambda d, t: mixing.mixing_report(d),
    "op7": lambda d, t: toxicity.toxicity(d, t("labels")),
    "op8": lambda d, t: simhash.simhash_dedup(d),
    "op9": lambda d, t: exact_dedup.exact_dedup(d),
    "op10": lambda d, t: pii.pii_report(d),
    "op11": lambda d, t: warc.archived_pages(d),
    "op12": lambda d, t: wand.ranked_search(d, t("benchmark")),
    "op13": lambda d, t: spelling.spelling_variants(d),
}


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


@pytest.mark.parametrize("name", RUN)
def test_same_rows_with_clashing_columns(spark, name):
    table = lambda x: spark.read.parquet(f"{DATA}/{x}.parquet")
    wide = lambda df: df.select("*", *[F.lit(f"other {c}").alias(c) for c in NAMES if c not in df.columns])
    own = table("pages" if name == "op11" else "documents")
    plain = rows(RUN[name](own, table))
    assert rows(RUN[name](wide(own), lambda x: wide(table(x)))) == plain and plain
