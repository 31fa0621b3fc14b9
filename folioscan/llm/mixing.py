"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The mix takes each source's documents in a fixed random order, as often as its target asks for: whole passes, then a
part of one more. A pass is cut into blocks of about BLOCK_WORDS words; how many blocks a source gives is its quota.
A binary tree over the output shards splits the vector of quotas: at every node the left half's share of each source is
drawn from the multivariate hypergeometric distribution, so the quotas stay exact and the draws of all shards are
disjoint. Each shard takes its run of the source's permuted blocks and is shuffled by itself.

Scale. The order within a source is by a hash of id and text. Words are summed per source and hash bucket first, and only inside one
bucket are documents sorted, so a source with a third of all rows is spread over BUCKETS tasks. The driver holds one row
per source (bounded by MAX_SOURCES, checked) and the tree's counts.

Cases. Null text: size 0, taken 0. Null source: a source, ordered last. Empty texts or sources without a word: target 0.
Null doc_id: mixed like any other row. Repeated rows: each is mixed; they share a hash and stand next to each other.
Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioscan.llm.common import written

WEIGHTS = (5, 2, 1)
MOST = 3.0
BUCKETS = 1024
BLOCK_WORDS = 20_000
#: Blocks get longer once a pass over everything would have more of them: the draws take counts under 10**9.
MOST_BLOCKS = 10**8
SHARDS = 16
#: A document fills what a partial pass leaves open only if it takes at most a FINE-th of it.
FINE = 4
SEED = 20240229
MAX_SOURCES = 1_000_000


def words(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST, share: float = 1.0) -> list[float]:
    """Each source's words in the mix: in proportion to the weights, at most most times its size; what is over is reshared by weight."""
    want, cap = share * sum(sizes), [most * s for s in sizes]
    full: set[int] = set()
    while True:
        left = want - sum(cap[i] for i in full)
        open_weight = sum(w for i, w in enumerate(weights) if i not in full)
        over = [i for i, w in enumerate(weights) if i not in full and left * w / open_weight > cap[i]]
        if not over:
            return [cap[i] if i in full else left * w / open_weight for i, w in enumerate(weights)]
        full.update(over)


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources) counts whose columns sum to the quotas, by recursive multivariate-hypergeometric draws."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        mid = (low + high) // 2
        draws = int(counts.sum()) * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = np.zeros_like(counts)
        rest, room = int(counts.sum()), draws
        for i, c in enumerate(counts.tolist()):
            rest -= c
            left[i] = rng.hypergeometric(c, rest, room) if room and c + rest else 0
            room -= int(left[i])
        split(left, low, mid)
        split(counts - left, mid, high)

    if len(quotas):
        split(quotas, 0, shards)
    return out


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...]) -> DataFrame:
    text = F.col(text_col).cast("string")
    order = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text).alias("size"), order.alias("order"), *carry)
    return sized.select("*", F.pmod(F.shiftright("order", 20), F.lit(BUCKETS)).alias("bucket"))


def _placed(sized: DataFrame, by_bucket: DataFrame, column: str, name: str, carry: tuple[str, ...]) -> DataFrame:
    """Adds the sum of a column over all documents of the source that come earlier in its order. by_bucket has that sum per bucket as words."""
    earlier = (Window.unboundedPreceding, -1)
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(*earlier))
    inside = F.sum(column).over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", *carry).rowsBetween(*earlier))
    offsets = by_bucket.select(F.col("source").alias("of"), F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("offset"))
    placed = sized.withColumn("inside", F.coalesce(inside, F.lit(0)))
    placed = placed.join(offsets, placed.source.eqNullSafe(offsets.of) & (placed.bucket == offsets.b))
    return placed.withColumn(name, F.col("offset") + F.col("inside")).drop("of", "b", "offset", "inside")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, share: float = 1.0, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, passes, starts, shards_of): for each document how often the mix takes it, and the shard of each time.

    carry: columns of docs that go along and tell apart rows of one id; their names must not be those of the plan.
    The driver sees one row per source. Small documents fill what the partial pass leaves open at its end, so a source's taken words come close to its target.
    """
    spark = docs.sparkSession
    sized = written(_sized(docs, seed, id_col, text_col, source_col, carry))  # so that the texts are read once
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    by_bucket = written(by_bucket)
    sources = by_bucket.groupBy("source").agg(F.sum("words").alias("words"))
    if sources.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    table = sorted(((r["source"], r["words"]) for r in sources.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [w for _, w in table]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(table))], most, share) if table else []
    rows, quotas = [], []
    block_words = max(BLOCK_WORDS, sum(sizes) // MOST_BLOCKS)
    for (source, size), aim in zip(table, aims):
        full = int(aim // size) if size else 0
        part = aim - full * size
        blocks, part_blocks = math.ceil(size / block_words), math.ceil(part / block_words)
        quotas.append(full * blocks + part_blocks)
        rows.append([source, size, float(aim), full, float(part), blocks, part_blocks])
    counts = split_quotas(np.array(quotas, np.int64), shards, seed)
    for i, row in enumerate(rows):
        row.append(np.cumsum(counts[:, i])[:-1].tolist())
        # A multiplier without a common factor permutes the source's draws.
        q = max(1, quotas[i])
        row += [q, next(m for m in range(max(1, int(q * 0.618)), q + 2) if math.gcd(m, q) == 1)]
    types = [("s", T.StringType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("full", T.LongType()), ("part", T.DoubleType()), ("blocks", T.LongType()), ("part_blocks", T.LongType()), ("cuts", T.ArrayType(T.LongType())), ("quota", T.LongType()), ("step", T.LongType())]
    per_source = spark.createDataFrame(rows, T.StructType([T.StructField(n, t) for n, t in types]))
    placed = written(_placed(sized, by_bucket, "size", "start", carry).join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    # The partial pass takes the documents that end within it. The document that would cross its end leaves a gap, which
    # later documents of at most a FINE-th of the gap fill, in the same order.
    whole_part = (F.col("size") > 0) & (F.col("start") + F.col("size") <= F.col("part"))
    gaps = placed.groupBy("source").agg((F.first("part") - F.sum(F.when(whole_part, F.col("size")).otherwise(0))).alias("gap")).withColumnRenamed("source", "s")
    fitting = ~whole_part & (F.col("size") > 0) & (F.col("size") <= F.greatest(F.lit(1.0), F.col("gap") / FINE))
    placed = written(placed.join(gaps, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("fill", F.when(fitting, F.col("size")).otherwise(0)))
    placed = _placed(placed, placed.groupBy("source", "bucket").agg(F.sum("fill").alias("words")), "fill", "fill_start", carry)
    extra = whole_part | ((F.col("fill") > 0) & (F.col("fill_start") + F.col("fill") / 2 <= F.col("gap")))
    passes = F.when(F.col("size") > 0, F.col("full") + extra.cast("long")).otherwise(F.lit(0).cast("long"))
    # A source's draws are numbered: the blocks of its partial pass, then those of each whole pass.
    block = F.floor(F.col("start") / block_words)
    whole = lambda p: F.col("part_blocks") + (p - extra.cast("long")) * F.col("blocks") + block
    draw = lambda p: F.when(extra & (p == 0), F.least(block, F.col("part_blocks") - 1)).otherwise(whole(p))
    shard = lambda p: F.size(F.filter("cuts", lambda c: c <= F.pmod(draw(p) * F.col("step"), F.col("quota"))))
    shards_of = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), shard)).otherwise(F.array().cast("array<int>"))
    return placed.withColumn("passes", passes).select("doc_id", "source", "size", "source_size", "target", "passes", "order", shards_of.alias("shards_of"), *carry)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: (doc_id, source, size, shard, place, copy) and the columns to carry. place orders a shard's rows at random: sort by it within a shard."""
    seed, carry = options.get("seed", SEED), options.get("carry", ())
    drawn = plan(docs, **options).select("doc_id", "source", "size", "order", *carry, F.posexplode("shards_of").alias("copy", "shard"))
    return drawn.select("doc_id", "source", "size", "shard", F.xxhash64(F.lit(seed + 1), "order", "copy").alias("place"), "copy", *carry)


def mixing_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, shards): one row per document; taken counts repeats."""
    return plan(docs, **options).select("doc_id", "size", F.col("source_size"), "target", (F.col("passes") * F.col("size")).alias("taken"), "source", F.col("shards_of").alias("shards"))
