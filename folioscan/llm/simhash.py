"""SimHash near-deduplication over a Gray-order hierarchical index.

A fingerprint bit is 1 if it is set in over half the hashes of the text's word shingles. Fingerprints that differ in
few bits are found with an index in which fingerprints stand in Gray-code order, so neighbours share most bits.
Runs of neighbours form a node that keeps a mask of the bits all its members share, and their values; the nodes above
factor out what their children share in turn, so each child is compared only in the bits its parent left open. A search
walks down from the top, adds up the differences, and drops a whole group once they exceed the limit.

Scale. Only distinct fingerprints are indexed. With b = distance + 1 bands, two linked fingerprints agree in one band,
so each (band, value) is an index of its own and all of them are spread over the cluster by that key, in as many shards as
the number of fingerprints asks for. A value that more than MOST fingerprints share is split: among them, two linked ones
agree in one of b bands of the remaining bits too, and so on until no more than LEFT bits are open, so the same links are
found in groups of at most 2**LEFT. A task returns a spanning forest of the links it found, never all pairs: groups that already hang together as a
whole are skipped during the search. The forests are joined by large-star and small-star steps, each written to the
shared folder.

Cases. Null text: as empty, fingerprint zero. Null doc_id: linked like any other row; component_id is the smallest id
that is not null, or null. Repeated rows: each is a row of the result. Empty table: no rows. Extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import chunks, doc_rows, written
from folioscan.llm.hashing import xxh64

BITS = 64
DISTANCE = 3
SHINGLE = 3
#: Children of an index node, and members of a lowest node.
FANOUT = 8
#: Fingerprints of one band value that are searched together; at least a KEYS-th of all, so at most b * KEYS values are split.
MOST = 500_000
KEYS = 50_000
LEFT = 21
#: Rows (a fingerprint in a band) of a shard.
SHARD_ROWS = 500_000
#: Queries that walk the index together.
QUERIES = 4096


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text. Words are runs of non-blank bytes, A-Z lower-cased; shingles are joined by single spaces."""
    words = [t.lower().split() for t in texts]
    data = b" ".join(b" ".join(w) for w in words if w)
    counts = np.array([len(w) for w in words], np.int64)
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    if not counts.sum():
        return np.zeros(len(texts), np.uint64)
    starts = np.append(0, ends[:-1] + 1)
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first_word = np.cumsum(counts) - counts
    first = np.cumsum(n) - n
    at = np.repeat(first_word - first, n) + np.arange(n.sum())
    span = np.repeat(np.minimum(counts, shingle), n)
    h = xxh64(data, starts[at], ends[at + span - 1])
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    held = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
    out[full] = np.packbits(2 * held > n[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch):
                fp = fingerprints_of(c.column("text").to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code in Gray order: every bit is the parity of the code's bits from the top down to it."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A hierarchical index over codes in Gray order; levels[0] holds the codes, each level above groups FANOUT nodes."""

    def __init__(self, codes: np.ndarray):
        full = np.uint64(2**64 - 1)
        self.codes = codes
        self.bits, self.masks = [codes], [np.full(len(codes), full)]
        while len(self.bits[-1]) > FANOUT:
            bits, masks = self.bits[-1], self.masks[-1]
            heads = np.arange(0, len(bits), FANOUT)
            both = np.bitwise_and.reduceat(masks, heads)
            both &= ~(np.bitwise_or.reduceat(bits, heads) ^ np.bitwise_and.reduceat(bits, heads))
            self.bits.append(bits[heads] & both)
            self.masks.append(both)
        #: What is left to compare in a node once its parent was compared.
        self.rest = [m & ~np.repeat(up, FANOUT)[: len(m)] for m, up in zip(self.masks, self.masks[1:])] + [self.masks[-1]]

    def search(self, queries: np.ndarray, limit: int, query_group: np.ndarray | None = None, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All (query, position) within limit bits. With groups: leaves out nodes all of whose members are in the query's group."""
        uniform = None
        if groups is not None:
            uniform, g = [groups], groups
            for _ in self.bits[1:]:
                heads = np.arange(0, len(g), FANOUT)
                low, high = np.minimum.reduceat(g, heads), np.maximum.reduceat(g, heads)
                g = np.where((low == high) & (low >= 0), low, -1)
                uniform.append(g)
        top = len(self.bits) - 1
        q = np.repeat(np.arange(len(queries)), len(self.bits[top]))
        node = np.tile(np.arange(len(self.bits[top])), len(queries))
        differ = np.zeros(len(q), np.uint8)
        for level in range(top, -1, -1):
            differ = differ + np.bitwise_count((queries[q] ^ self.bits[level][node]) & self.rest[level][node])
            keep = differ <= limit
            if uniform is not None:
                keep &= uniform[level][node] != query_group[q]
            q, node, differ = q[keep], node[keep], differ[keep]
            if level:
                q = np.repeat(q, FANOUT)
                differ = np.repeat(differ, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < len(self.bits[level - 1])
                q, node, differ = q[inside], node[inside], differ[inside]
        return q, node


def forest_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest position reachable from each of n positions by links a-b (and by equal labels before)."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter
    return label


def _links_of_run(codes: np.ndarray, limit: int) -> np.ndarray:
    """For each code, in Gray order, the smallest position it is linked to within this run, over any number of links."""
    label = np.arange(len(codes))
    index = GrayIndex(codes)
    for at in range(0, len(codes), QUERIES):
        own = label[at : at + QUERIES]
        q, found = index.search(codes[at : at + QUERIES], limit, own, label)
        label = forest_labels(len(codes), q + at, found, label)
    return label


def band_links(codes: np.ndarray, turned: np.ndarray, path: np.ndarray, fixed: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, linked code) forming a forest of all links between codes of one path that share the top bits they are given with.

    turned: the codes with their bits in the order of the path; fixed: how many of the top ones codes must share.
    """
    rank = gray_rank(turned)
    order = np.lexsort((rank, path))
    codes, turned, path, fixed = codes[order], turned[order], path[order], fixed[order]
    key = turned >> (np.uint64(BITS) - fixed.astype(np.uint64))
    new = np.append(True, (key[1:] != key[:-1]) | (path[1:] != path[:-1]))
    run = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(codes)))
    label = np.arange(len(codes))
    # A run of up to FANOUT codes is a lowest node by itself: its members are compared with each other, all runs at once.
    short = sizes[run] <= FANOUT
    a, b = [], []
    for step in range(1, FANOUT):
        i = np.flatnonzero(short[:-step] & (run[:-step] == run[step:])) if len(codes) > step else np.empty(0, np.int64)
        i = i[np.bitwise_count(codes[i] ^ codes[i + step]) <= limit]
        a.append(i)
        b.append(i + step)
    label = forest_labels(len(codes), np.concatenate(a), np.concatenate(b), label)
    for head, size in zip(heads, sizes):
        if size > FANOUT:
            label[head : head + size] = head + _links_of_run(codes[head : head + size], limit)
    linked = np.flatnonzero(label != np.arange(len(codes)))
    return codes[linked], codes[label[linked]]


def _turned(code: Column, fixed: int, by: int) -> Column:
    """The bits below the fixed top ones, turned to the left by so many."""
    low = BITS - fixed
    if not by:
        return code
    mask = lambda n: F.lit((1 << n) - 1 if n < 64 else -1).cast("long")
    rest = code.bitwiseAND(mask(low))
    turned = F.shiftleft(rest, by).bitwiseOR(F.shiftrightunsigned(rest, low - by)).bitwiseAND(mask(low))
    return turned if not fixed else code.bitwiseAND(~((1 << low) - 1)).bitwiseOR(turned)


def banded(fps: DataFrame, bands: int, most: int) -> DataFrame:
    """(fp, turned, path, fixed): each fingerprint once per band; where more than most share a band's value, once per band of the bits that are left, and so on."""

    def split(rows: DataFrame, fixed: int) -> tuple[DataFrame, int]:
        width = (BITS - fixed) // bands
        turned = F.array(*[_turned(F.col("turned"), fixed, b * width) for b in range(bands)])
        return rows.select("fp", "path", F.posexplode(turned).alias("b", "turned")).select("fp", "turned", (F.col("path") * bands + F.col("b") + 1).alias("path"), F.lit(fixed + width).alias("fixed")), fixed + width

    rows, fixed = split(fps.select("fp", F.col("fp").alias("turned"), F.lit(0).cast("long").alias("path")), 0)
    done = None
    while True:
        key = F.shiftrightunsigned("turned", BITS - fixed).alias("value")
        hot = rows.groupBy("path", key).count().where(F.col("count") > most).select("path", "value")
        hot = written(hot)
        if BITS - fixed <= LEFT or hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        # At most b values of a KEYS-th of the fingerprints each can be hot on a level.
        keyed, hot = rows.withColumn("value", key), F.broadcast(hot)
        cool = keyed.join(hot, ["path", "value"], "left_anti").drop("value")
        done = cool if done is None else done.unionByName(cool)
        rows, fixed = split(keyed.join(hot, ["path", "value"], "left_semi"), fixed)


def links(fps: DataFrame, distance: int = DISTANCE, shards: int | None = None, most: int | None = None) -> DataFrame:
    """(a, b) with a > b: a forest with the same components as all links between the distinct fingerprints fps(fp)."""
    bands, n = distance + 1, fps.count()
    rows = banded(fps, bands, most or max(MOST, n // KEYS))
    shards = shards or bands * n // SHARD_ROWS + fps.sparkSession.sparkContext.defaultParallelism
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("path", F.expr(f"shiftrightunsigned(turned, {BITS} - fixed)")), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        codes, turned = (table.column(c).to_numpy().view(np.uint64) for c in ("fp", "turned"))
        x, y = (v.view(np.int64) for v in band_links(codes, turned, table.column("path").to_numpy(), table.column("fixed").to_numpy(), distance))
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return rows.groupBy("shard").applyInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of edges(a, b), by alternating large-star and small-star steps."""
    edges = written(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        small = written(small)
        # Every node hangs directly below a root that hangs below nothing: the components are stars.
        deep = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        several = small.groupBy("a").count().where("count > 1")
        if deep.isEmpty() and several.isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = small


def simhash_dedup(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint 16 hex digits, component_id: smallest doc_id reachable over links of up to distance bits)."""
    rows = written(fingerprints(docs, shingle, id_col, text_col))
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp"), distance))
    labelled = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = written(labelled.join(least, "root").select("fp", "component_id"))
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
