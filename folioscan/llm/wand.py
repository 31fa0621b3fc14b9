"""Ranked lexical search over an inverted index with variable-sized blocks, skipping blocks by their bounds (WAND).

index() cuts the documents into shards, each with its own posting lists. A posting holds a document's place in the shard and
what one occurrence of the term in a query adds to its score before weighting (its impact, exact in integers). Dynamic
programming cuts each list into blocks so that the total of the blocks' bounds over their postings (which exceeds the true total
by exactly the bounds' error) plus a fixed cost per block is least; borders fall on every fourth posting, and a block has at most 128 of them.

search() takes queries in blocks of bounded size. In each shard, the weighted bounds of the blocks of a query's lists are
added up over the ranges of documents that they span. Pivots are the documents whose summed bound reaches the tenth best score so far; only
they are looked up in the lists, in the order of documents and a few hundred at a time, so that rising scores thin out those that
follow; all ranges in between are skipped. The documents of the highest bounds are scored before the others, to start from a high tenth score. A
document that is passed over cannot be among the ten, so the result is that of scoring every document.

Scale. Shards hold at most SHARD_BYTES of text and SHARD_DOCS documents, so a task's memory does not depend on the input;
documents are not shuffled, only the lists of queried terms are, by shard. A term in every document is one list per shard. Each shard returns at
most ten documents per query, and a task none that lie behind ten that it has found in other shards; they are cut to ten again before they meet.
Queries are sent in blocks of at most QUERY_PAIRS (query, term) pairs, however many there are.

Cases. Null or termless texts: not counted, never found; items without terms: no rows. Null doc_id: before all others in ties.
Null item_id: an item like any other. Repeated rows: each document and each item counts by itself, ranks are unique. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm.common import NO_ID, WORDS_TABLE, chunks, doc_rows, written

SHARD_BYTES, SHARD_DOCS = 12 << 20, 16_384
#: Postings between possible borders, and the most of such cells in a block.
CELL, MOST_CELLS = 4, 32
#: What a block costs, in units of impact: more of it makes larger blocks with looser bounds.
BLOCK_COST = 5_000_000
TOP = 10
#: Documents scored at a time.
STEP = 256
QUERY_PAIRS = 200_000

_INDEX = "shard long, term binary, df int, docs binary, impacts binary, ends binary, bounds binary"
_FIELDS = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int32()), ("docs", pa.binary()), ("impacts", pa.binary()), ("ends", pa.binary()), ("bounds", pa.binary())])
_FOUND = "q long, doc_id long, score long"
_FOUND_FIELDS = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for text in batch.column("text"):
            n = len(text.as_py().translate(WORDS_TABLE).split())
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})


def corpus_size(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """The number of documents that have terms, and of their terms."""
    row = doc_rows(docs, id_col, text_col).mapInArrow(_counts, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def cut_lists(starts: np.ndarray, impacts: np.ndarray, cost: int = BLOCK_COST, cell: int = CELL, most: int = MOST_CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(ends, bounds) of the blocks of posting lists that begin at starts and lie one behind another: where each ends (exclusive) and its greatest impact.

    Of all ways to cut a list at every cell-th posting into blocks of at most most cells, the one with the least sum of cost + length * bound.
    All lists take a step of the dynamic program at once.
    """
    sizes = np.diff(np.append(starts, len(impacts)))
    cells = -(-sizes // cell)
    first = np.cumsum(cells) - cells
    owner = np.repeat(np.arange(len(starts)), cells)
    at = starts[owner] + cell * (np.arange(len(owner)) - first[owner])
    tops = np.maximum.reduceat(impacts, at).astype(np.int64)
    lengths = np.minimum(cell, (starts + sizes)[owner] - at)
    order = np.argsort(-cells, kind="stable")
    order = order[cells[order] > 1]
    back = np.zeros(len(owner), np.int64)
    reach = np.full((most, len(order)), 1 << 60, np.int64)  # the least cost before a block of so many cells more than one
    high = np.zeros((most, len(order)), np.int64)  # the bound of that block
    if len(order):
        reach[0] = 0
    wide = cell * np.arange(most)[:, None]
    for i in range(int(cells[order[0]]) if len(order) else 0):
        n = np.searchsorted(-cells[order], -i, "left")
        here = first[order[:n]] + i
        high[1:, :n] = high[:-1, :n]
        high[0, :n] = 0
        np.maximum(high[:, :n], tops[here], out=high[:, :n])
        total = reach[:, :n] + (wide + lengths[here]) * high[:, :n]
        back[here] = best = total.argmin(0)
        reach[1:, :n] = reach[:-1, :n]
        reach[0, :n] = total[best, np.arange(n)] + cost
    last = np.zeros(len(owner), bool)
    going, begin = first + cells - 1, first
    while len(going):
        last[going] = True
        going = going - back[going] - 1
        going, begin = going[going >= begin], begin[going >= begin]
    ends = (at + lengths)[last]
    begins = np.concatenate([[0], ends[:-1]])
    return ends, np.maximum.reduceat(impacts, begins) if len(ends) else ends


def _pieces(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """values cut at ends, as binary."""
    at = np.concatenate([[0], ends]).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


class _Shard:
    """Documents of a shard in the making."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids, self.lengths, self.codes, self.bytes = [], [], [], 0

    def add(self, ids: list, texts: list[bytes]) -> None:
        words = [t.translate(WORDS_TABLE).split() for t in texts]
        self.bytes += sum(map(len, texts))
        for i, w in zip(ids, words, strict=True):
            if w:
                self.ids.append(NO_ID if i is None else i)
                self.lengths.append(len(w))
        encoded = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
        number = np.array([self.terms.setdefault(t, len(self.terms)) for t in encoded.dictionary.to_pylist()], np.int64)
        if len(number):
            self.codes.append(number[encoded.indices.to_numpy()])

    def rows(self, shard: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        ids, n = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        names = sorted(self.terms)
        rank = np.empty(len(names), np.int64)
        rank[[self.terms[t] for t in names]] = np.arange(len(names))
        keys, tf = np.unique(rank[np.concatenate(self.codes)] * len(ids) + np.repeat(place, n), return_counts=True)
        term, doc = np.divmod(keys, len(ids))
        m = 25 + (75 * n[order] * n_docs) // n_terms
        impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        starts = np.searchsorted(term, np.arange(len(names)))
        stops = np.append(starts[1:], len(keys))
        ends, bounds = cut_lists(starts, impacts)
        blocks = np.searchsorted(ends, stops, "right")
        local = ends - starts[term[ends - 1]]
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([b""]), pa.array([len(ids)], pa.int32()), pa.array([ids[order].tobytes()]), *[pa.array([b""])] * 3], schema=_FIELDS)
        columns = [pa.array(np.full(len(names), shard)), pa.array(names, pa.binary()), pa.array((stops - starts).astype(np.int32)), _pieces(doc.astype(np.uint16), stops), _pieces(impacts.astype(np.uint32), stops), _pieces(local.astype(np.uint16), blocks), _pieces(bounds.astype(np.uint32), blocks)]
        whole = pa.RecordBatch.from_arrays(columns, schema=_FIELDS)
        for i in range(0, len(names), 10_000):
            yield whole.slice(i, 10_000)


def _builder(n_docs: int, n_terms: int, shard_bytes: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for c in chunks(batch):
                for i in range(0, c.num_rows, shard_docs):
                    part = c.slice(i, shard_docs)
                    if shard.ids and (shard.bytes + part.column("text").nbytes > shard_bytes or len(shard.ids) + part.num_rows > shard_docs):
                        yield from shard.rows(number, n_docs, n_terms)
                        number, shard = number + 1, _Shard()
                    shard.add(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
        if shard.ids:
            yield from shard.rows(number, n_docs, n_terms)

    return run


def index(docs: DataFrame, size: tuple[int, int] | None = None, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs, written: a row for each shard and term (term empty: the shard's document ids). size: as corpus_size() counts it, if known."""
    n_docs, n_terms = size or corpus_size(docs, id_col, text_col)
    return written(doc_rows(docs, id_col, text_col).mapInArrow(_builder(n_docs, n_terms, shard_bytes, shard_docs), _INDEX))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for q, text in zip(batch.column("q").to_pylist(), batch.column("text").to_pylist(), strict=True):
            terms = Counter(text.translate(WORDS_TABLE).split())
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(terms), pa.int64()), pa.array(list(terms), pa.binary()), pa.array(list(terms.values()), pa.int64())], names=["q", "term", "times"])


class _Lists:
    """The posting lists of queried terms in a shard."""

    def __init__(self, table: pa.Table):
        self.ids, self.of = np.empty(0, np.int64), {}
        for term, *parts in zip(*(table.column(c).to_pylist() for c in ("term", "docs", "impacts", "ends", "bounds")), strict=True):
            if not term:
                self.ids = np.frombuffer(parts[0], np.int64)
                continue
            docs, impacts, ends, bounds = (np.frombuffer(p, kind) for p, kind in zip(parts, (np.uint16, np.uint32, np.uint16, np.uint32), strict=True))
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            self.of[term] = docs, impacts, docs[begins].astype(np.int64), docs[ends.astype(np.int64) - 1].astype(np.int64) + 1, bounds.astype(np.int64)

    def bounds(self, lists: list[tuple[int, tuple]]) -> np.ndarray:
        """For each document the sum of the weighted bounds of the blocks that span it."""
        change = np.zeros(len(self.ids) + 1, np.int64)
        weighted = np.concatenate([c * b for c, (_, _, _, _, b) in lists])
        np.add.at(change, np.concatenate([x[2] for _, x in lists]), weighted)
        np.subtract.at(change, np.concatenate([x[3] for _, x in lists]), weighted)
        return np.cumsum(change[:-1])

    @staticmethod
    def scores(lists: list[tuple[int, tuple]], docs: np.ndarray) -> np.ndarray:
        """The scores of docs, ascending places in the shard."""
        out, sought = np.zeros(len(docs), np.int64), docs.astype(np.uint16)
        for c, (own, impacts, *_) in lists:
            at = np.searchsorted(own, sought)
            at[at == len(own)] = 0
            out += np.where(own[at] == sought, c * impacts[at].astype(np.int64), 0)
        return out


def _best(shard: _Lists, terms: list[tuple[bytes, int]], floor: int, top: int, step: int = STEP) -> list[tuple[int, int]]:
    """The (score, place) of the top best documents of a shard with a score of at least floor; of equal scores the first places."""
    lists = [(c, shard.of[t]) for t, c in terms if t in shard.of]
    if not lists:
        return []
    bound = shard.bounds(lists)
    found: list[tuple[int, int]] = []

    def score(docs: np.ndarray) -> None:
        nonlocal found, floor
        scores = _Lists.scores(lists, docs)
        good = scores >= floor
        found = sorted([*found, *zip(scores[good].tolist(), docs[good].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:top]
        if len(found) == top:
            floor = max(floor, found[-1][0])

    floor = max(floor, 1)
    ahead = np.sort(np.argpartition(-bound, top * 3)[: top * 3]) if len(bound) > top * 3 else np.arange(len(bound))
    score(ahead[bound[ahead] >= floor])
    bound[ahead] = 0
    pivots = np.flatnonzero(bound >= floor)
    while len(pivots):
        score(pivots[:step])
        pivots = pivots[step:]
        pivots = pivots[bound[pivots] >= floor]
    return found


def _searcher(block, top: int):
    floors: dict[int, list[int]] = {}  # the best scores of each query in the shards that this task has seen

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard, out = _Lists(table), []
        for q, terms in block.value.items():
            best = floors.get(q, [])
            found = _best(shard, terms, best[-1] if len(best) == top else 1, top)
            if found:
                out += [(q, int(shard.ids[d]), s) for s, d in found]
                floors[q] = sorted(best + [s for s, _ in found], reverse=True)[:top]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=_FOUND_FIELDS)

    return run


def _blocks(pairs: DataFrame, query_pairs: int) -> Iterator[dict[int, list[tuple[bytes, int]]]]:
    """Whole queries with their weighted terms, as many as have query_pairs terms or just more."""
    held, n = {}, 0
    for row in pairs.orderBy("q").toLocalIterator():
        if row["q"] not in held and n >= query_pairs:
            yield held
            held, n = {}, 0
        held.setdefault(row["q"], []).append((bytes(row["term"]), row["weight"]))
        n += 1
    if held:
        yield held


def search(lists: DataFrame, queries: DataFrame, top: int = TOP, query_pairs: int = QUERY_PAIRS, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the top best documents of the index for each row of queries."""
    spark = lists.sparkSession
    items = queries.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    items = written(items)
    terms = written(items.select("q", "text").mapInArrow(_query_terms, "q long, term binary, times long"))
    docs = int(lists.where(F.octet_length("term") == 0).agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])
    df = lists.where(F.octet_length("term") > 0).select("term", "df").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * docs + 2.0)) / (2 * F.col("df") + 1))).cast("long")
    pairs = written(terms.join(df, "term").select("q", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"))
    found = None
    for block in _blocks(pairs, query_pairs):
        # At most query_pairs terms and those of one more query: a bounded broadcast.
        wanted = spark.createDataFrame([(t,) for t in {b"", *(t for q in block.values() for t, _ in q)}], "term binary")
        own = lists.join(F.broadcast(wanted), "term", "left_semi").groupBy("shard").applyInArrow(_searcher(spark.sparkContext.broadcast(block), top), _FOUND)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    ranked = found.select("*", rank.alias("rank")).where(F.col("rank") <= top)
    return ranked.join(items.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """The top best documents of docs for each row of queries."""
    return search(index(docs), queries, top)
