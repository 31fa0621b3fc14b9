"""Benchmark decontamination with training suffix arrays.

Each task builds suffix arrays over the words of its shard of the training documents. Every suffix of every benchmark
item is looked up in each of them by binary search, which gives all places where it occurs verbatim for at least a
window's length, and, by going on from there, the longest match and its location. Documents with a match go.

Scale. The benchmark is a stated query set: it is read in blocks of bounded size, each broadcast, and every block meets
every shard; a total over MAX_BENCHMARK_BYTES raises an error rather than being cut. Documents are read once and not
shuffled at all, so neither a long document, a hot source nor a passage in a third of the rows gathers anywhere.
A suffix enters the array only if its first words open some window of the benchmark: no search for a whole window could
end at any other.

Cases. Null or wordless texts: no words, no hits. Null doc_id: a row like any other. Items with equal texts: each is
reported. A null item_id is reported as the empty string. Empty tables: no rows, or rows without hits. Repeated rows:
each is a row of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import WORDS_TABLE, chunks, doc_rows, total

WINDOW = 10
#: Words that a suffix must share with the head of some window to enter the array.
HEAD = 3
BLOCK_BYTES = 8 << 20
MAX_BENCHMARK_BYTES = 1 << 30

_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, longest_words long, longest_item string, longest_at long"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("longest_words", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64())])


class Suffixes:
    """The suffixes of one block of benchmark items that a window begins at, as word numbers (0: not a benchmark word)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        words = [t.translate(WORDS_TABLE).split() for _, t in items]
        vocabulary: dict[bytes, int] = {}
        for w in words:
            for x in w:
                vocabulary.setdefault(x, len(vocabulary) + 1)
        self.vocabulary, self.names, self.window = vocabulary, [i for i, _ in items], window
        self.text = np.array([n for w in words for n in [*(vocabulary[x] for x in w), 0]] + [0] * window, np.int64)
        start = np.cumsum([0] + [len(w) + 1 for w in words])
        suffixes = [(start[i] + j, min(window, len(w)), i) for i, w in enumerate(words) if w for j in range(max(1, len(w) - window + 1))]
        self.at, self.length, self.item = (np.array([s[k] for s in suffixes], np.int64) for k in range(3))

    def heads(self, text: np.ndarray, at: np.ndarray, head: int) -> np.ndarray:
        """The first head words of each suffix as one number."""
        base, code = np.int64(len(self.vocabulary) + 1), np.zeros(len(at), np.int64)
        for k in range(head):
            code = code * base + text[at + k]
        return code


def _keys(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The first depth words of each suffix as byte strings that sort as the words' numbers do."""
    return np.ascontiguousarray(text[at[:, None] + np.arange(depth)].astype(">u4")).view(f"S{4 * depth}").ravel()


def suffix_array(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions in the order of their suffixes (to depth words), and those suffixes."""
    keys = _keys(text, at, depth)
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def matches(text: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, test suffix, length): everywhere in text that a whole window of a test suffix occurs, and how far it goes on.

    text ends with at least one window of zeros.
    """
    none = np.empty(0, np.int64)
    if not len(tests.at):
        return none, none, none
    found = []
    for length in np.unique(tests.length):
        own = np.flatnonzero(tests.length == length)
        head = min(HEAD, int(length))
        wanted = np.unique(tests.heads(tests.text, tests.at[own], head))
        at = np.flatnonzero(text[: len(text) - tests.window])
        for k in range(1, head):
            at = at[text[at + k] > 0]
        codes = tests.heads(text, at, head)
        slot = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
        at, keys = suffix_array(text, at[wanted[slot] == codes], int(length))
        sought = _keys(tests.text, tests.at[own], int(length))
        low, high = np.searchsorted(keys, sought, "left"), np.searchsorted(keys, sought, "right")
        n = high - low
        found.append((at[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(own, n)))
    position, test = (np.concatenate(x) for x in zip(*found))
    size = tests.length[test].copy()
    going = np.arange(len(position))
    while len(going):
        a, b = text[position[going] + size[going]], tests.text[tests.at[test[going]] + size[going]]
        going = going[(a == b) & (a > 0)]
        size[going] += 1
    return position, test, size


def _scan(blocks: list, window: int):
    get = {}

    def digest(c: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.translate(WORDS_TABLE).split() for t in c.column("text").to_pylist()]
        counts = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(counts + window) - counts - window
        covered = np.zeros(int((counts + window).sum()) + window + 1, np.int32)
        pairs, longest = set(), {}
        for k, block in enumerate(blocks):
            tests = get.get(k) or get.setdefault(k, block.value)
            text = np.zeros(len(covered), np.int64)
            for w, s in zip(words, start):
                text[s : s + len(w)] = np.fromiter(map(tests.vocabulary.get, w, repeat(0)), np.int64, len(w))
            position, test, size = matches(text, tests)
            if len(position):
                np.add.at(covered, position, 1)
                np.add.at(covered, position + tests.length[test], -1)
                doc = np.searchsorted(start, position, "right") - 1
                for d, i in np.unique(np.stack([doc, tests.item[test]], 1), axis=0).tolist():
                    pairs.add((d, tests.names[i]) if tests.names[i] is not None else (d, ""))
                for j in np.lexsort((position, -size, doc)).tolist():
                    best = (int(size[j]), -int(position[j] - start[doc[j]]))
                    if best > longest.get(int(doc[j]), ((0, 0), ""))[0]:
                        longest[int(doc[j])] = (best, tests.names[tests.item[test[j]]])
        hit = np.add.reduceat((np.cumsum(covered) > 0).astype(np.int64), start) if len(start) else np.empty(0, np.int64)
        items: list[list[str]] = [[] for _ in words]
        for d, name in sorted(pairs):
            items[d].append(name)
        shas = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
        best = [longest.get(d, ((0, 0), None)) for d in range(len(words))]
        return pa.RecordBatch.from_arrays(
            [c.column("doc_id"), pa.array(counts), pa.array(hit), pa.array([len(i) for i in items], pa.int64()), pa.array(shas), pa.array(hit > 0), pa.array(items, pa.list_(pa.string())),
             pa.array([b[0][0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string()), pa.array([-b[0][1] if b[1] is not None else None for b in best], pa.int64())], schema=_OUT
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch):
                yield digest(c)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside a window of an item), n_items, items_sha256, contaminated,
    items (sorted as strings), longest_words, longest_item and longest_at (the longest verbatim match and its first word)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = total(items, F.octet_length("text"))
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes; at most {MAX_BENCHMARK_BYTES} can be sent to the tasks: call this for parts of it")
    blocks, held, bytes_held = [], [], 0
    for row in items.toLocalIterator():
        held.append((row["item"], bytes(row["text"])))
        bytes_held += len(held[-1][1])
        if bytes_held > BLOCK_BYTES:
            blocks.append(spark.sparkContext.broadcast(Suffixes(held, window)))
            held, bytes_held = [], 0
    blocks.append(spark.sparkContext.broadcast(Suffixes(held, window)))
    return doc_rows(docs, id_col, text_col).mapInArrow(_scan(blocks, window), _SCHEMA)
