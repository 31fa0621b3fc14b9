"""Language-model scores from an Elias-Fano n-gram trie.

The model is a bigram model with absolute discounting, interpolated with the smoothed unigram distribution:
p(w | h) = max(c(h w) - D, 0) / c(h) + D n(h) / c(h) p(w), p(w) = (c(w) + 1/2) / (N + (V + 1) / 2). A text starts with a
start mark and ends with an end token. Discounted probabilities and the weights of the unigram part are quantised on a
fixed grid and kept in tries whose contexts, pointers and context-relative successors are Elias-Fano coded in a memory
map; they are queried by successor search. V is counted over all words before any text is scored, so a score depends on
the rows alone, not on how they are dealt.

Scale. Documents are dealt to buckets of about BUCKET_BYTES by id and text (one exchange of the texts, read three times).
Each bucket sends its distinct words with their counts to word shards, which answer with numbers and corpus counts, then
its distinct bigrams to bigram shards, which build their trie and answer with codes, in the order asked. A very common
word or bigram is a row per bucket. Bigrams go to the shard of their first word; those of a word that stands HOT times or
more (or of the start mark) are dealt on to one shard per HOT times by their second word, and each part answers with the
number of successors it holds, which the bucket adds up. The model is never gathered in one place, and everything sent
grows with the input. Words are told apart by 64-bit hashes (XXH64).

Cases. Null or empty text: one token, the end. Null doc_id: learned from, held_out false. Repeated rows: each counts and
is scored. Empty table: no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import doc_rows
from folioscan.llm.eliasfano import Trie
from folioscan.llm.hashing import xxh64

BUCKET_BYTES = 4 << 20
SHARD_BYTES = 24 << 20
DISCOUNT = 0.75
#: Occurrences of a first word for each part that its bigrams are dealt to; at least a PARTS-th of all tokens.
HOT = 1_000_000
PARTS = 16_384
#: Numbers of no word, of the start mark; words begin at FIRST. The end token's text cannot be a word.
UNKNOWN, START, FIRST = 0, 1, 2
_END = b" "


def pack(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    a = np.ascontiguousarray(a, "<i8")
    return zstandard.compress(a.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


class Bucket:
    """The tokens of a bucket's texts as places in its own vocabulary, which is in order of the words' hashes."""

    def __init__(self, texts: list[bytes]):
        split = [t.lower().split() for t in texts]
        flat = list(chain.from_iterable(split))
        words = [_END, *dict.fromkeys(flat)]
        number = dict(zip(words, range(len(words))))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        hashes = xxh64(b"\n".join(words), ends - sizes, ends, 42)
        self.hashes, place = np.unique(hashes, return_inverse=True)
        self.counts = np.fromiter(map(len, split), np.int64, len(split)) + 1
        self.last = np.cumsum(self.counts) - 1
        inner = np.ones(int(self.counts.sum()), bool)
        inner[self.last] = False
        self.tokens = np.full(len(inner), place[0])
        self.tokens[inner] = place[np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))]
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(previous, word, which of them each token is): the distinct bigrams; -1 stands for the start mark."""
        before = np.append(-1, self.tokens[:-1])
        before[self.last[:-1] + 1] = -1
        keys, which = np.unique((before + 1) * np.int64(len(self.hashes)) + self.tokens, return_inverse=True)
        return keys // len(self.hashes) - 1, keys % len(self.hashes), which


def _split(targets: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(targets, kind="stable")
    return [(int(targets[i[0]]), i) for i in np.split(order, np.flatnonzero(np.diff(targets[order])) + 1) if len(i)]


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(schema.items())})


def _texts(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """Rows in a fixed order, so that each reading of a bucket gives the same."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("learn").to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "learn": pa.array([r[2] for r in rows], pa.bool_())}), [r[1] for r in rows], np.array([r[2] for r in rows], bool)


_WORDS = {"p": pa.int32(), "g": pa.int32(), "hashes": pa.binary(), "counts": pa.binary()}
_NUMBERS = {"g": pa.int32(), "p": pa.int32(), "known": pa.int64(), "numbers": pa.binary(), "counts": pa.binary()}
_PAIRS = {"kind": pa.int32(), "target": pa.int32(), "g": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "hot": pa.binary()}
_CODES = {"kind": pa.int32(), "g": pa.int32(), "source": pa.int32(), "a": pa.binary(), "b": pa.binary(), "hot": pa.binary()}


def _ddl(schema: dict[str, pa.DataType]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{k} {names[t]}" for k, t in schema.items())


def _send_words(shards: int):
    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        _, texts, learn = _texts(table)
        bucket = Bucket(texts)
        counts = np.bincount(bucket.tokens[learn[bucket.doc]], minlength=len(bucket.hashes))
        return _table(_WORDS, [(p, g, pack(bucket.hashes[i].view(np.int64)), pack(counts[i])) for p, i in _split((bucket.hashes % np.uint64(shards)).astype(np.int64))])

    return run


def _number_words(shards: int):
    def run(table: pa.Table) -> pa.Table:
        p, g = table.column("p")[0].as_py(), table.column("g").to_pylist()
        hashes = [unpack(b).view(np.uint64) for b in table.column("hashes").to_pylist()]
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(place, np.concatenate([unpack(b) for b in table.column("counts").to_pylist()]), len(words)).astype(np.int64)
        known = counts > 0
        numbers = np.where(known, FIRST + (np.cumsum(known) - 1) * shards + p, UNKNOWN)
        edges = np.cumsum([0] + [len(h) for h in hashes])
        return _table(_NUMBERS, [(own, p, int(known.sum()), pack(numbers[place[a:b]]), pack(counts[place[a:b]])) for own, a, b in zip(g, edges[:-1].tolist(), edges[1:].tolist())])

    return run


def _gathered(bucket: Bucket, shards: int, answers: dict[int, bytes]) -> np.ndarray:
    """Answers of the word shards in the order of the bucket's vocabulary."""
    out = np.zeros(len(bucket.hashes), np.int64)
    for p, i in _split((bucket.hashes % np.uint64(shards)).astype(np.int64)):
        out[i] = unpack(answers[p])
    return out


class Asked:
    """Which bigrams of a bucket go to which shard, and which hot contexts it asks each shard about."""

    def __init__(self, bucket: Bucket, before: np.ndarray, word: np.ndarray, counts: np.ndarray, shards: int, starts: int, hot: int):
        n = np.where(before < 0, starts, counts[before])
        head = np.where(before < 0, np.uint64(0x5D1F), bucket.hashes[before])
        parts = 1 + n // hot
        part = (bucket.hashes[word] % parts.astype(np.uint64)).astype(np.int64)
        home = self.home(head, part, shards)
        asked = np.flatnonzero((before < 0) | (counts[before] > 0))
        self.bigrams = {s: asked[i] for s, i in _split(home[asked])}
        #: A bigram of each hot context, its occurrences, and the shards that hold a part of it.
        hot_at = np.flatnonzero(np.append(True, before[1:] != before[:-1]) & (parts > 1)) if len(before) else np.empty(0, np.int64)
        self.total = n
        self.hot: dict[int, list[int]] = {}
        for i in hot_at.tolist():
            for s in np.unique(self.home(np.repeat(head[i], parts[i]), np.arange(parts[i]), shards)).tolist():
                self.hot.setdefault(s, []).append(i)

    @staticmethod
    def home(head: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((head + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)

    def shards(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, bigrams, bigrams that stand for hot contexts)."""
        none = np.empty(0, np.int64)
        return [(s, self.bigrams.get(s, none), np.array(self.hot.get(s, []), np.int64)) for s in sorted(self.bigrams.keys() | self.hot.keys())]


def _send_pairs(word_shards: int, shards: int, starts: int, hot: int):
    """kind 0: the word counts, for the bucket itself; kind 1: bigrams for a shard."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        g = docs.column("g")[0].as_py()
        _, texts, learn = _texts(docs)
        bucket = Bucket(texts)
        p, n, c = (answers.column(k).to_pylist() for k in ("p", "numbers", "counts"))
        numbers, counts = _gathered(bucket, word_shards, dict(zip(p, n))), _gathered(bucket, word_shards, dict(zip(p, c)))
        before, word, which = bucket.pairs()
        seen = np.bincount(which[learn[bucket.doc]], minlength=len(before))
        first = np.where(before < 0, START, numbers[before])
        asked = Asked(bucket, before, word, counts, shards, starts, hot)
        rows = [(0, g, g, pack(counts), None, None, None)]
        rows += [(1, s, g, pack(first[i]), pack(numbers[word[i]]), pack(seen[i]), pack(np.concatenate([first[h], asked.total[h]]))) for s, i, h in asked.shards()]
        return _table(_PAIRS, rows)

    return run


def build_trie(context: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float = DISCOUNT, path: str | None = None, totals: dict[int, int] | None = None) -> Trie:
    """A trie of counted bigrams in order of context and word, with discounted probabilities and unigram weights.

    totals: occurrences of those contexts of which other shards hold a part.
    """
    heads = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.empty(0, np.int64)
    pointers = np.append(heads, len(context)).astype(np.int64)
    kinds = np.diff(pointers)
    sums = np.add.reduceat(count, heads) if len(heads) else np.empty(0, np.int64)
    if totals:
        sums = np.array([totals.get(c, n) for c, n in zip(context[heads].tolist(), sums.tolist())], np.int64)
    probability = np.maximum(count - discount, 0) / np.repeat(sums, kinds)
    return Trie(context[heads], pointers, word, probability, np.minimum(discount * kinds / np.maximum(sums, 1), 1.0), path)


def _answer_pairs(discount: float):
    def run(table: pa.Table) -> pa.Table:
        g = table.column("g").to_pylist()
        if not table.column("kind")[0].as_py():
            return _table(_CODES, [(0, own, 0, a, None, None) for own, a in zip(g, table.column("a").to_pylist())])
        s = table.column("target")[0].as_py()
        contexts, words, counts = ([unpack(b) for b in table.column(k).to_pylist()] for k in ("a", "b", "c"))
        edges = np.cumsum([0] + [len(c) for c in contexts])
        context, word, count = np.concatenate(contexts), np.concatenate(words), np.concatenate(counts)
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        head = np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]))[: len(context)]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(head) - 1
        context, word = context[head], word[head]
        count = np.bincount(place, count, len(context)).astype(np.int64)
        seen = (count > 0) & (word != UNKNOWN)
        asked = [unpack(h).reshape(2, -1) for h in table.column("hot").to_pylist()]
        totals = dict(zip(np.concatenate([h[0] for h in asked]).tolist(), np.concatenate([h[1] for h in asked]).tolist()))
        p, b = build_trie(context[seen], word[seen], count[seen], discount, totals=totals).find(context, word)
        held = context[seen]
        kinds = [np.searchsorted(held, h[0], "right") - np.searchsorted(held, h[0], "left") for h in asked]
        return _table(_CODES, [(1, own, s, pack(p[place[i:j]]), pack(b[place[i:j]]), pack(k)) for own, i, j, k in zip(g, edges[:-1].tolist(), edges[1:].tolist(), kinds)])

    return run


def _score(shards: int, train_tokens: int, starts: int, hot: int, discount: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        table, texts, learn = _texts(docs)
        bucket = Bucket(texts)
        kind, source, a, b = (answers.column(k).to_pylist() for k in ("kind", "source", "a", "b"))
        counts = unpack(a[kind.index(0)])
        vocabulary = answers.column("v")[0].as_py()
        unigram = (counts + 0.5) / (train_tokens + 0.5 * (vocabulary + 1))
        before, word, which = bucket.pairs()
        p, weight = np.zeros(len(before)), np.ones(len(before))
        codes = {s: xyz for k, s, *xyz in zip(kind, source, a, b, answers.column("hot").to_pylist()) if k}
        asked, successors = Asked(bucket, before, word, counts, shards, starts, hot), np.zeros(len(before), np.int64)
        for s, i, h in asked.shards():
            x, y, z = (unpack(c) for c in codes[s])
            p[i] = Trie.decode(x)
            weight[i] = np.where(y > 0, Trie.decode(y), 1.0)
            successors[h] += z
        head = np.append(True, before[1:] != before[:-1]) if len(before) else np.empty(0, bool)
        successors = successors[head][np.cumsum(head) - 1]
        split = successors > 0  # contexts in parts: the weight follows from the sum of their answers
        weight[split] = Trie.decode(Trie.code(np.minimum(discount * successors[split] / asked.total[split], 1.0)))
        pair = np.log10(p + weight * unigram[word])
        n = len(texts)
        sums = lambda v: np.bincount(bucket.doc, v, n)
        token_counts = counts[bucket.tokens]
        out = {
            "doc_id": table.column("doc_id"),
            "held_out": pa.array(~learn),
            "n_tokens": pa.array(bucket.counts),
            "n_known": pa.array(sums(token_counts > 0).astype(np.int64)),
            "base_score": pa.array(sums(np.log10(unigram)[bucket.tokens])),
            "score": pa.array(sums(pair[which])),
        }
        return pa.table(out)

    return run


def lm_score(docs: DataFrame, folds: int = 5, held_out: int = 1, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, discount: float = DISCOUNT, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    Learns from the documents whose fold (crc32 of the id as text, modulo folds) is not held_out. base_score: log10 of
    the smoothed unigram probability; score: log10 of the bigram model's.
    """
    rows = doc_rows(docs, id_col, text_col)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out, F.lit(True))
    n_words = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]++"))
    totals = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.when(learn, n_words + 1)), F.lit(0)), F.count_if(learn)).first()
    size, train_tokens, starts = (int(x) for x in totals)
    buckets, shards, hot = size // bucket_bytes + 1, size // shard_bytes + 1, max(hot, train_tokens // PARTS)
    rows = rows.select("*", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("g"), learn.alias("learn"))
    words = rows.groupBy("g").applyInArrow(_send_words(shards), _ddl(_WORDS))
    numbers = words.groupBy("p").applyInArrow(_number_words(shards), _ddl(_NUMBERS))
    vocabulary = numbers.select("p", "known").distinct().agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v"))
    pairs = rows.groupBy("g").cogroup(numbers.groupBy("g")).applyInArrow(_send_pairs(shards, shards, starts, hot), _ddl(_PAIRS))
    codes = pairs.groupBy("kind", "target").applyInArrow(_answer_pairs(discount), _ddl(_CODES))
    codes = codes.join(F.broadcast(vocabulary))  # one row of one number
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = rows.groupBy("g").cogroup(codes.groupBy("g")).applyInArrow(_score(shards, train_tokens, starts, hot, discount), result)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
