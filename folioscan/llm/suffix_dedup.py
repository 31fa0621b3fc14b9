"""Substring deduplication over suffixes, sorted by bucket-pointer refinement.

Every byte goes that is covered by a string of LENGTH bytes which also starts earlier. Suffixes are sorted to that depth
by bucket-pointer refinement: buckets by their first bytes, then each bucket with several members is sorted by the
bucket pointers of the suffixes a little later in the text, which refines the pointers that the next round reads.
Two strings are equal exactly if they end in one bucket.

Which suffixes can meet. All windows of LENGTH bytes that have the same smallest hash of a GRAM-byte substring form runs;
equal windows have equal smallest hashes, so only runs of one hash value need to be sorted together. A run whose value
turns up in no other run has no repeat and is never sent. The hash only decides who meets; equality is decided on bytes.

Scale. Documents are dealt to buckets of about BUCKET_BYTES by a hash of id and text (one exchange of the texts, read
three times). A bucket sends each hash value once, and each distinct run once, whatever the number of copies it holds: a
passage that a third of all documents share is a row per bucket, not per document. Where such a passage begins and ends,
though, runs differ from document to document and still have one hash value: the windows of values with HOT_RUNS runs or
more are therefore dealt out by a hash of their own bytes, each different window once per bucket. Answers go back to buckets as lists of places. A task holds
one bucket or one shard of runs; both sizes are parameters, to be raised with the executors' memory.

Cases. Null or empty text, or one below LENGTH bytes: nothing is removed. Null doc_id: before all others. Rows that share
a doc_id: documents of their own, in the order of the XXH64 of their texts; of equal rows one stays whole. Extra columns,
whatever their names, are not read. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import NO_ID, binary, doc_rows, total
from folioscan.llm.hashing import xxh64

LENGTH = 100
GRAM = 32
BUCKET_BYTES = 4 << 20
#: Documents' bytes for each shard in which runs meet.
SHARD_BYTES = 4 << 20
#: Runs of one hash value from which its windows are dealt out one by one, by their own content.
HOT_RUNS = 100_000
_SLICE = 1 << 16

_rng = np.random.default_rng(20240517)
_BYTE_HASH = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, 2**k, 2**64)) for k in range(6)]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every gram-byte substring; gram is a power of two."""
    h = _BYTE_HASH[data]
    width, k = 1, 0
    while width < gram:
        h = h[:-width] * _POWERS[k] + h[width:]
        width, k = 2 * width, k + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash value, first window, number of windows, whether it may repeat itself) of each run of windows that have one smallest hash.

    Windows lie within a document. A run may hold equal windows only if its smallest hash is at two places of one window or it is longer than a window has hashes.
    """
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    width = length - gram + 1
    low = np.uint64((1 << (width - 1).bit_length()) - 1)  # the low bits of a hash give way to its place
    least, several = np.empty(n, np.uint64), np.empty(n, bool)
    for a in range(0, n, _SLICE):
        b = min(n, a + _SLICE)
        h = _gram_hashes(data[a : b + length - 1], gram) & ~low
        place = np.arange(len(h), dtype=np.uint64) & low
        up, down = _sliding_min(h | place, width), _sliding_min(h | (low - place), width)
        least[a:b] = up & ~low
        several[a:b] = (up & low) != low - (down & low)
    least >>= np.uint64(int(low).bit_length())
    valid = np.zeros(n + 1, bool)
    for a, b in zip(starts.tolist(), ends.tolist()):
        valid[a : max(a, b - length + 1)] = True
    first = valid[:n].copy()
    first[1:] &= (least[1:] != least[:-1]) | ~valid[: n - 1]
    at = np.flatnonzero(first)
    last = valid[:n].copy()
    last[:-1] &= first[1:] | ~valid[1:n]
    count = np.flatnonzero(last) + 1 - at
    itself = np.logical_or.reduceat(several & valid[:n], at) if len(at) else np.empty(0, bool)
    return least[at], at, count, itself | (count > width)


def refine(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bucket pointers of all suffixes of some strings, sorted to depth bytes: equal for two suffixes of at least depth bytes exactly if those bytes are equal."""
    n = len(data)
    left = np.repeat(starts + lengths, lengths) - np.arange(n)  # bytes of its string from each position on
    pointer = np.full(n, -1, np.int64)
    q = 8
    at = np.flatnonzero(left >= q)
    padded = np.append(data, np.zeros(8, np.uint8))
    keys = np.ndarray((n,), ">u8", padded, strides=(1,))[at]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.append(True, keys[1:] != keys[:-1])
    pointer[at[order]] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while q < depth:
        step = min(q, depth - q)
        at = np.flatnonzero(left >= q + step)
        at = at[np.bincount(pointer[at], minlength=n)[pointer[at]] > 1]
        here, later = pointer[at], pointer[at + step]
        order = np.lexsort((later, here))
        at, here, later = at[order], here[order], later[order]
        bucket = np.append(True, here[1:] != here[:-1]) if len(at) else np.empty(0, bool)
        head = bucket.copy()
        head[1:] |= later[1:] != later[:-1]
        bucket_start = np.flatnonzero(bucket)[np.cumsum(bucket) - 1]
        pointer[at] = here + np.flatnonzero(head)[np.cumsum(head) - 1] - bucket_start
        q += step
    return pointer


def _bucket(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(names, texts, data, starts, ends) of a bucket's documents in their order; a name is the id and the hash of the text."""
    rows = sorted(zip([NO_ID if d is None else d for d in table.column("doc_id").to_pylist()], table.column("mark").to_pylist(), table.column("text").to_pylist()))
    texts = [t for *_, t in rows]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return np.array([r[:2] for r in rows], np.int64).reshape(-1, 2), texts, np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends


def _by_target(targets: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(targets, kind="stable")
    t = targets[order]
    return [(int(targets[idx[0]]), idx) for idx in np.split(order, np.flatnonzero(np.diff(t)) + 1) if len(idx)]


def _numbers(blobs: list[bytes], kind: type = np.int64, width: int = 1) -> np.ndarray:
    out = np.frombuffer(b"".join(blobs), kind)
    return out.reshape(-1, width) if width > 1 else out


def _send_values(shards: int, length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        _, _, data, starts, ends = _bucket(table)
        values, times = np.unique(runs(data, starts, ends, length, gram)[0], return_counts=True)
        times = np.minimum(times, 65_535).astype(np.uint16)
        parts = _by_target((values % np.uint64(shards)).astype(np.int64))
        blobs = lambda a: pa.array([binary(a[i]) for _, i in parts], pa.binary())
        return pa.table({"p": pa.array([p for p, _ in parts], pa.int32()), "g": pa.array([g] * len(parts), pa.int32()), "vals": blobs(values), "times": blobs(times)})

    return run


def _shared_values(hot_runs: int):
    """Answers each bucket with those of its values that another bucket has too, and whether they are hot."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("vals").to_pylist()
        values, times = _numbers(blobs, np.uint64), _numbers(table.column("times").to_pylist(), np.uint16)
        of = np.repeat(np.array(table.column("g").to_pylist(), np.int64), [len(b) // 8 for b in blobs])
        order = np.argsort(values, kind="stable")
        values, of, times = values[order], of[order], times[order].astype(np.int64)
        heads = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
        sizes = np.diff(np.append(heads, len(values)))
        shared = np.repeat(sizes > 1, sizes)
        hot = np.repeat(np.add.reduceat(times, heads) >= hot_runs, sizes) if len(heads) else shared
        values, hot = values[shared], hot[shared]
        parts = _by_target(of[shared])
        blobs_of = lambda a: pa.array([binary(a[i]) for _, i in parts], pa.binary())
        return pa.table({"g": pa.array([g for g, _ in parts], pa.int32()), "vals": blobs_of(values), "hot": blobs_of(hot)})

    return run


def _windows(contents: list[bytes], at: np.ndarray, count: np.ndarray, length: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The windows of some runs as runs of one window: (content, place, hash of the content)."""
    out, places = [], []
    for content, a, k in zip(contents, at.tolist(), count.tolist()):
        out += [content[j : j + length] for j in range(k)]
        places += range(a, a + k)
    ends = np.arange(1, len(out) + 1) * length
    return out, np.array(places, np.int64), xxh64(b"".join(out), ends - length, ends)


def _send_runs(shards: int, length: int, gram: int):
    """kind 0: repeats found inside the bucket (for the bucket g); kind 1: distinct runs for the shard in which they meet others."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        g = docs.column("g")[0].as_py()
        names, texts, data, starts, ends = _bucket(docs)
        values, at, count, itself = runs(data, starts, ends, length, gram)
        shared, hot = _numbers(answers.column("vals").to_pylist(), np.uint64), _numbers(answers.column("hot").to_pylist(), bool)
        hot = shared[hot]
        _, number, times = np.unique(values, return_inverse=True, return_counts=True)
        meets = np.isin(values, shared) if len(shared) else np.zeros(len(values), bool)
        again = (times[number] > 1) | itself
        doc = np.searchsorted(starts, at, "right") - 1
        # Empty documents share a start with the next one; the last of them is the one that holds the bytes.
        chosen = np.flatnonzero(meets | again)
        first: dict[bytes, None] = {}
        repeats, sent, contents = [], [], []
        raw = data.tobytes()
        for i, a, k in zip(chosen.tolist(), at[chosen].tolist(), count[chosen].tolist()):
            content = raw[a : a + k + length - 1]
            if content in first:
                repeats.append(i)
            else:
                first[content] = None
                sent.append(i)
                contents.append(content)
        rows: dict[str, list] = {"kind": [], "target": [], "g": [], "meta": [], "content": []}

        def add(kind: int, target: int, meta: np.ndarray, content: bytes | None) -> None:
            for k, v in zip(rows, (kind, target, g, binary(meta), content)):
                rows[k].append(v)

        if repeats:
            i = np.array(repeats)
            add(0, g, np.stack([doc[i], at[i] - starts[doc[i]], count[i]], 1), None)
        i = np.array(sent, np.int64)
        sends = [(at[i], count[i], values[i], itself[i], contents)]
        split = np.isin(values[i], hot) if len(hot) else np.zeros(len(i), bool)
        if split.any():
            whole, parts = np.flatnonzero(~split), np.flatnonzero(split)
            pieces, place, own_hash = _windows([contents[k] for k in parts.tolist()], at[i[parts]], count[i[parts]], length)
            # Pieces stand in the order of the bucket's documents: of equal ones the first is sent, the others repeat it.
            seen: dict[bytes, int] = {}
            leads = np.array([seen.setdefault(piece, k) == k for k, piece in enumerate(pieces)], bool)
            if not leads.all():
                again_at = place[~leads]
                d = np.searchsorted(starts, again_at, "right") - 1
                add(0, g, np.stack([d, again_at - starts[d], np.ones(len(again_at), np.int64)], 1), None)
            place, own_hash, pieces = place[leads], own_hash[leads], list(seen)
            sends = [(at[i[whole]], count[i[whole]], values[i[whole]], itself[i[whole]], [contents[k] for k in whole.tolist()]), (place, np.ones(len(place), np.int64), own_hash, np.zeros(len(place), bool), pieces)]
        for place, windows, value, again, texts_of in sends:
            of = np.searchsorted(starts, place, "right") - 1
            for p, own in _by_target((value % np.uint64(shards)).astype(np.int64)):
                meta = np.column_stack([names[of[own]], of[own], place[own] - starts[of[own]], windows[own], value[own].view(np.int64), again[own]])
                add(1, p, meta, b"".join(texts_of[o] for o in own.tolist()))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), types)})

    return run


def repeated_windows(keys: np.ndarray, contents: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(run, first window, windows) that also start earlier. keys: doc_id, hash of the text, document, offset, windows, hash value of each run, and whether it may repeat itself."""
    order = np.lexsort(keys[:, 3::-1].T)
    first: dict[bytes, int] = {}
    out, kept = [], []
    for i in order.tolist():
        if contents[i] in first:
            out.append((i, 0, int(keys[i, 4])))
        else:
            first[contents[i]] = i
            kept.append(i)
    kept_at = np.array(kept, np.int64)
    _, number, times = np.unique(keys[kept_at, 5], return_inverse=True, return_counts=True)
    kept_at = kept_at[(times[number] > 1) | (keys[kept_at, 6] > 0)]  # still in order of document and offset
    if not len(kept_at):
        return out
    sizes = np.array([len(contents[i]) for i in kept_at.tolist()], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contents[i] for i in kept_at.tolist()), np.uint8)
    pointer = refine(data, starts, sizes, length)
    count = keys[kept_at, 4]
    of = np.repeat(np.arange(len(kept_at)), count)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    # Runs of one document may overlap in order only by offset, so windows are ordered by document and place.
    rank = np.lexsort((keys[kept_at[of], 3] + offset, *keys[kept_at[of], 2::-1].T))
    bucket = pointer[starts[of] + offset]
    by = rank[np.argsort(bucket[rank], kind="stable")]
    later = np.append(False, bucket[by][1:] == bucket[by][:-1])
    hit = np.sort(by[later])
    if len(hit):
        new = np.append(True, (np.diff(hit) > 1) | (np.diff(of[hit]) > 0))
        heads = np.flatnonzero(new)
        for h, size in zip(hit[heads].tolist(), np.diff(np.append(heads, len(hit))).tolist()):
            out.append((int(kept_at[of[h]]), int(offset[h]), size))
    return out


def _meet(length: int):
    def run(table: pa.Table) -> pa.Table:
        own, metas = table.column("g").to_pylist(), table.column("meta").to_pylist()
        if not table.column("kind")[0].as_py():
            return pa.table({"g": pa.array(own, pa.int32()), "meta": pa.array(metas, pa.binary())})
        keys, contents, of = [], [], []
        for g, meta, content in zip(own, metas, table.column("content").to_pylist()):
            k = np.frombuffer(meta, np.int64).reshape(-1, 7)
            ends = np.cumsum(k[:, 4] + length - 1)
            contents += [content[b - s : b] for b, s in zip(ends.tolist(), (k[:, 4] + length - 1).tolist())]
            keys.append(k)
            of.append(np.full(len(k), g))
        keys, of = np.concatenate(keys), np.concatenate(of)
        found = np.array(repeated_windows(keys, contents, length), np.int64).reshape(-1, 3)
        places = np.stack([keys[found[:, 0], 2], keys[found[:, 0], 3] + found[:, 1], found[:, 2]], 1)
        parts = _by_target(of[found[:, 0]])
        return pa.table({"g": pa.array([g for g, _ in parts], pa.int32()), "meta": pa.array([binary(places[i]) for _, i in parts], pa.binary())})

    return run


def _remove(length: int, with_text: bool):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        names, texts, data, starts, ends = _bucket(docs)
        places = _numbers(found.column("meta").to_pylist(), np.int64, 3)
        edge = np.zeros(len(data) + 1, np.int32)
        at = starts[places[:, 0]] + places[:, 1]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + places[:, 2] + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed, spans, shas, kept_texts = [], [], [], []
        for text, a, b in zip(texts, starts.tolist(), ends.tolist()):
            own = gone[a:b]
            n = int(own.sum())
            kept = data[a:b][~own].tobytes() if n else text
            removed.append(n)
            spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
            shas.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept)
        columns = {"doc_id": pa.array([None if d == NO_ID else d for d in names[:, 0].tolist()], pa.int64()), "n_bytes": pa.array(ends - starts), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept_texts, pa.binary())} if with_text else {}))

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, hot_runs: int = HOT_RUNS, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and kept (the bytes that stay) if asked for; one row per row of docs."""
    if gram & (gram - 1) or gram > length:
        raise ValueError("gram must be a power of two of at most length")
    rows = doc_rows(docs, id_col, text_col)
    size = total(rows, F.octet_length("text"))
    buckets, shards = size // bucket_bytes + 1, size // shard_bytes + 1
    rows = rows.select("*", F.xxhash64("text").alias("mark"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("g"))
    values = rows.groupBy("g").applyInArrow(_send_values(shards, length, gram), "p int, g int, vals binary, times binary")
    shared = values.groupBy("p").applyInArrow(_shared_values(hot_runs), "g int, vals binary, hot binary")
    sent = rows.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_send_runs(shards, length, gram), "kind int, target int, g int, meta binary, content binary")
    found = sent.groupBy("kind", "target").applyInArrow(_meet(length), "g int, meta binary")
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(_remove(length, with_text), result)
