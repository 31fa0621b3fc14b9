"""A bounded sample of labelled texts for fitting a classifier, and the calibration of its scores."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import doc_rows, written


def fold(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids have no fold."""
    return F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % mod


def within(sizes: list[tuple[int, int]], max_bytes: int) -> list[bool]:
    """For each (class, bytes), in order, whether it is taken.

    Each class may fill half of max_bytes, and what the other does not need. A text that does not fit is passed over; a
    class none of whose texts fits has its shortest.
    """
    needed = [sum(n for y, n in sizes if y == c) for c in (0, 1)]
    room = [max(max_bytes // 2, max_bytes - needed[1 - c]) for c in (0, 1)]
    taken = []
    for y, n in sizes:
        taken.append(n <= room[y])
        room[y] -= n if taken[-1] else 0
    for c in (0, 1):
        own = [i for i, (y, _) in enumerate(sizes) if y == c]
        if own and not any(taken[i] for i in own):
            taken[min(own, key=lambda i: sizes[i][1])] = True
    return taken


def sampled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: tuple[int, int], max_bytes: int) -> tuple[DataFrame, float]:
    """(y, place, doc_id, text) of a bounded sample, and the share of 1 among all usable labels.

    At most rows[y] texts with label y, the first in the order of a hash of their id, and at most about max_bytes of text
    in all, of which each class has its own part: see within(). Rows whose label is neither 0 nor 1 are not used. Equal
    texts of one class may stand on several rows: taken once, in the order of place, doc_id and text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(usable & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(7), "doc_id")
    first = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows[y]) for y in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # at most sum(rows) ids
    held = doc_rows(docs).join(chosen, "doc_id").select("y", "doc_id", order.alias("place"), "text", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha"))
    held = written(held)
    # Only sizes come to the driver before it is known which texts are taken.
    sizes = held.groupBy("y", "sha").agg(F.first("bytes").alias("bytes"), F.min(F.struct("place", "doc_id", "sha")).alias("at")).orderBy("at", "y").collect()
    picked = [(r["y"], r["sha"]) for r, t in zip(sizes, within([(r["y"], r["bytes"]) for r in sizes], max_bytes)) if t]
    wanted = held.sparkSession.createDataFrame(picked, "y int, sha string")
    taken = held.join(F.broadcast(wanted), ["y", "sha"]).select("y", "place", "doc_id", "text")
    return taken, counts.get(1, 0) / max(1, sum(counts.values()))


def distinct_texts(rows: Iterable[tuple[int, bytes]]) -> tuple[list[bytes], np.ndarray]:
    """(texts, 0/1 labels) from (y, text) in order, equal texts of one class once."""
    once = dict.fromkeys((y, bytes(text)) for y, text in rows)
    return [text for _, text in once], np.array([y for y, _ in once], np.float64)


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: tuple[int, int], max_bytes: int) -> tuple[list[bytes], np.ndarray, float]:
    """(texts, 0/1 labels, share) of sampled(), on the driver."""
    taken, share = sampled(docs, labels, label, usable, rows, max_bytes)
    ordered = taken.orderBy("place", "doc_id", "text").select("y", "text")
    return *distinct_texts((r["y"], r["text"]) for r in ordered.toLocalIterator()), share


def fitted_in_task(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: tuple[int, int], max_bytes: int, fit: Callable[[list[bytes], np.ndarray, float], Any]) -> Any:
    """fit(texts, labels, share) of sampled(), run in one task, which the sample's bound allows: the driver sees only the model, and a lost executor repeats the fit."""
    taken, share = sampled(docs, labels, label, usable, rows, max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (pair for b in batches for pair in zip(b.column("y").to_pylist(), b.column("text").to_pylist()))
        model = fit(*distinct_texts(pairs), share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    ordered = taken.repartition(1).sortWithinPartitions("place", "doc_id", "text").select("y", "text")
    model = ordered.mapInArrow(run, "model binary").first()
    return pickle.loads(model["model"]) if model else fit([], np.empty(0), share)


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2) -> np.ndarray:
    """Weights (intercept first) of a logistic regression by Newton steps; the intercept is moved to a population in which share are 1."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) / len(y) - ridge * np.append(0, w[1:])
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(y) + ridge * np.diag(np.append(0, np.ones(len(w) - 1)))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    own, share = y.mean(), np.clip(share, 1e-4, 1 - 1e-4)
    w[0] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ w, -30, 30)))
