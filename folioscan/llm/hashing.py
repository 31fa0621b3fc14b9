"""XXH64 over many byte ranges of one buffer at once. The constants are those of the published XXH64 algorithm."""

from __future__ import annotations

import numpy as np

# Fixed values of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _view(buf: np.ndarray, kind: str) -> np.ndarray:
    """Unaligned loads: element i is the integer that starts at byte i."""
    width = np.dtype(kind).itemsize
    return np.ndarray((len(buf) - width + 1,), kind, buf, strides=(1,))


def _one_length(buf: np.ndarray, start: np.ndarray, length: int, seed: np.uint64) -> np.ndarray:
    u64, u32 = _view(buf, "<u8"), _view(buf, "<u4")
    at = 0
    if length >= 32:
        v = [np.full(len(start), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while at + 32 <= length:
            for i in range(4):
                v[i] = _rotl(v[i] + u64[start + (at + 8 * i)] * P2, 31) * P1
            at += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ (_rotl(x * P2, 31) * P1)) * P1 + P4
    else:
        h = np.full(len(start), seed + P5, np.uint64)
    h += np.uint64(length)
    while at + 8 <= length:
        h = _rotl(h ^ (_rotl(u64[start + at] * P2, 31) * P1), 27) * P1 + P4
        at += 8
    if at + 4 <= length:
        h = _rotl(h ^ (u32[start + at].astype(np.uint64) * P1), 23) * P2 + P3
        at += 4
    while at < length:
        h = _rotl(h ^ (buf[start + at].astype(np.uint64) * P5), 11) * P1
        at += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start[i]:end[i]] for every i. Ranges of one length are hashed together."""
    buf = np.frombuffer(data + b"\0" * 8, np.uint8)
    out = np.empty(len(start), np.uint64)
    lengths = end - start
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    edges = np.flatnonzero(np.diff(sorted_lengths)) + 1
    with np.errstate(over="ignore"):
        for idx in np.split(order, edges):
            if len(idx):
                out[idx] = _one_length(buf, start[idx], int(lengths[idx[0]]), np.uint64(seed))
    return out
