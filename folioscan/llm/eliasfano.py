"""Elias-Fano sequences and an n-gram trie of them, in one memory map."""

from __future__ import annotations

import mmap

import numpy as np


def _map(size: int, path: str | None = None) -> mmap.mmap:
    """Memory for some levels: anonymous, or a file if a path is given."""
    if path is None:
        return mmap.mmap(-1, max(1, size))
    with open(path, "w+b") as f:
        f.truncate(max(1, size))
        return mmap.mmap(f.fileno(), max(1, size))


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Position of the i-th (from 0) set bit; before[k]: set bits in front of word k."""
    at = np.searchsorted(before, i, "right") - 1
    rest = i - before[at]
    word, position = words[at], np.zeros(len(at), np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count((word >> position) & np.uint64((1 << step) - 1)).astype(np.int64)
        go = rest >= ones
        position += np.where(go, np.uint64(step), np.uint64(0))
        rest -= np.where(go, ones, 0)
    return at * 64 + position.astype(np.int64)


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The values side by side, bits each, in 64-bit words."""
    n = len(values)
    words = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
    if bits and n:
        offset = np.arange(n, dtype=np.int64) * bits
        at, shift = offset >> 6, (offset & 63).astype(np.uint64)
        heads = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        words[at[heads]] = np.bitwise_or.reduceat(values << shift, heads)
        over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
        words[at[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return words


class EliasFano:
    """A monotone sequence: low bits packed, high parts in unary, about 2 + log2(range / length) bits each."""

    def __init__(self, values: np.ndarray, keep=None):
        """keep(array): where the packed arrays live; values are non-negative and never fall."""
        keep = keep or (lambda a: a)
        values = values.astype(np.uint64)
        self.n = n = len(values)
        self.top = top = int(values[-1]) if n else -1
        self.low_bits = l = max(0, (max(0, top) // max(1, n)).bit_length() - 1)
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        length = (max(0, top) >> l) + n + 1
        bits = np.zeros((length + 63) // 64 * 64, np.uint8)
        bits[ones] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        self.high = keep(words)
        self.ones_before = keep(np.cumsum(counts) - counts)
        self.zeros_before = keep(np.cumsum(64 - counts) - (64 - counts))
        self.low = keep(_packed(values & np.uint64((1 << l) - 1), l))

    def _low(self, i: np.ndarray) -> np.ndarray:
        l = self.low_bits
        if not l:
            return np.zeros(len(i), np.uint64)
        bit = i * l
        at, shift = bit >> 6, (bit & 63).astype(np.uint64)
        # Two shifts, so that a shift by 64 cannot occur.
        value = (self.low[at] >> shift) | ((self.low[at + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        return value & np.uint64((1 << l) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = _select(self.high, self.ones_before, i) - i
        return ((high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, value) of the first element at or above each x; index n and value -1 if there is none.

        The high part of x leads to the elements that share it; a binary search among their low parts decides.
        """
        x = np.asarray(x, np.int64)
        index, value = np.full(len(x), self.n, np.int64), np.full(len(x), -1, np.int64)
        asked = np.flatnonzero(x <= self.top)
        if not len(asked):
            return index, value
        high, low = x[asked] >> self.low_bits, (x[asked] & ((1 << self.low_bits) - 1)).astype(np.uint64)
        # Runs of one high part are looked up once.
        head = np.append(True, high[1:] != high[:-1])
        own = high[head]
        bound = np.zeros((2, len(own)), np.int64)
        inner = own > 0
        bound[0, inner] = _select(~self.high, self.zeros_before, own[inner] - 1) + 1 - own[inner]
        bound[1] = _select(~self.high, self.zeros_before, own) - own
        run = np.cumsum(head) - 1
        first, last = bound[0][run], bound[1][run]
        end = last.copy()
        going = np.flatnonzero(first < last)
        while len(going):
            mid = (first[going] + last[going]) >> 1
            below = self._low(mid) < low[going]
            first[going[below]] = mid[below] + 1
            last[going[~below]] = mid[~below]
            going = going[first[going] < last[going]]
        index[asked] = first
        inside = first < end
        value[asked[inside]] = (high[inside] << self.low_bits) | self._low(first[inside]).astype(np.int64)
        beyond = asked[~inside]
        value[beyond] = self[index[beyond]]
        return index, value


class Trie:
    """An n-gram trie of two levels: contexts, and below each its successors.

    Contexts and pointers are monotone. Successors are kept relative to their context: to each is added the last value of
    the context before, which makes the whole level one monotone sequence. Probabilities are codes of a fixed grid.
    """

    #: Codes for each factor of ten.
    GRID = 256

    def __init__(self, contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, probability: np.ndarray, backoff: np.ndarray, path: str | None = None):
        """contexts: rising; pointers: first successor of each, and their number; successors: rising below each context."""
        first = np.zeros(len(contexts), np.int64)
        if len(contexts):
            last = successors[pointers[1:] - 1]
            first[1:] = np.cumsum(last)[:-1]
        relative = successors + np.repeat(first, np.diff(pointers))
        parts: list[np.ndarray] = []
        build = lambda keep: (EliasFano(contexts, keep), EliasFano(pointers, keep), EliasFano(relative, keep), EliasFano(first, keep), keep(self.code(probability)), keep(self.code(backoff)))
        build(lambda a: parts.append(a) or a)
        memory, at = _map(sum(-(-a.nbytes // 8) * 8 for a in parts), path), 0

        def place(a: np.ndarray) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(memory, a.dtype, a.size, at) if a.size else a
            if a.size:
                memory[at : at + a.nbytes] = a.tobytes()
                at += -(-a.nbytes // 8) * 8
            return out

        self.contexts, self.pointers, self.successors, self.first, self.probability, self.backoff = build(place)

    @classmethod
    def code(cls, p: np.ndarray) -> np.ndarray:
        """0 for a probability of 0, else 1 + its rounded negative logarithm on the grid."""
        with np.errstate(divide="ignore"):
            grid = np.rint(-np.log10(p) * cls.GRID)
        return np.where(p > 0, np.minimum(grid, 65_000) + 1, 0).astype(np.uint16)

    @classmethod
    def decode(cls, code: np.ndarray) -> np.ndarray:
        return np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) / cls.GRID), 0.0)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of the word's probability after the context, code of the context's backoff); 0 where there is none."""
        p, b = np.zeros(len(context), np.uint16), np.zeros(len(context), np.uint16)
        head = np.append(True, context[1:] != context[:-1]) if len(context) else np.empty(0, bool)
        run = np.cumsum(head) - 1
        at, value = self.contexts.successor(context[head])
        known = np.flatnonzero((value == context[head])[run])
        begin, end = (np.zeros(len(at), np.int64) for _ in range(2))
        found = np.flatnonzero(value == context[head])
        begin[found], end[found] = self.pointers[at[found]], self.pointers[at[found] + 1]
        begin, end, at = begin[run[known]], end[run[known]], at[run[known]]
        b[known] = self.backoff[at]
        sought = self.first[at] + word[known]
        index, value = self.successors.successor(sought)
        hit = (value == sought) & (index >= begin) & (index < end)
        # Where one context's last value equals the next one's first, the search stops at the earlier of the two.
        late = np.flatnonzero((value == sought) & (index < begin))
        if len(late):
            same = self.successors[np.minimum(begin[late], self.successors.n - 1)] == sought[late]
            index[late[same]], hit[late[same]] = begin[late[same]], True
        p[known[hit]] = self.probability[index[hit]]
        return p, b
