"""Elias-Fano sequences and a two-level n-gram trie on them, vectorised over numpy arrays in one memory map."""

from __future__ import annotations

import mmap

import numpy as np

_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.array([[next((p for p in range(8) if i >> p & 1 and bin(i & ((1 << p) - 1)).count("1") == r), 0) for r in range(8)] for i in range(256)], np.uint8)
_ALL = np.uint64(2**64 - 1)


#: Words between two entries of a directory: both directories take an eighth of what they index.
STRIDE = 8


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits (0 or 1) as little-endian words with one spare word at least, in whole strides."""
    out = np.zeros(-(-(len(bits) // 64 + 2) // STRIDE) * STRIDE, np.uint64)
    packed = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[:len(packed)] = packed
    return out


class EliasFano:
    """A sorted sequence below `universe`: the low bits of each value as they are, the high parts in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n = n
        self.low_bits = max(0, int(max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        unary = np.zeros(n + (universe >> self.low_bits) + 2, np.uint8)
        unary[high + np.arange(n)] = 1
        self.high = _words(unary)
        bits = np.zeros((n, self.low_bits), np.uint8)
        for b in range(self.low_bits):
            bits[:, b] = (values >> np.uint64(b)).astype(np.uint8) & 1
        self.low = _words(bits.reshape(-1))
        self._directories()

    def _directories(self) -> None:
        """Ones and zeros before every stride of words."""
        ones = np.bitwise_count(self.high).reshape(-1, STRIDE).sum(1, dtype=np.int64)
        before = np.cumsum(ones) - ones
        kind = np.uint32 if len(self.high) < 1 << 26 else np.int64
        self.ones, self.zeros = before.astype(kind), (np.arange(len(ones)) * 64 * STRIDE - before).astype(kind)

    def arrays(self) -> list[str]:
        return ["high", "low", "ones", "zeros"]

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the rank-th one (or zero), ranks from 0: its stride, its word there, its byte, its bit."""
        directory = self.ones if ones else self.zeros
        stride = np.searchsorted(directory, rank, "right") - 1
        left = rank.astype(np.int64) - directory[stride].astype(np.int64)
        row = np.arange(len(stride))
        words = self.high.reshape(-1, STRIDE)[stride]
        if not ones:
            words = words ^ _ALL
        sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = np.minimum((sums <= left[:, None]).sum(1), STRIDE - 1)
        left -= np.where(word > 0, sums[row, word - 1], 0)
        by = np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(_BITS[by], axis=1, dtype=np.int64)
        byte = np.minimum((sums <= left[:, None]).sum(1), 7)
        left -= np.where(byte > 0, sums[row, byte - 1], 0)
        return (stride * STRIDE + word) * 64 + byte * 8 + _SELECT[by[row, byte], np.minimum(left, 7)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = self.low[word] >> shift
        second = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | second) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of each value of x (inside [first, last) if given), or -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        high, low = (x >> np.uint64(self.low_bits)).astype(np.int64), x & np.uint64((1 << self.low_bits) - 1)
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        end = self._select(high, False) - high
        if first is not None:
            start, end = np.maximum(start, first), np.minimum(end, last)
        lo, hi = start.copy(), end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # values of one high part are sorted by their low bits, and may be many where a context is dense
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < low[open_]
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
            open_ = open_[lo[open_] < hi[open_]]
        inside = np.flatnonzero(lo < end)
        hit = inside[self._low(lo[inside]) == low[inside]]
        out[hit] = lo[hit]
        return out


class Trie:
    """Contexts, monotone pointers to their successors, successors relative to their context, and a quantised number for each.

    `keys` are sorted distinct context << 32 | successor. Numbers are held as 8-bit codes of a logarithmic scale. All levels lie
    in one anonymous memory map.
    """

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        context, successor = keys >> np.uint64(32), keys & np.uint64(2**32 - 1)
        contexts, starts = np.unique(context, return_index=True)
        names, relative = np.unique(successor, return_inverse=True)
        self.width = max(1, len(names))
        top = lambda v: int(v[-1]) + 1 if len(v) else 1
        self.contexts, self.names = EliasFano(contexts, top(contexts)), EliasFano(names, top(names))
        self.pointers = EliasFano(np.append(starts, len(keys)).astype(np.uint64), len(keys) + 1)
        owner = np.repeat(np.arange(len(contexts)), np.diff(np.append(starts, len(keys))))
        self.successors = EliasFano((owner * self.width + relative).astype(np.uint64), max(1, len(contexts)) * self.width)
        logs = np.log10(np.maximum(numbers, 1e-300))
        self.least, most = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        self.step = max((most - self.least) / 255, 1e-12)
        self.codes = np.rint((logs - self.least) / self.step).astype(np.uint8)
        self._map()

    def _map(self) -> None:
        """Moves every level's arrays into the memory map."""
        places = [(level, name) for level in (self.contexts, self.names, self.pointers, self.successors) for name in level.arrays()] + [(self, "codes")]
        self.bytes = sum(-(-getattr(o, n).nbytes // 8) * 8 for o, n in places)
        self.memory = mmap.mmap(-1, max(1, self.bytes))
        at = 0
        for owner, name in places:
            old = getattr(owner, name)
            new = np.frombuffer(self.memory, old.dtype, len(old), at)
            new[:] = old
            setattr(owner, name, new)
            at += -(-old.nbytes // 8) * 8

    def look_up(self, keys: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
        """The number of each key, 0 where the trie lacks it."""
        out = np.zeros(len(keys))
        for start in range(0, len(keys), piece):
            part = keys[start:start + piece]
            # sorted keys come in runs of one context, which is looked up once
            wanted, run = np.unique(part >> np.uint64(32), return_inverse=True)
            context = self.contexts.find(wanted)
            held = np.maximum(context, 0)
            first, last = (self.pointers.access(held + k).astype(np.int64) for k in (0, 1))
            known = np.flatnonzero(context[run] >= 0)
            relative = self.names.find(part[known] & np.uint64(2**32 - 1))
            known, relative = known[relative >= 0], relative[relative >= 0]
            if not len(known):
                continue
            own = run[known]
            at = self.successors.find((context[own] * self.width + relative).astype(np.uint64), first[own], last[own])
            found = at >= 0
            out[start + known[found]] = 10 ** (self.least + self.codes[at[found]] * self.step)
        return out
