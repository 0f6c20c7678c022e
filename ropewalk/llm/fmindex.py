"""An FM-index over integer texts: suffix order, a wavelet matrix of packed bits over the BWT, and range minima."""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def suffix_order(texts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of the joined texts in order. ``ends`` marks the last symbol of each text, which is unlike
    any other, so comparisons stop there; by prefix doubling."""
    n = len(texts)
    rank = texts.astype(np.int64) + n
    rank[ends] = np.arange(int(ends.sum()))
    step = 1
    while True:
        key = rank * np.int64(2 * n + 2)
        key[:n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2


class Bits:
    """Packed bits with counts per word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (ONE << (at & 63).astype(np.uint64)) - ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Backward search over texts of words 1..sigma-1, with the smallest owner in any range of suffixes.

    ``symbols``: the texts, each closed by a 0. ``owner``: a number per symbol, that of its text."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray):
        order = suffix_order(symbols, symbols == 0)
        self.n, sigma = len(symbols), int(symbols.max()) + 1
        counts = np.bincount(symbols, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        bwt = symbols[order - 1]
        self.levels, self.zeros, depth = [], [], max(1, int(sigma - 1).bit_length())
        code, names = bwt.astype(np.int64), np.arange(sigma)
        base = np.zeros(sigma, np.int64)  # where a symbol's block begins below the last level
        for bit in range(depth - 1, -1, -1):
            ones = (code >> bit) & 1 == 1
            level = Bits(ones)
            zeros = int((~ones).sum())
            self.levels.append((bit, level))
            self.zeros.append(zeros)
            up = level.rank(base)
            base = np.where((names >> bit) & 1 == 1, zeros + up, base - up)
            code = np.concatenate([code[~ones], code[ones]])
        self.base = base
        self.minima = [owner[order].astype(np.int32)]
        width = 1
        while 2 * width <= self.n:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the BWT before ``at``."""
        for (bit, level), zeros in zip(self.levels, self.zeros):
            up = level.rank(at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + up, at - up)
        return at - self.base[symbol]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes after putting ``symbol`` in front."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.first[symbol], 2)
        return both[:len(lo)], both[len(lo):]

    def lowest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest owner in non-empty ranges."""
        width = hi - lo
        level = np.frexp(width.astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self.minima[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        return out


def reach(index: FMIndex, symbols: np.ndarray, own: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Matching statistics toward the left: for each query the smallest f >= begin such that the symbols f..end-1
    occur in a text of an owner below ``own``."""
    f = end.copy()
    live = np.arange(len(end))
    lo, hi = np.zeros(len(end), np.int64), np.full(len(end), index.n, np.int64)
    while len(live):
        lo, hi = index.extend(symbols[f[live] - 1], lo, hi)
        some = np.flatnonzero(lo < hi)
        some = some[index.lowest(lo[some], hi[some]) < own[live[some]]]
        f[live[some]] -= 1
        some = some[f[live[some]] > begin[live[some]]]
        live, lo, hi = live[some], lo[some], hi[some]
    return f


def earlier_windows(index: FMIndex, symbols: np.ndarray, start: np.ndarray, count: np.ndarray, own: np.ndarray,
                    width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``width`` symbols that also occur in a text of a smaller owner: (query, from, to) ranges of window
    numbers. A query is the ``count`` windows that begin at ``start`` onwards."""
    query, lo, hi = np.arange(len(start)), np.zeros(len(start), np.int64), count - 1
    found = []
    while len(query):
        at = start[query]
        f = reach(index, symbols, own[query], at + lo, at + hi + width) - at
        good = f <= hi
        found.append((query[good], f[good], hi[good]))
        # right of f all is found; when not even the last window is, it is left out and the rest is halved
        left = good & (f > lo)
        miss = ~good & (hi > lo)
        mid = (lo + hi) // 2
        query, lo, hi = (
            np.concatenate([query[left], query[miss], query[miss & (mid + 1 <= hi - 1)]]),
            np.concatenate([lo[left], lo[miss], mid[miss & (mid + 1 <= hi - 1)] + 1]),
            np.concatenate([f[left] - 1, np.minimum(mid, hi - 1)[miss], hi[miss & (mid + 1 <= hi - 1)] - 1]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
