"""Flat arrays of words and shingles for many texts at once.

All helpers take an Arrow string array and work on its byte buffer with numpy; no loop runs per
word. A word is a run of bytes outside space, tab, LF, VT, FF and CR, so the cut never falls inside a
code point. Null texts count as empty. Memory is about 50 bytes per byte of the chunk, and a chunk
is ``CHUNK`` bytes of text or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (BASE is odd, so it has an inverse)."""
    usual = CHUNK + (CHUNK >> 2)
    if _powers and n <= usual:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, usual)
    with np.errstate(over="ignore"):
        up = np.full(size, BASE)
        down = np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)))
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
    if size == usual:  # tables for one long text are not kept
        _powers[:] = [up, down]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a chunk: ``offsets[i]:offsets[i+1]`` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    prefixes: list[np.ndarray] = field(default_factory=list)


def text_chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an array into runs of rows of at most ``size`` bytes (a longer text is a run of its own):
    (first row, end row, bytes, text offsets in those bytes)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, gap: np.ndarray = SPACE,
          prefixes: tuple[int, ...] = ()) -> Words:
    """``gap`` says which bytes part words. ``prefixes`` adds hashes of the first so many bytes of each
    longer word (``Words.prefixes``, one array per length, the word's own hash if it is not longer)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64),
                     [np.zeros(0, np.uint64)] * len(prefixes))
    if lower:
        data = LOWER[data]
    solid = ~gap[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = True
    last[cuts - 1] = True
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        def hashed(to: np.ndarray) -> np.ndarray:
            return mix((sums[to] - sums[starts]) * down[starts] + (to - starts).astype(np.uint64))

        return Words(data, starts, ends, np.searchsorted(starts, offsets), hashed(ends),
                     [hashed(np.minimum(starts + k, ends)) for k in prefixes])


def word_texts(w: Words, index: np.ndarray) -> pa.Array:
    """The words at ``index`` as an Arrow array, copied byte-wise."""
    starts, size = w.starts[index], (w.ends - w.starts)[index]
    offsets = np.zeros(len(index) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(index),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(w.data[at])])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word runs, text by text, and their offsets. A text of fewer words has its
    whole sequence as one; a text without words has none."""
    n = np.diff(w.offsets)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    total = int(offsets[-1])
    at = np.repeat(w.offsets[:-1] - offsets[:-1], counts) + np.arange(total)
    padded = np.concatenate([w.hashes, np.zeros(k, np.uint64)])
    short = np.repeat((n > 0) & (n < k), counts)
    end = np.repeat(w.offsets[1:], counts) if short.any() else None
    out = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            term = padded[at + j]
            if end is not None:
                term = np.where(at + j < end, term, np.uint64(0))
            out = out * STEP + term
        return mix(out + np.repeat(np.minimum(n, k), counts).astype(np.uint64)), offsets
