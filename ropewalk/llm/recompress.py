"""Recompression: a run-length grammar over many word sequences at once, and its longest common extensions.

The letters of all texts stand in one array, each text between marks that equal nothing. A level replaces every block of
equal letters by one symbol (run length in its name), the next one every adjacent pair of a left and a right letter, the
sides being drawn anew per level; so levels alternate and shrink by a constant share until every text is one symbol. Symbols
are named by 64-bit hashes of their rule, so equal rules have equal names in all texts and nothing is sorted.

Whether two neighbours stay apart is decided by these two alone. So two equal stretches are parsed alike but for the
symbol at either end, and an extension needs at most one step per level: match the symbols up to the next common
boundary, climb, and after the first difference go down again the same way. Extensions to the left mirror this.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .flat import STEP, mix

BLOCK, PAIR = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


@dataclass
class Level:
    """``names[i]`` covers ``first[i]:first[i + 1]`` of the level below; ``parent`` is its place in the level above
    (None at the top); ``blocks`` says that the level above replaces blocks."""

    names: np.ndarray
    first: np.ndarray | None
    parent: np.ndarray | None = None
    blocks: bool = True


def grammar(letters: np.ndarray, marks: np.ndarray) -> list[Level]:
    """Levels over ``letters``; ``marks`` are the places of the marks around and between texts, whose letters are
    set to names that occur once."""
    names = letters.copy()
    names[marks] = mix(np.arange(len(marks), dtype=np.uint64) + (np.uint64(1) << np.uint64(63)))
    fixed = np.zeros(len(names), bool)
    fixed[marks] = True
    levels = [Level(names, None)]
    while len(names) > 2 * len(marks) - 1 or not (fixed[1:] | fixed[:-1]).all():
        head = np.empty(len(names), bool)
        head[0] = True
        if levels[-1].blocks:
            np.not_equal(names[1:], names[:-1], out=head[1:])
        else:
            with np.errstate(over="ignore"):
                right = (mix(names + STEP * np.uint64(len(levels))) & np.uint64(1)).astype(bool)
            head[1:] = ~(right[1:] & ~right[:-1]) | fixed[1:] | fixed[:-1]
        first = np.flatnonzero(head)
        size = np.diff(first, append=len(names))
        above = names[first]
        many = np.flatnonzero(size > 1)
        with np.errstate(over="ignore"):
            if levels[-1].blocks:
                above[many] = mix(above[many] * BLOCK + size[many].astype(np.uint64))
            else:
                above[many] = mix(above[many] * PAIR + names[first[many] + 1])
        levels[-1].parent = np.cumsum(head) - 1
        fixed = fixed[first]
        names = above
        levels.append(Level(names, np.append(first, len(head)), blocks=not levels[-1].blocks))
    return levels


def _advance(level: Level, above: Level, a: np.ndarray, b: np.ndarray, left: bool) -> np.ndarray:
    """Letters that two equal letters at ``a`` and ``b`` match for sure: up to the nearer end of their blocks, or one."""
    if not level.blocks:
        return np.ones(len(a), np.int64)
    pa, pb = level.parent[a], level.parent[b]
    if left:
        return np.minimum(a - above.first[pa], b - above.first[pb]) + 1
    return np.minimum(above.first[pa + 1] - a, above.first[pb + 1] - b)


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray, left: bool = False) -> np.ndarray:
    """For each pair of places a < b of one text, the letters that agree from there on (``left``: back from there)."""
    sign = -1 if left else 1
    out = np.zeros(len(a), np.int64)
    who, x, y = np.arange(len(a)), a.copy(), b.copy()
    stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, level in enumerate(levels):
        same = level.names[x] == level.names[y]
        if level.parent is not None and same.any():
            above, at = levels[i + 1], np.flatnonzero(same)
            pa, pb = level.parent[x[at]], level.parent[y[at]]
            if left:
                edge = (above.first[pa + 1] - 1 == x[at]) & (above.first[pb + 1] - 1 == y[at])
            else:
                edge = (above.first[pa] == x[at]) & (above.first[pb] == y[at])
            at = at[~edge]  # equal, but one is inside a symbol: match up to the next boundary
            step = sign * _advance(level, above, x[at], y[at], left)
            x[at] += step
            y[at] += step
            same[at] = level.names[x[at]] == level.names[y[at]]
        stopped.append((who[~same], x[~same], y[~same]))
        if not same.any():
            break
        who, x, y = who[same], level.parent[x[same]], level.parent[y[same]]
    who, x, y = stopped.pop()
    for i in reversed(range(len(stopped) + 1)):
        if i < len(stopped):
            level, above = levels[i], levels[i + 1]
            if left:
                x, y = above.first[x + 1] - 1, above.first[y + 1] - 1
            else:
                x, y = above.first[x], above.first[y]
            at = np.flatnonzero(level.names[x] == level.names[y])
            step = sign * _advance(level, above, x[at], y[at], left)
            x[at] += step
            y[at] += step
            more = stopped[i]
            who, x, y = (np.concatenate(p) for p in zip((who, x, y), more))
    out[who] = (x - a[who]) * sign
    return out
