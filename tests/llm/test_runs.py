import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ropewalk.llm import recompress, runs

from .cases import ODD, words


def brute_runs(w):
    """{(start, end): smallest period} by direct comparison."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def model(key, text):
    w = words(text)
    h, n = zlib.crc32(str(key).encode()), len(w)
    if key is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return (key, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def letters_of(texts):
    sizes = [len(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.array([c for t in texts for c in t], np.uint64)
    return flat, offsets


def found_runs(texts):
    flat, offsets = letters_of(texts)
    start, end, q = runs.runs(flat, offsets)
    out = [[] for _ in texts]
    for s, e, p in zip(start, end, q):
        i = int(np.searchsorted(offsets, s, "right")) - 1
        out[i].append((int(s - offsets[i]), int(e - s), int(p)))
    return out


def unit(letter):
    return st.lists(letter, min_size=1, max_size=6)


REPEATED = st.lists(st.tuples(unit(st.integers(1, 3)), st.integers(1, 9)), max_size=6).map(
    lambda parts: [c for u, k in parts for c in u * k])


@settings(max_examples=300, deadline=None)
@given(st.lists(REPEATED, max_size=4))
def test_runs_of_repetitive_texts(texts):
    assert [sorted(f) for f in found_runs(texts)] == [brute_runs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(REPEATED.filter(lambda t: len(t) > 1), st.randoms(use_true_random=False))
def test_extensions(text, rnd):
    flat, offsets = letters_of([[9, 9], text, [9]])
    marks = offsets + np.arange(4)
    letters = np.zeros(len(flat) + 4, np.uint64)
    letters[np.arange(len(flat)) + np.repeat([1, 2, 3], np.diff(offsets))] = flat
    levels = recompress.grammar(letters, marks)
    pairs = [sorted(rnd.sample(range(len(text)), 2)) for _ in range(20)]
    a, b = np.array(pairs).T + marks[1] + 1
    ahead, back = recompress.extensions(levels, a, b), recompress.extensions(levels, a, b, left=True)
    for (i, j), x, y in zip(pairs, ahead, back):
        n = next((k for k in range(len(text) - j) if text[i + k] != text[j + k]), len(text) - j)
        m = next((k for k in range(i + 1) if text[i - k] != text[j - k]), i + 1)
        assert (x, y) == (n, m)


def test_levels_shrink_and_alternate():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 50, 20000).astype(np.uint64)
    levels = recompress.grammar(np.concatenate([[0], text, [0]]).astype(np.uint64), np.array([0, 20001]))
    assert [x.blocks for x in levels[:4]] == [True, False, True, False]
    assert len(levels[-1].names) == 3 and len(levels) < 100
    assert sum(len(x.names) for x in levels[1::2]) < 5 * len(text)


@pytest.mark.parametrize("text", [[1] * 50000, [1, 2, 3] * 20000, [1, 2] * 5000 + [3] + [1, 2] * 5000])
def test_long_periodic_texts(text):
    if len(set(text)) == 3 and text[10000] == 3 and len(text) == 20001:
        assert found_runs([text])[0] == [(0, 10000, 2), (10001, 10000, 2)]
    else:
        assert found_runs([text])[0] == [(0, len(text), len(set(text)))]


def test_report(docs_of):
    rnd = random.Random(5)
    rows = list(ODD)
    for i in range(400):
        w = [f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(80))]
        for _ in range(rnd.randrange(3)):
            u = [f"v{rnd.randrange(3)}" for _ in range(rnd.randrange(1, 7))]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = u * rnd.randrange(2, 9) + u[:rnd.randrange(len(u) + 1)]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(w), "en", "s"))
    rows = [r if len(r[1] or "") < 9999 else (r[0], "word " * 900, "en", "t") for r in rows]
    got = sorted(map(tuple, runs.report(docs_of(rows)).collect()), key=str)
    assert got == sorted((model(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 150 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)


def test_scan_keeps_the_words_and_empty_tables(docs_of):
    df = docs_of([(1, "a b a b a b a b c", "en", "s"), (2, " x  y ", "en", "s"), (3, None, "en", "s")])
    got = {r.doc_id: r for r in runs.scan(df).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 8, 2)] and got[1].collapsed == "a b c" and got[1].n_words == 9
    assert got[2].collapsed == "x y" and got[3].collapsed == "" and got[3].runs == []
    assert runs.report(df.limit(0)).collect() == []
