import hashlib

import numpy as np
import pytest

from ropewalk.llm import fmindex, substrings

from .cases import ODD, copied_texts, kept_words, words


@pytest.mark.parametrize("hot,seed", [(2000, 1), (1, 2)])
def test_equals_brute_force(docs_of, monkeypatch, hot, seed):
    monkeypatch.setattr(substrings, "HOT", hot)  # 1: every key is dealt anew by windows
    rows = copied_texts(150, seed, vocabulary=60, size=(5, 120))
    got = substrings.cleaned(docs_of([(i, t, "en", "s") for i, t in rows]).drop("n_words"), width=12).collect()
    want = kept_words(rows, 12)
    assert {r.doc_id: r.text for r in got} == {i: b" ".join(w).decode() for i, w in want.items()}
    assert sum(r.n_removed for r in got) == sum(len(words(t)) for _, t in rows) - sum(map(len, want.values())) > 500


def test_whole_width_and_repeats_inside_a_text(docs_of):
    line = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"{line} {line} tail"), (2, f"a b {line} c"), (3, " ".join(f"p{i}" for i in range(49))), (4, "x " * 200), (5, "x " * 60)]
    got = {r.doc_id: r for r in substrings.report(docs_of([(i, t, "en", "s") for i, t in rows])).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {1: 0, 2: 50, 3: 0, 4: 0, 5: 60}
    assert got[2].kept_sha256 == hashlib.sha256(b"a b c").hexdigest()


def test_odd_rows(docs_of):
    df = docs_of(ODD + [(None, "n " * 100, "en", "s"), (50, "n " * 100, "en", "s"), (4, "n " * 100, "en", "s")])
    got = substrings.report(df).collect()
    assert len(got) == len(ODD) + 3
    assert sorted((r.doc_id, r.n_removed) for r in got if r.n_removed) == [(50, 100)]
    assert substrings.report(df.limit(0)).count() == 0
    plain = substrings.cleaned(df.drop("n_words"), rejoin=False).filter("doc_id = 8").first()
    assert plain.text == "  x\u0085y"


def test_index_matches_plain_search():
    rng = np.random.default_rng(0)
    for _ in range(40):
        width = 5
        texts = [list(rng.integers(1, rng.integers(3, 6), rng.integers(width, 15))) for _ in range(rng.integers(2, 12))]
        texts += texts[:2]
        own = rng.integers(0, 6, len(texts))
        symbols = np.array([s for t in texts for s in [*t, 0]])
        sizes = np.array([len(t) + 1 for t in texts])
        index = fmindex.FMIndex(symbols, np.repeat(own, sizes))
        q, a, b = fmindex.earlier_windows(index, symbols, np.cumsum(sizes) - sizes, sizes - width, own, width)
        got = {(int(i), j) for i, x, y in zip(q, a, b) for j in range(x, y + 1)}
        assert got == {(i, j) for i, t in enumerate(texts) for j in range(len(t) - width + 1)
                       if any(own[k] < own[i] and any(u[m:m + width] == t[j:j + width] for m in range(len(u) - width + 1))
                              for k, u in enumerate(texts))}


def test_columns_named_like_inner_ones(docs_of):
    passage = " ".join(f"p{i}" for i in range(60))
    df = docs_of([(1, passage, "en", "s"), (2, "x " + passage, "en", "s")]).selectExpr(
        "*", "doc_id * 5 AS n_removed", "doc_id * 6 AS _own", "doc_id * 7 AS _from", "doc_id * 8 AS _gone")
    got = {r.doc_id: r for r in substrings.cleaned(df).collect()}
    assert got[2].text == "x" and (got[2].n_words, got[2].n_removed) == (61, 60)
    assert (got[2]._own, got[2]._from, got[2]._gone) == (12, 14, 16)
    import corpus_pipeline
    kept = {r.doc_id: r for r in corpus_pipeline.repeated_passages(df.sparkSession, df, "").collect()}
    assert kept[2].text == "x" and (kept[2].n_words, kept[2].n_removed, kept[2].n_chars) == (8, 10, 1)
