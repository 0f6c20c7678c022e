import re

import numpy as np
import pytest

from ropewalk.llm import graph, jaccard

from .cases import ODD, copied_texts, jaccard_roots, roots, shingle_set


@pytest.mark.parametrize("k,percent,forced", [(3, 90, None), (5, 80, None), (2, 60, 3), (3, 70, 2)])
def test_components_equal_brute_force(docs_of, monkeypatch, k, percent, forced):
    if forced:  # every document asks for several shared prefix shingles
        monkeypatch.setattr(jaccard, "choose", lambda n, f, at, p: np.minimum(forced, np.maximum(jaccard.least(n, p), 1)))
    rows = copied_texts(160, seed=k * percent, noise=0.02)
    got = jaccard.components_of(docs_of([(i, t, "en", "s") for i, t in rows]), k, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == jaccard_roots(rows, k, percent)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t, k)) for i, t in rows}


def test_large_group_of_near_copies(docs_of):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i % 190] + [f"x{i}"] + base[i % 190:])) for i in range(150)] + [
        (500 + i, f"the same line again {i % 3}") for i in range(150)]
    got = jaccard.components_of(docs_of([(i, t, "en", "s") for i, t in rows]), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == jaccard_roots(rows, 5, 80)


def test_pairs_are_compared_in_a_row_each(docs_of, monkeypatch):
    plans, plain = [], jaccard.durable
    monkeypatch.setattr(jaccard, "durable", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    rows = copied_texts(160, seed=4, noise=0.05)
    got = jaccard.components_of(docs_of([(i, t, "en", "s") for i, t in rows]), 3, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == jaccard_roots(rows, 3, 80)
    joins = [line for p in plans for line in p.splitlines() if "Join Inner" in line]
    # no row per shingle of a pair, and bitmaps decide where pairs are proposed
    assert not [j for j in joins if re.search(r"\(_uid#\d+L = _uid#\d+L\)", j) and "tok#" in j]
    assert [j for j in joins if "pos#" in j and "bit_count" in j]


def test_odd_rows(docs_of):
    got = jaccard.components_of(docs_of(ODD), 3, 90).collect()
    assert len(got) == len(ODD)
    none = [r for r in got if r.n_shingles == 0]
    assert sorted((r.doc_id for r in none), key=str) == [1, 2, 3, None] and all(r.component_id == r.doc_id for r in none)
    kept = jaccard.deduplicated(docs_of(ODD))
    assert kept.columns == docs_of(ODD).columns
    # the repeated row goes; of the two texts of id 4 both are components of their own
    assert kept.count() == len(ODD) - 1


def test_deduplicated_keeps_the_smallest_id(docs_of):
    rows = copied_texts(120, seed=5, noise=0.02)
    kept = {r.doc_id for r in jaccard.deduplicated(docs_of([(i, t, "en", "s") for i, t in rows])).collect()}
    assert kept == set(jaccard_roots(rows, 5, 80).values())
    assert jaccard.deduplicated(docs_of(ODD).limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == roots({x for e in real for x in e}, real)


def test_kept_rows_keep_columns_named_like_inner_ones(docs_of):
    df = docs_of([(i, f"a b c d e f g {i // 2}", "en", "s") for i in range(6)]).selectExpr(
        "*", "doc_id + 1 AS _k1", "doc_id + 2 AS _id", "doc_id + 3 AS _s1", "doc_id + 4 AS n_shingles")
    got = jaccard.deduplicated(df).collect()
    assert got and all((r._k1, r._id, r._s1, r.n_shingles) == tuple(r.doc_id + j for j in (1, 2, 3, 4)) for r in got)
