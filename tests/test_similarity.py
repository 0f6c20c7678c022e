"""Tile skipping and folding without all pairs, against direct comparison."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import rows
from ropewalk.operators import curation, similarity

VEC = "id long, ord long, vec array<double>"


def clusters(seed, groups, size, dim=16, noise=0.08):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(size):
            v = centre + noise * np.linalg.norm(centre) * rng.normal(size=dim) / dim ** 0.5
            out.append((v / np.linalg.norm(v)).tolist())
    order = rng.permutation(len(out))
    return [(int(i), int(n), out[i]) for n, i in enumerate(order)]


def direct(data, threshold, earlier):
    m = np.array([v for _, _, v in data])
    sims = np.round(m @ m.T, 6)
    return {(a[0], b[0], sims[x, y]) for x, a in enumerate(data) for y, b in enumerate(data)
            if sims[x, y] >= threshold and (b[1] < a[1] if earlier else b[1] != a[1])}


@pytest.mark.parametrize("earlier", [True, False])
def test_skipped_tiles_hold_no_pair(make, monkeypatch, earlier):
    monkeypatch.setattr(similarity, "PLAIN", 0)
    data = clusters(1, 40, 12)
    df = make(data, VEC)
    got = similarity.similar(df, df, 16, 0.9, earlier_only=earlier, same_table=True, tile=16)
    want = direct(data, 0.9, earlier)
    found = {(r.left_id, r.right_id, r.sim) for r in got.collect()}
    assert {x[:2] for x in found} == {x[:2] for x in want} and len(want) > 500


def test_tile_pairs_grow_with_the_rows_not_their_square(make, monkeypatch):
    """Clustered vectors: each tile meets its neighbours only, at three sizes."""
    met = []
    pairs = similarity.tile_pairs
    monkeypatch.setattr(similarity, "GROUP", 4)

    def counted(*args):
        out = pairs(*args)
        met.append(out.count())
        return out
    monkeypatch.setattr(similarity, "tile_pairs", counted)
    for groups in (20, 40, 80):
        df = make(clusters(2, groups, 16, dim=8, noise=0.02), VEC)
        similarity.similar(df, df, 8, 0.97, same_table=True, tile=16).count()
    assert met[2] < 0.35 * (80 ** 2) and met[2] / met[0] < 11  # all pairs would be 6,400 and 16 times as many


def test_first_partners_and_best(make, monkeypatch):
    monkeypatch.setattr(similarity, "PLAIN", 0)
    data = clusters(3, 3, 30)
    df = make(data, VEC)
    got = {}
    for r in similarity.similar(df, df, 16, 0.8, earlier_only=True, tile=8, first=2).collect():
        got.setdefault(r.left_id, []).append(r.right_ord)
    want = {}
    place = {i: n for i, n, _ in data}
    for a, b, _ in direct(data, 0.8, True):
        want.setdefault(a, []).append(place[b])
    assert {a: sorted(x)[:2] for a, x in got.items()} == {a: sorted(x)[:2] for a, x in want.items()}


@pytest.mark.parametrize("asked", [{"k": 3}, {"k": 3, "threshold": 0.5}, {"first": 2, "threshold": 0.8, "earlier_only": True},
                                   {"threshold": 0.9, "earlier_only": True}])
def test_tiles_are_not_copied_for_their_partners(make, monkeypatch, asked):
    """No shuffle between the stored tiles and the pairs: 25 pairs of tiles are formed by reading, a few at a time."""
    plans = []
    stored = similarity.durable

    def seen(df):
        plans.append((df._jdf.queryExecution().executedPlan().toString(),
                      df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return stored(df)
    monkeypatch.setattr(similarity, "durable", seen)
    data = clusters(6, 5, 16)
    df = make(data, VEC)
    got = similarity.similar(df, df, 16, same_table=True, tile=16, **asked)
    plan, batch = plans[-1]
    assert batch == "8" and got.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "8"
    assert "CoGroup" not in plan and "Exchange hashpartitioning" not in plan and "Generate" not in plan
    m = np.array([v for _, _, v in data])
    sims = np.round(m @ m.T, 6)
    found = {}
    for r in got.collect():
        found.setdefault(r.left_id, []).append((-r.sim, r.right_ord))
    for x, (i, _, _) in enumerate(data):
        want = [(-sims[x, y], y) for y in range(len(data)) if y != x and sims[x, y] >= asked.get("threshold", -2)
                and (y < x or not asked.get("earlier_only"))]
        have = found.get(i, [])
        if "first" in asked:
            want, have = sorted(want, key=lambda p: p[1])[:2], sorted(have, key=lambda p: p[1])[:2]
        elif "k" in asked:
            want, have = sorted(want)[:3], sorted(have)[:3]
        assert [y for _, y in sorted(want)] == [y for _, y in sorted(have)]
        assert np.allclose([s for s, _ in sorted(want)], [s for s, _ in sorted(have)], atol=2e-6)


def greedy(data, threshold):
    """(id, action, target) one by one in ord order."""
    m, kept, out = np.array([v for _, _, v in data]), [], set()
    for x, (i, _, _) in enumerate(data):
        near = [(-round(float(m[x] @ m[y]), 6), y) for y in kept if round(float(m[x] @ m[y]), 6) >= threshold]
        if near:
            out.add((i, "merge", data[min(near)[1]][0]))
        else:
            kept.append(x)
            out.add((i, "insert", None))
    return out


@pytest.mark.parametrize("partners, last", [(1, 0), (2, 50), (8, 1000), (1, 1000)])
def test_folding_with_few_partners(make, monkeypatch, partners, last):
    monkeypatch.setattr(curation, "PARTNERS", partners)
    monkeypatch.setattr(curation, "LAST", last)
    monkeypatch.setattr(similarity, "TILE", 32)
    monkeypatch.setattr(similarity, "PLAIN", 0)
    data = clusters(4, 6, 20, noise=0.45)
    data += [(1000 + n, len(data) + n, data[n * 7][2]) for n in range(12)]  # later copies
    got = curation.fold_assignments(make(data, VEC), make([], VEC), 0.85, 16)
    assert set(rows(got, "id", "action", "target")) == greedy(data, 0.85)


def test_a_large_family_costs_its_size(make, monkeypatch):
    """5,000 near copies: a few rows each, not 12 million pairs."""
    data = clusters(5, 1, 5000, dim=8, noise=0.02)
    seen = []
    ask = curation.EarlierPartners._ask

    def counted(self, *args):
        out = ask(self, *args)
        seen.append(out[0].count())
        return out
    monkeypatch.setattr(curation.EarlierPartners, "_ask", counted)
    got = curation.fold_assignments(make(data, VEC), make([], VEC), 0.9, 8)
    assert got.groupBy("action").count().orderBy("action").collect()[0][:] == ("insert", 1) and got.count() == 5000
    assert sum(seen) <= curation.PARTNERS * 5000


def test_float_vectors_are_stored_as_given(make):
    """Vectors given in single precision are not stored and sent in double precision."""
    rows_ = [(i, i, [float(i), 1.0, 0.5], 0) for i in range(7)]
    for kind, size in (("float", 4), ("double", 8)):
        r = similarity._packed(make(rows_, f"id long, ord long, vec array<{kind}>, _tile int"), 3, "l").first()
        assert (len(r.ldata), np.dtype(r.lkind)) == (7 * 3 * size, np.dtype(f"f{size}"))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_best_k_with_copies_and_ties(make, kind):
    """Tiles are wide enough for the bound on the k-th best; copies tie, and ties go to the smaller ord."""
    rng = np.random.default_rng(5)
    base = rng.integers(-2, 3, (60, 6)).astype(float)
    m = np.concatenate([base, base, base[:30], rng.standard_normal((150, 6))]).astype(np.float32).astype(float)
    df = make([(i, 3 * i, v.tolist()) for i, v in enumerate(m)], f"id long, ord long, vec array<{kind}>")
    found = similarity.similar(df, df, 6, k=2, same_table=True, tile=64).collect()
    got = {}
    for r in found:
        got.setdefault(r.left_id, []).append((-r.sim, r.right_ord, r.right_id))
    for i, v in enumerate(m):
        want = sorted((-round(float(v @ w), 6) + 0.0, 3 * j, j) for j, w in enumerate(m) if j != i)[:2]
        mine = sorted(got[i])[:2]
        assert [x[1:] for x in mine] == [x[1:] for x in want]
        assert [x[0] for x in mine] == pytest.approx([x[0] for x in want], abs=1e-6)


def test_listed_partners_are_not_searched_again(make, monkeypatch):
    """A record with few partners takes its target from the list of them; early targets are asked before all others."""
    monkeypatch.setattr(curation, "HEAD", 8)
    asked = []
    similar = curation.similar

    def counted(left, right, dim, threshold, k=None, **kw):
        asked.append((k, kw.get("first"), left.count()))
        return similar(left, right, dim, threshold, k, **kw)
    monkeypatch.setattr(curation, "similar", counted)
    data = clusters(6, 12, 4, noise=0.4)
    got = curation.fold_assignments(make(data, VEC), make([], VEC), 0.85, 16)
    assert set(rows(got, "id", "action", "target")) == greedy(data, 0.85)
    assert [n for k, _, n in asked if k == 1] == [0]
    assert [n for _, first, n in asked if first][:2] == [len(data), len(data) - 8]
