import numpy as np
import pytest
from pyspark.sql import functions as F

from ropewalk.llm import mixing

from .cases import ODD, words


def level(sizes, weights, share, cap):
    """Targets by sharing the excess again until none is above its cap."""
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            free.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[100, 10, 5, 1000], [7, 7, 7], [0, 50, 3], [1, 1, 1, 1, 1000, 2, 3]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    got = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()
    want = level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert {r.source: pytest.approx(r.target) for r in got} == dict(zip(names, want))


def test_rounding_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    mass = rng.integers(1, 100, 40).astype(float)
    p = rng.random(40)
    mean = np.zeros(40)
    for _ in range(800):
        out, held = mixing.pivot(p, mass, rng.random(40))
        assert abs((out * mass).sum() - (p * mass).sum()) < 1e-6
        assert np.isin(np.delete(out, held) if held >= 0 else out, (0, 1)).all()
        mean += out
    assert np.abs(mean / 800 - p).max() < 0.08


def test_report(docs_of):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "en", f"s{min(i % 5, 2)}") for i in range(3000)] + ODD
    got = mixing.report(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(words(r[1])) for r in rows)
    sums, sizes = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        sums[r.source] = sums.get(r.source, 0) + r.taken
        sizes[r.source] = (r.source_size, r.target)
    for s, (_, target) in sizes.items():
        assert abs(sums[s] - target) <= (30000 if s == "t" else 60)


def test_reruns_agree_and_blocks_meet_in_a_tree(docs_of):
    rows = [(i, "w " * (i % 37), "en", f"s{i % 2}") for i in range(400)]
    df = docs_of(rows)
    a = sorted(map(tuple, mixing.copies(df, block=10).select("doc_id", "copies").collect()))
    b = sorted(map(tuple, mixing.copies(df.repartition(7), block=10).select("doc_id", "copies").collect()))
    assert a == b and len(a) == 400
    mixed = mixing.mix(df, block=10)
    assert mixed.columns == df.columns and mixed.count() == sum(c for _, c in a)
    taken = mixed.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()
    goal = {r.source: r.target for r in mixing.copies(df, block=10).collect()}
    assert all(abs(r.n - goal[r.source]) <= 37 for r in taken)


def test_empty(docs_of):
    assert mixing.report(docs_of(ODD).limit(0)).count() == 0
    assert mixing.mix(docs_of([(1, None, "en", "s"), (2, "", "en", "s")])).count() == 0


def test_columns_named_like_inner_ones_pass_through(docs_of):
    rows = [(i, "w " * (i % 7 + 1), "en", "s") for i in range(40)]
    df = docs_of(rows).selectExpr("*", "doc_id * 2 AS _each", "doc_id * 3 AS _kh", "doc_id * 4 AS _copies", "'k' AS _k1")
    got = mixing.mix(df).collect()
    assert got and all((r._each, r._kh, r._copies, r._k1) == (2 * r.doc_id, 3 * r.doc_id, 4 * r.doc_id, "k") for r in got)
