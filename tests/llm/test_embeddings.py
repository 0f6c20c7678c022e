import numpy as np

from ropewalk.llm import embeddings

from .cases import roots

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, copies int, links int"


def brute(rows):
    x = {i: np.array(v, np.float64) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = [(a, b) for a in x for b in x if a < b and len(x[a]) == len(x[b])
             and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.95]
    return {i: sum(i in p for p in links) for i, _ in rows}, roots([i for i, _ in rows], links)


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    n, root = brute(rows)
    assert {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == root
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_planted_groups_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(12):
        base = rng.standard_normal(32)
        rows += [(g * 20 + i, (base + 0.02 * i * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(12)]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] + [1.0] * 31), (903, [None] + [1.0] * 31), (904, []),
             (905, [float("inf")] * 32), (906, rows[0][1]), (907, rows[0][1]), (908, [2 * c for c in rows[0][1]]), (909, [1.0, 2.0]),
             (910, [1.0, 2.0]), (911, [1e-38] * 32), (912, [3e38] * 32)]
    check(spark, rows)


def test_split_bucket(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    check(spark, [(i, (base + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(120)])


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0], 1, 1, 1, 1), (5, [1.0, 0.0], 1, 1, 1, 1), (None, [0.0, 1.0], 1, 1, 1, 1)], SCHEMA)
    got = sorted(map(repr, (tuple(r) for r in embeddings.near_duplicates(df).collect())))
    assert got == sorted(map(repr, [(5, 1, 5, True), (5, 1, 5, True), (None, 0, None, False)]))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ embeddings.rotation(64, 64).T
    code = np.sign(turned) / 8
    factor = (code * turned).sum(axis=1)
    error = turned @ code.T / factor - x @ x.T
    np.fill_diagonal(error, 0)
    bound = embeddings.SURE * np.sqrt((1 - factor ** 2) / (factor ** 2 * 63))
    assert abs(error.mean()) < 2e-3 and (np.abs(error) <= bound).mean() > 0.999


def test_recall_at_the_threshold():
    bits, tables = embeddings.plan(10 ** 6)
    rng = np.random.default_rng(3)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * b
    met = (embeddings.bucket_keys(a, bits, tables) == embeddings.bucket_keys(c, bits, tables)).any(axis=1)
    assert met.mean() > 0.99
