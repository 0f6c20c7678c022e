import random

from pyspark.sql import functions as F

from conftest import rows
from ropewalk.operators.ordered import first_k, prefix, rank_index, row_index, with_previous
from ropewalk.operators.pairs import member_pairs, salted_join
from ropewalk.operators.similarity import similar


def test_prefix_over_many_blocks(make):
    rnd = random.Random(1)
    data = [(k, o, rnd.randint(0, 50)) for k in "ab" for o in rnd.sample(range(1000), 60)]
    got = prefix(make(data, "k string, o long, v long"), ["k"], "o",
                 {"s": ("sum", "v"), "m": ("max", "v")}, width=7, levels=2)
    for k, o, v, s, m in rows(got):
        before = [x for kk, oo, x in data if kk == k and oo < o]
        assert s == sum(before) and m == (max(before) if before else None)


def test_row_index_is_global_and_dense(make):
    data = [(o,) for o in random.Random(2).sample(range(10 ** 6), 500)]
    got = rows(row_index(make(data, "o long"), [], "o", "rn", total="n", width=1000))
    assert [r[1] for r in got] == list(range(500)) and {r[2] for r in got} == {500}


def test_rank_index_with_ties(make):
    data = [(i, i % 3) for i in range(100)]
    got = rows(rank_index(make(data, "o long, v long"), "v", "o", "rn"), "rn", "v", "o")
    assert [(v, o) for _, v, o in got] == sorted((v, o) for o, v in data)
    assert [r[0] for r in got] == list(range(100))


def test_with_previous_across_blocks(make):
    data = [("c", i, f"s{i}") for i in range(23)] + [("d", 0, "x")]
    got = rows(with_previous(make(data, "chain string, pos long, step string"), ["chain"], "pos",
                             ["step"], width=5))
    assert len(got) == 24
    assert all(p == (f"s{i - 1}" if i else None) for c, i, s, p in got if c == "c")


def test_member_pairs_of_a_hot_group(make):
    data = [("hot", i) for i in range(60)] + [("cold", i) for i in range(3)]
    got = rows(member_pairs(make(data, "g string, m long"), "g", "m", block=8))
    want = sorted((g, a, b) for g, n in (("hot", 60), ("cold", 3))
                  for a in range(n) for b in range(a + 1, n))
    assert got == want


def test_salted_join_equals_join(make):
    big = make([(1, i) for i in range(50)] + [(2, 99)], "k long, i long")
    small = make([(1, "x"), (1, "y"), (3, "z")], "k long, v string")
    assert rows(salted_join(big, small, "k", "i", 4), "k", "i", "v") == rows(
        big.join(small, "k"), "k", "i", "v")


def test_first_k(make):
    df = make([("a", i) for i in range(10)], "k string, v long")
    assert rows(first_k(df, ["k"], [F.col("v").desc()], 2)) == [("a", 8, 2), ("a", 9, 1)]


def test_similar_does_not_depend_on_tiles(make):
    rnd = random.Random(3)
    data = [(i, i, [rnd.random() for _ in range(4)]) for i in range(40)]
    df = make(data, "id long, ord long, vec array<double>")
    one = rows(similar(df, df, 4, 1.2, earlier_only=True))
    many = rows(similar(df, df, 4, 1.2, earlier_only=True, tile=7))
    assert one == many and one


def test_sparse_orders_fill_blocks(spark):
    from ropewalk.operators.ordered import prefix

    df = spark.range(3000).selectExpr("id % 3 AS k", "xxhash64(id) AS o", "id % 7 AS v")
    out = prefix(df, ["k"], "o", {"s": ("sum", "v"), "m": ("max", "v")}, width=100)
    want, seen = [], {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.o)):
        own = seen.setdefault(r.k, [])
        want.append((r.k, r.o, r.v, sum(own), max(own, default=None)))
        own.append(r.v)
    assert sorted(tuple(r) for r in out.select("k", "o", "v", "s", "m").collect()) == sorted(want)


def test_range_rank(spark):
    from pyspark.sql import functions as F
    from ropewalk.operators.ordered import range_rank

    df = spark.range(500).selectExpr("xxhash64(id) % 1000003 AS o", "CASE WHEN id % 50 = 0 THEN NULL ELSE id END AS i")
    got = range_rank(df, [F.col("o").desc(), F.col("i")], "at", parts=7).orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(500))
    assert [r.o for r in got] == sorted((r.o for r in got), reverse=True)
