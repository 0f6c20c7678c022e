import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ropewalk.llm import merkle

from .cases import ODD


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(i, source, lang, n, text):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)]
    return sha("".join(parts))


def climb(nodes):
    """Root and, per node, the list of (left, right) siblings."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, a in zip(paths, at):
            run = nodes[a - a % 3:a - a % 3 + 3]
            p.append(("".join(run[:a % 3]), "".join(run[a % 3 + 1:])))
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        at = [a // 3 for a in at]
    return nodes[0], paths


def model(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the sorted results of ``report``."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = []
    for s in sources:
        own = [(leaf(r[0], s, r[2], r[4], r[1]), r) for r in rows if r[3] == s]
        groups.append(sorted(own, key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])))
    below = [climb([x for x, _ in g]) for g in groups]
    root, over = climb([b[0] for b in below])
    out = []
    for g, (subroot, paths), up in zip(groups, below, over):
        for (x, r), path in zip(g, paths):
            full, seen = path + up, x
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                seen = leaf(r[0], r[3], r[2], r[4], r[1].replace("\n", ""))
            for a, b in full:
                seen = sha(a + seen + b)
            out.append((r[0], x, subroot, root, sha("".join(a + b for a, b in full)), seen, seen == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [4, 1, 9], [82, 3, 81], [250, 27, 1, 1, 28]])
def test_against_model(docs_of, sizes):
    rnd = random.Random(sum(sizes))
    names = [None, "", "a", "B", "é", "\U0001F600"]
    rows = [(rnd.randrange(10 ** 6), f"text {j}\nline" * rnd.randrange(3), "en", names[i])
            for i, n in enumerate(sizes) for j in range(n)]
    rnd.shuffle(rows)
    got = rows_of(merkle.report(docs_of(rows)))
    assert got == model([(*r, len(r[1])) for r in rows])


def test_odd_rows(docs_of):
    rows = ODD + [(70, "a\nb", None, None), (71, "a\nb", None, None), (72, "a\nb", None, None)]
    got = rows_of(merkle.report(docs_of(rows)))
    assert got == model([(*r, len(r[1] or "")) for r in rows])


def test_many_sources_and_places_do_not_depend_on_partitions(docs_of):
    rows = [(i, f"t{i}", "en", f"s{i % 100}") for i in range(330)]
    df = docs_of(rows)
    got = rows_of(merkle.report(df.repartition(11)))
    assert got == rows_of(merkle.report(df.coalesce(1))) == model([(*r, len(r[1])) for r in rows])


def test_proofs_stand_alone_and_only_some_levels_are_stored(docs_of, sample):
    leaves = sample.select("doc_id", "source", merkle.leaf().alias("leaf"))
    out = merkle.manifest(leaves)
    bad = out.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root"))
    assert bad.count() == 0 and out.count() == sample.count()
    flipped = F.concat(F.lit("0"), F.substring("leaf", 2, 63))
    assert out.filter((flipped != F.col("leaf")) & (merkle.fold(flipped, F.col("path")) == F.col("root"))).count() == 0
    t = merkle.tree(leaves.select(F.lit("x").alias("key"), F.col("leaf").alias("node"), "doc_id"), ["doc_id", "node"])
    n = sample.count()
    assert [x.count() for x in t.tiers] == [n, -(-n // 81), -(-n // 81 ** 2)]
    assert n > 81


def test_an_empty_table(docs_of):
    assert merkle.report(docs_of(ODD).limit(0)).collect() == []
