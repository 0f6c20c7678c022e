"""Near duplicates among embeddings by randomised-rotation binary codes.

Vectors are normalised and folded by equal components. Random rotations give every vector sign bits; each table
of ``bits`` of them puts it in a bucket, and the number of tables makes the chance that a pair at the threshold
shares none at most ``MISS``. Within a bucket the sign code of one vector, its stored correction factor
(the inner product of the vector and its code) and the rotated other vector give an unbiased estimate of the
inner product with a confidence bound; only pairs whose upper bound reaches the threshold are computed exactly, in
double precision. A pair counts in the first table that joins it.

Pairs stay in their task: what leaves is, per vector, the number of links found and the smallest
vector it is connected to in the bucket. A bucket above ``BLOCK`` vectors is split into blocks, and
pairs of blocks are groups of their own. ``bits`` grows with the logarithm of the table, so buckets
stay small.

Defined results: null vectors, zero vectors and vectors with null or non-finite components link with nothing
and are their own component. Vectors of different length never link. Repeated rows are vectors of their own with
cosine 1. A null id takes part and comes out null; its group's smallest id is taken over the others. An empty
table gives an empty table. Extra columns, ``label`` among them, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ropewalk.session import durable

from . import graph

THRESHOLD = 0.95
MISS = 0.002
BUCKET = 64     # vectors a bucket holds on average in one table, were they spread evenly
LEAST_BITS = 10
BLOCK = 1024
SURE = 4.0      # width of the confidence bound


def plan(count: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits per table and number of tables for ``count`` vectors."""
    bits = min(30, max(LEAST_BITS, math.ceil(math.log2(max(count, 1) / BUCKET)) if count > BUCKET else 0))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def rotation(dim: int, rows: int, seed: int = 11) -> np.ndarray:
    """(rows, dim): stacked random orthogonal matrices."""
    rng, parts = np.random.default_rng([seed, dim]), []
    for _ in range(-(-rows // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts)[:rows]


def bucket_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) bucket numbers from the signs of the rotated vectors."""
    signs = (x @ rotation(x.shape[1], bits * tables).T >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def linked(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) with an inner product of at least ``threshold``."""
    dim = x.shape[1]
    turned = (x @ rotation(dim, dim).T).astype(np.float32)
    code = np.where(turned >= 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(dim))
    factor = (code * turned).sum(axis=1)  # stored correction factor of each code
    bound = SURE * np.sqrt(np.maximum(1 - factor ** 2, 0) / (factor ** 2 * max(dim - 1, 1))) + 1e-4
    out_i, out_j = [], []
    for lo in range(0, len(left), BLOCK):
        rows = left[lo:lo + BLOCK]
        guess = turned[rows] @ code[right].T / factor[right]
        i, j = np.nonzero(guess + bound[right] >= threshold)
        i, j = rows[i], right[j]
        exact = np.einsum("ij,ij->i", x[i], x[j])
        good = (exact >= threshold) & (i != j)
        out_i.append(i[good])
        out_j.append(j[good])
    return np.concatenate(out_i), np.concatenate(out_j)


def classes(vectors: DataFrame) -> DataFrame:
    """(rep, copies, embedding) per distinct vector that can link."""
    ok = (F.col("embedding").isNotNull() & (F.size("embedding") > 0)
          & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
          & F.exists("embedding", lambda v: v != 0))
    return vectors.filter(ok).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")) \
        .withColumn("_uid", F.monotonically_increasing_id())


def marks(embedding: str) -> list:
    return [F.xxhash64(embedding).alias("_h1"), F.xxhash64(F.lit(1), embedding, F.size(embedding)).alias("_h2")]


def near_links(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(_uid, links, root): per distinct vector and bucket, links found there first (copies counted) and the
    smallest connected vector. ``reps`` is a stored table (_uid, copies, embedding)."""
    bits, tables = plan(reps.count(), threshold)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            uid, copies = batch.column("_uid").to_numpy(), batch.column("copies").to_numpy()
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                keys = bucket_keys(unit([vectors[k] for k in at]), bits, tables)
                rows = np.repeat(at, tables)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.tile(np.arange(tables), len(at)) + dim * 1000), pa.array(keys.ravel()),
                    pa.array(uid[rows]), pa.array(copies[rows]),
                    batch.column("embedding").take(pa.array(rows))], ["_t", "_k", "_uid", "copies", "embedding"])

    kind = reps.schema["embedding"].dataType.simpleString()
    rows = reps.select("_uid", "copies", "embedding").mapInArrow(
        keyed, f"_t long, _k long, _uid long, copies long, embedding {kind}")
    size = rows.groupBy("_t", "_k").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    rows = rows.join(size, ["_t", "_k"])  # a vector alone in its bucket has no pair there
    parts = F.ceil(F.col("_n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("_uid"), parts).cast("int")
    rows = rows.withColumn("_own", own).withColumn("_to", F.explode(F.sequence(F.lit(0), parts - 1))).withColumns(
        {"_a": F.least("_own", "_to"), "_b": F.greatest("_own", "_to")})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in graph.runs(batches, ["_t", "_k", "_a", "_b"]):
            n = group.num_rows
            if n < 2:
                continue
            table, a, b = (group.column(c)[0].as_py() for c in ("_t", "_a", "_b"))
            x = unit(group.column("embedding").to_pylist())
            block = group.column("_own").to_numpy()
            every = np.arange(n)
            i, j = linked(x, every if a == b else every[block == a], every if a == b else every[block == b], threshold)
            if a == b:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            uid, copies = group.column("_uid").to_numpy(), group.column("copies").to_numpy()
            some = np.unique(np.concatenate([i, j]))
            keys = np.zeros((n, tables), np.int64)
            keys[some] = bucket_keys(x[some], bits, tables)
            first = (keys[i] == keys[j]).argmax(axis=1) == table % 1000
            links = np.bincount(i[first], copies[j[first]], n) + np.bincount(j[first], copies[i[first]], n)
            order = np.argsort(uid)
            place = np.empty(n, np.int64)
            place[order] = every
            root = uid[order][graph.local_roots(n, place[i], place[j])][place]
            yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array(links[some].astype(np.int64)),
                                              pa.array(root[some])], ["_uid", "links", "root"])

    dealt = rows.select("_t", "_k", "_a", "_b", "_own", "_uid", "copies", "embedding").repartition(
        "_t", "_k", "_a", "_b").sortWithinPartitions("_t", "_k", "_a", "_b", "_uid")
    return dealt.mapInArrow(match, "_uid long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    reps = durable(classes(rows))
    found = durable(near_links(reps, threshold))
    links = found.groupBy("_uid").agg(F.sum("links").alias("_links"))
    roots = graph.components(found.select(F.col("_uid").alias("a"), F.col("root").alias("b")))
    # components by class number; their id is the smallest vec_id in them
    known = reps.select("_uid", "rep", "copies", *marks("embedding")).join(
        roots.withColumnRenamed("node", "_uid"), "_uid", "left").withColumn("root", F.coalesce("root", "_uid"))
    least = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    per_class = known.join(least, "root").join(links, "_uid", "left").select(
        "_h1", "_h2", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return rows.select("vec_id", *marks("embedding")).join(per_class, ["_h1", "_h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.k, 0) AS n_links, least(e.vec_id, coalesce(root.m, e.vec_id)) AS component_id,
  least(e.vec_id, coalesce(root.m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN root ON root.a = e.vec_id"""
