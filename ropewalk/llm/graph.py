"""Connected components of a link table, and groups of a sorted stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ropewalk.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns ``a``, ``b``, long): root is the smallest node reachable.

    Alternates two steps: every node links its larger neighbours to the smallest of its neighbourhood, then its
    smaller ones. Each is a minimum per node (combined before the shuffle) joined back; no neighbour list is built.
    Rounds are logarithmic in the size of a component. Self links and null ends are ignored.
    """
    state = durable(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(state.join(low, "a").select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        large = durable(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        state = durable(small.select("a", F.col("m").alias("b")).union(
            small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
                state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of a stream that is sorted by ``keys`` (integer columns); a group is kept until it ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = last is not None and first != last
        cuts = np.flatnonzero(new)
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            yield _joined(held)
            held, at = [], int(cut)
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
