"""Which texts of a record are contained in an earlier text of the same record.

A text is found through one of its anchors: short byte strings that are smallest, by hash, among their neighbours. Every text that
contains another holds all of its anchors, so looking up the rarest one in the record gives every candidate; ``contains``
decides. Texts too short for such anchors use all of their 3, 2 or 1 byte strings, which the other texts of their record then list too.
The index is keyed by record and anchor, so a record that holds most texts is spread over its anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable

#: (bytes of an anchor, neighbours it is smallest of), long texts first
LEVELS = ((8, 16), (3, 1), (2, 1), (1, 1))

PIECE = 1 << 18  # bytes of text whose anchors are held at once


def anchors(data: bytes, size: int, among: int) -> np.ndarray:
    """Distinct anchor hashes of one text."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(raw) < size + among - 1:
        return np.zeros(0, np.int64)
    n = len(raw) - size + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x100000001B3) + raw[i:i + n]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    if among > 1:
        windows = np.lib.stride_tricks.sliding_window_view(h, among)
        h = windows.min(axis=1)
    return np.unique(h).view(np.int64)


def _level(size):
    out = F.lit(len(LEVELS) - 1)
    for i in reversed(range(len(LEVELS) - 1)):
        out = F.when(size >= sum(LEVELS[i]) - 1, i).otherwise(out)
    return out


def list_anchors(batches: Iterator[pa.RecordBatch], size: int, among: int) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts of each batch, a bounded number of bytes of text at a time: a text of n bytes may have n anchors."""
    names = ["id", "seq", "size", "gram"]
    for batch in batches:
        ends = np.cumsum(batch.column("size").fill_null(0).to_numpy())
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + PIECE, "right")))
            part = batch.slice(start, end - start)
            found = [anchors((b.as_py() or "").encode(), size, among) for b in part.column("body")]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in names[:3]), pa.array(np.concatenate(found))], names)
            start = end


def _listed(rows: DataFrame, level: int) -> DataFrame:
    """(id, seq, size, gram) of rows (id, seq, size, body)."""
    size, among = LEVELS[level]
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "seq", "size", "body").mapInArrow(
        lambda batches: list_anchors(batches, size, among), f"id {kind}, seq long, size long, gram long")


def uncontained(parts: DataFrame) -> DataFrame:
    """Rows of ``parts(id, seq, body)`` (seq unique within id) whose body no body of the same id with a smaller seq contains. An
    empty body is contained in any other one, and stays when it comes first. A body that would only occur across two others
    stays."""
    rows = durable(parts.select("id", F.col("seq").cast("long").alias("seq"), "body",
                                F.octet_length("body").cast("long").alias("size")))
    asked = rows.withColumn("_level", _level(F.col("size"))).filter("size > 0")
    levels = [r[0] for r in asked.select("_level").distinct().collect()]  # at most four
    first = rows.groupBy("id").agg(F.min("seq").alias("_first"))
    gone = rows.filter("size = 0").join(first, "id").filter(F.col("seq") > F.col("_first")).select("id", "seq")
    for level in sorted(levels):
        guests = durable(asked.filter(F.col("_level") == level))
        hosts = durable(_listed(rows.join(guests.select("id").distinct(), "id", "left_semi"), level))
        counts = hosts.groupBy("id", "gram").agg(F.count("*").alias("n"))
        # a guest is a host too, so its anchors are listed already
        own = hosts.join(guests.select("id", "seq"), ["id", "seq"], "left_semi").join(counts, ["id", "gram"])
        rarest = own.groupBy("id", "seq").agg(F.min(F.struct("n", "gram")).alias("_a"), F.first("size").alias("size")).filter(
            F.col("_a.n") > 1).select("id", "seq", "size", F.col("_a.gram").alias("gram"))
        host = hosts.select("id", "gram", F.col("seq").alias("_h"), F.col("size").alias("_hs"))
        pairs = rarest.join(host, ["id", "gram"]).filter(
            (F.col("_h") < F.col("seq")) & (F.col("_hs") >= F.col("size"))).select("id", "seq", "_h")
        texts = rows.select("id", F.col("seq").alias("_h"), F.col("body").alias("_host"))
        gone = gone.unionByName(pairs.join(rows.select("id", "seq", "body"), ["id", "seq"]).join(texts, ["id", "_h"]).filter(
            F.contains("_host", "body")).select("id", "seq"))
    return rows.join(gone.distinct(), ["id", "seq"], "left_anti").select("id", "seq", "body")
