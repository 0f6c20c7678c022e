"""Substring dedup: words covered by a ``width``-word window that also starts in a document of a smaller id go.

1. Every document picks anchors, short runs of words chosen by their hash (and the smallest of any window that has
   none). Equal windows have equal anchors, so a window can only repeat if all its anchors are in several documents.
2. Windows that pass are cut into passages: the windows that share their smallest run of words, their key. Equal
   windows have equal keys, so they meet in one shard. Passages with equal words are folded; all but their
   smallest document lose them whole.
3. Each shard joins the passages of its keys to a compressed FM-index. Backward search over its wavelet matrix gives
   matching statistics for the streamed passages; ranges of suffixes know their smallest document, and
   windows found in a smaller one than their own are reported as intervals. Indexes are built for at most
   ``SHARD`` words, or one key.
4. A key with more than ``HOT`` different passages is dealt anew by the whole words of each window.

Words are compared exactly (hashes only choose and route), as they are. Intervals refer to the input.

Defined results: a null text has no words; texts shorter than a window lose nothing. Null ids neither lose nor
cause anything. Rows of equal id do not remove from each other; each is judged against smaller ids. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ropewalk.session import durable

from . import flat, fmindex, graph
from .columns import sheltered

WIDTH = 50
GRAM = 8        # words of an anchor
SPARSE = 16     # one anchor in so many positions
SHARD = 200_000
HOT = 2_000
PLACE = 24      # least bits for the position of a word in its chunk


def grams(w: flat.Words, size: int = GRAM) -> np.ndarray:
    """Hash of the run of ``size`` words at every word of the chunk."""
    padded = np.concatenate([w.hashes, np.zeros(size, np.uint64)])
    out = np.zeros(len(w.hashes), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * flat.STEP + padded[j:j + len(out)]
    return flat.mix(out)


def window_starts(w: flat.Words, width: int) -> np.ndarray:
    """Whether a window of ``width`` words of one text begins at each word."""
    ends = np.repeat(w.offsets[1:], np.diff(w.offsets))
    return np.arange(len(ends)) + width <= ends


def smallest(g: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of the ``span`` grams from each position on, the leftmost among equals."""
    place = np.uint64(max(PLACE, len(g).bit_length()))
    key = (g >> place << place) | np.arange(len(g), dtype=np.uint64)
    full, size = np.concatenate([key, np.full(span, np.uint64(0xFFFFFFFFFFFFFFFF))]), 1
    while 2 * size <= span:
        full = np.minimum(full[:-size], full[size:])
        size *= 2
    out = np.minimum(full[:len(g)], full[span - size:span - size + len(g)])
    return (out & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)


def anchors(g: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sampled grams that a window holds, starts of the windows that hold none, the smallest gram of each of those)."""
    span = width - GRAM + 1
    sampled = g % np.uint64(SPARSE) == 0
    before = np.concatenate([[0], np.cumsum(sampled)])
    at = np.flatnonzero(starts)
    bare = at[before[at + span] == before[at]]
    near = np.concatenate([[0], np.cumsum(starts)])
    sampled &= near[1:] > near[np.maximum(np.arange(len(g)) - span + 1, 0)]
    return sampled, bare, smallest(g, span)[bare]


def anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """(gram, doc_id, th, place) of every anchor; ``place`` counts words from the start of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
            for lo, _, data, offsets in flat.text_chunks(batch.column("text")):
                w = flat.words(data, offsets)
                g = grams(w)
                chosen, _, low = anchors(g, window_starts(w, width), width)
                chosen[low] = True
                at = np.flatnonzero(chosen)
                doc = np.searchsorted(w.offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(g[at].view(np.int64)), pa.array(ids[lo + doc]), pa.array(names[lo + doc]),
                    pa.array((at - w.offsets[doc]).astype(np.int32))], ["gram", "doc_id", "th", "place"])

    return docs.mapInArrow(run, "gram long, doc_id long, th long, place int")


def passage_rows(marked: DataFrame, width: int) -> DataFrame:
    """(key, doc_id, th, start, windows, words) of the passages of documents whose repeated anchors are known.
    ``marked``: doc_id, th, text, places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
            places = batch.column("places")
            for lo, hi, data, offsets in flat.text_chunks(batch.column("text")):
                w = flat.words(data, offsets)
                g, starts = grams(w), window_starts(w, width)
                lone, bare, low = anchors(g, starts, width)
                own = places.slice(lo, hi - lo)
                sizes = np.diff(own.offsets.to_numpy())
                kept = own.flatten().to_numpy() + np.repeat(w.offsets[:-1], sizes)
                lone[kept] = False  # sampled grams that are in this document only
                known = np.zeros(len(g), bool)
                known[kept] = True
                starts[bare[~known[low]]] = False
                span = width - GRAM + 1
                alone = np.concatenate([[0], np.cumsum(lone)])
                at = np.flatnonzero(starts)
                at = at[alone[at + span] == alone[at]]
                if not len(at):
                    continue
                key = smallest(g, span)[at]
                new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(key) != 0)])
                head = np.flatnonzero(new)
                count = np.diff(np.concatenate([head, [len(at)]]))
                first = at[head]
                doc = np.searchsorted(w.offsets, first, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(g[key[head]].view(np.int64)), pa.array(ids[lo + doc]), pa.array(names[lo + doc]),
                    pa.array((first - w.offsets[doc]).astype(np.int32)), pa.array(count.astype(np.int32)),
                    spaced(w, first, count + width - 1)], ["key", "doc_id", "th", "start", "windows", "words"])

    return marked.mapInArrow(run, "key long, doc_id long, th long, start int, windows int, words string")


def spaced(w: flat.Words, first: np.ndarray, count: np.ndarray) -> pa.Array:
    """Runs of words, each joined by one space."""
    index = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = (w.ends - w.starts)[index]
    goes = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(goes, size) + within] = w.data[np.repeat(w.starts[index], size) + within]
    ends = np.cumsum(size + 1)[np.cumsum(count) - 1]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    # the space after each run stays with it; every run has it alike
    return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def windows_of(passages: DataFrame, width: int) -> DataFrame:
    """Passages (words, windows, doc_id, p1, p2) as one row per window: (words, doc_id, p1, p2, at)."""
    words = F.split(F.rtrim("words"), " ")
    rows = passages.select("doc_id", "p1", "p2", words.alias("_w"), F.posexplode(
        F.sequence(F.lit(1), F.col("windows"))).alias("at", "_from"))
    return rows.select(F.concat_ws(" ", F.slice("_w", F.col("_from"), F.lit(width))).alias("words"),
                       "doc_id", "p1", "p2", F.col("at").cast("int").alias("at"))


def shard_search(passages: DataFrame, width: int) -> DataFrame:
    """(p1, p2, from, to): windows of a passage that occur in a passage of a smaller document with its key."""
    def search(groups: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(groups).combine_chunks()
        words = table.column("words").combine_chunks()
        for _, _, data, offsets in flat.text_chunks(words, 1 << 40):
            w = flat.words(data, offsets)
        code = flat.word_texts(w, np.arange(len(w.starts))).dictionary_encode().indices.to_numpy() + 1
        n = np.diff(w.offsets)
        start = w.offsets[:-1] + np.arange(len(n))
        symbols = np.zeros(len(code) + len(n), np.int64)
        symbols[np.arange(len(code)) + np.repeat(np.arange(len(n)), n)] = code
        own = np.unique(table.column("doc_id").to_numpy(), return_inverse=True)[1]
        index = fmindex.FMIndex(symbols, np.repeat(own, n + 1))
        q, a, b = fmindex.earlier_windows(index, symbols, start, table.column("windows").to_numpy().astype(np.int64), own, width)
        if not len(q):
            return None
        p1, p2 = (table.column(c).to_numpy() for c in ("p1", "p2"))
        return pa.RecordBatch.from_arrays([pa.array(p1[q]), pa.array(p2[q]), pa.array(a.astype(np.int32)),
                                           pa.array(b.astype(np.int32))], ["p1", "p2", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in graph.runs(batches, ["key"]):
            if group.num_rows > 1:  # a passage alone with its key has nothing to match
                held.append(group)
                size += int(group.column("windows").to_numpy().sum()) + group.num_rows * width
            if size >= SHARD:
                if (out := search(held)) is not None:
                    yield out
                held, size = [], 0
        if held and (out := search(held)) is not None:
            yield out

    rows = passages.select("key", "doc_id", "p1", "p2", "windows", "words").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "p1 long, p2 long, from int, to int")


def intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, th, from, to): word intervals, end excluded, to remove from the text whose hash is ``th``."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = anchor_rows(rows, width)
    repeated = found.groupBy("gram").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).filter("_lo < _hi")
    places = found.join(repeated.select("gram"), "gram").groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_set("place")).alias("places"))
    marked = rows.join(places, ["doc_id", "th"]).select("doc_id", "th", "text", "places")
    names = [F.xxhash64("words").alias("p1"), F.xxhash64(F.lit(7), "words").alias("p2")]
    passages = durable(passage_rows(marked, width).select("*", *names))
    kinds = passages.groupBy("key", "words", "windows", "p1", "p2").agg(F.min("doc_id").alias("doc_id"))
    kinds = durable(kinds)
    counts = kinds.groupBy("key").count().filter("count > 1")
    shards = kinds.join(counts.filter(F.col("count") <= HOT).select("key"), "key")
    matched = shard_search(shards, width)

    hot = counts.filter(F.col("count") > HOT).select("key")
    single = windows_of(kinds.join(hot, "key"), width)
    least = single.groupBy("words").agg(F.min("doc_id").alias("_first"))
    dealt = single.join(least, "words").filter(F.col("doc_id") > F.col("_first")).select(
        "p1", "p2", F.col("at").alias("from"), F.col("at").alias("to"))
    partial = durable(matched.union(dealt))

    own = passages.select("doc_id", "th", "start", "windows", "p1", "p2").join(
        kinds.select("p1", "p2", F.col("doc_id").alias("_first")), ["p1", "p2"])
    whole = own.filter(F.col("doc_id") > F.col("_first")).select(
        "doc_id", "th", F.col("start").alias("from"), (F.col("start") + F.col("windows") - 1 + width).alias("to"))
    some = own.filter(F.col("doc_id") == F.col("_first")).join(partial, ["p1", "p2"]).select(
        "doc_id", "th", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to") + width).alias("to"))
    return whole.union(some)


def cleaned(docs: DataFrame, width: int = WIDTH, rejoin: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``text`` reduced to the kept words, joined by one space, and ``n_words``,
    ``n_removed``, in place of columns of these two names; others pass through, whatever their names. A text that loses nothing
    is given as its words too, or as it was without ``rejoin``."""
    docs, back = sheltered(docs.drop("n_words", "n_removed"), ("doc_id", "text"))
    gone = durable(intervals(docs, width).groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("from", "to")).alias("_gone")).withColumnsRenamed({"doc_id": "_id", "th": "_th"}))
    keyed = docs.withColumn("_own", F.xxhash64("text")).join(
        gone, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_own") == F.col("_th")), "left")
    plain = keyed.select(*docs.columns, F.col("_gone.from").alias("_from"), F.col("_gone.to").alias("_to"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("_from").to_pylist(), batch.column("_to").to_pylist()
            for lo, hi, data, offsets in flat.text_chunks(batch.column("text")):
                w = flat.words(data, offsets)
                edge = np.zeros(len(w.starts) + 1, np.int64)
                for i in range(lo, hi):
                    if a[i]:
                        np.add.at(edge, np.array(a[i]) + w.offsets[i - lo], 1)
                        np.add.at(edge, np.array(b[i]) + w.offsets[i - lo], -1)
                keep = np.cumsum(edge)[:-1] == 0
                counts = np.add.reduceat(np.append(keep, False), np.minimum(w.offsets[:-1], len(keep)), dtype=np.int64)
                n = np.diff(w.offsets)
                counts = np.where(n > 0, counts, 0)
                text = joined(w, np.flatnonzero(keep), counts)
                part = batch.slice(lo, hi - lo)
                cols = {c: part.column(c) for c in names if c in part.schema.names}
                if not rejoin:
                    text = pa.compute.if_else(pa.array(counts == n), cols["text"], text)
                cols |= {"text": text, "n_words": pa.array(n), "n_removed": pa.array(n - counts)}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return back(plain.mapInArrow(run, schema), "n_words", "n_removed")


def joined(w: flat.Words, index: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The words at ``index``, ``counts`` of them per text, joined by one space."""
    size = (w.ends - w.starts)[index]
    last = np.zeros(len(index), bool)
    full = counts[counts > 0]
    last[np.cumsum(full) - 1] = True
    room = size + ~last
    goes = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(goes, size) + within] = w.data[np.repeat(w.starts[index], size) + within]
    offsets = np.concatenate([[0], np.cumsum(room)])[np.concatenate([[0], np.cumsum(counts)])]
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def report(docs: DataFrame) -> DataFrame:
    rows = cleaned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(0, len(w) - 49)) AS p, w FROM w WHERE len(w) >= 50),
text AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 50], ' ') AS t FROM win),
low AS (SELECT t, min(doc_id) AS m FROM text GROUP BY t),
hit AS (SELECT doc_id, list(p) AS hits FROM text JOIN low USING (t) WHERE doc_id > m GROUP BY doc_id),
gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(hits, lambda h: range(h, h + 50)))) AS gone FROM hit),
kept AS (
  SELECT w.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r,
    CASE WHEN gone IS NULL THEN w
      ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i - 1))) END AS k
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept"""
