"""Periodic runs of words, and texts without their repeats.

A run is a stretch of consecutive words with smallest period q and at least ``max(SHORTEST, TIMES * q)`` words that no
neighbouring word extends with that period. For every q of a text, places on a grid so fine that a run of that period holds one
of them and the place q further are candidates, about n / 3 * ln(n) of them for n words; a grammar from recompression
(``recompress``) tells how far the two agree to both sides, exactly and without suffix arrays. Words are told apart by 64-bit
hashes. Nothing is shuffled: texts are worked on where they lie, ``flat.CHUNK`` bytes or one longer text at a time.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; a text of any length is one
sequence; equal texts have equal runs, and rows with the same id stay rows of their own. ``scan`` keeps only the columns it is
asked for, ``report`` only ``doc_id``, so clashing names do not arise.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import flat
from .recompress import extensions, grammar

SHORTEST, TIMES = 6, 4
SLICE = 1 << 21  # candidates at a time


def _repeated(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` repeated by ``counts``, and the place within each repetition."""
    ends = np.cumsum(counts)
    return np.repeat(values, counts), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def candidates(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) on the grids of all texts at ``starts`` with ``sizes`` letters where both letters agree."""
    text, q = _repeated(np.arange(len(sizes)), np.where(sizes >= SHORTEST, sizes // TIMES, 0))
    q = q + 1
    step = np.maximum(SHORTEST, TIMES * q) - q
    count = (sizes[text] - q - 1) // step + 1
    total = np.cumsum(count)
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE, "right")))
        pair, i = _repeated(np.arange(lo, hi), count[lo:hi])
        at = starts[text[pair]] + i * step[pair]
        q_at = q[pair]
        same = letters[at] == letters[at + q_at]
        yield at[same], q_at[same]
        lo = hi


def runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, end, period) of the texts ``words[offsets[i]:offsets[i + 1]]``, by start and period; places
    count from the first word of the first text."""
    n = len(offsets) - 1
    marks = offsets + np.arange(n + 1)  # one before each text, one at the end
    letters = np.zeros(len(words) + n + 1, np.uint64)
    place = np.arange(len(words)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    letters[place] = words
    levels = grammar(letters, marks)
    letters = levels[0].names
    found = []
    for at, q in candidates(letters, marks[:-1] + 1, np.diff(offsets)):
        start = at - extensions(levels, at, at + q, left=True) + 1
        end = at + q + extensions(levels, at, at + q)
        long = end - start >= np.maximum(SHORTEST, TIMES * q)
        found.append((start[long], end[long], q[long]))
    start, end, q = (np.concatenate([f[j] for f in found] or [np.zeros(0, np.int64)]) for j in range(3))
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(q), bool)  # a stretch counts once, with its smallest period
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    text = np.searchsorted(marks, start) - 1
    order = np.lexsort((q, start))
    return (start - text - 1)[order], (end - text - 1)[order], q[order]


def repeats(n: int, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    turn = np.zeros(n + 1, np.int64)
    np.add.at(turn, start + q, 1)
    np.add.at(turn, end, -1)
    return np.cumsum(turn[:-1]) > 0


def joined(w: flat.Words, place: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts ``offsets`` of the words at ``place``, one space between words."""
    size = (w.ends - w.starts)[place] + 1
    last = offsets[1:][np.diff(offsets) > 0] - 1
    size[last] -= 1  # no space after the last word
    to = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(w.starts[place] - to[:-1], size) + np.arange(to[-1])
    data = np.append(w.data, np.uint8(32))[at]  # a word may be the last thing in the data
    space = np.ones(len(place), bool)
    space[last] = False
    data[(to[1:] - 1)[space]] = 32
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1,
                                 [None, pa.py_buffer(to[offsets].astype(np.int64)), pa.py_buffer(data)])


Order = Callable[[pa.Array, np.ndarray], np.ndarray]


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), order: Order | None = None) -> DataFrame:
    """``keep`` with ``n_words``, ``runs`` (start, length and period in words, by start and period) and ``collapsed``, the text
    without the words that repeat a run's first period, one space between words.

    ``order`` may replace the words before the scan: from the first column of ``keep`` and the offsets of the texts'
    words it gives, for each place, the place of the word to stand there.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in flat.text_chunks(batch.column("_text")):
                w = flat.words(data, offsets)
                part = batch.slice(lo, hi - lo)
                place = np.arange(len(w.hashes)) if order is None else order(part.column(0), w.offsets)
                start, end, q = runs(w.hashes[place], w.offsets)
                doc = np.searchsorted(w.offsets, start, "right") - 1
                kept = ~repeats(len(place), start, end, q)
                left = np.concatenate([[0], np.cumsum(kept)])[w.offsets]
                spans = pa.StructArray.from_arrays(
                    [pa.array(c) for c in (start - w.offsets[doc], end - start, q)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(np.diff(w.offsets)),
                     pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32), spans),
                     joined(w, place[kept], left)], [*keep, "n_words", "runs", "collapsed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(ids: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """Places of words after planting: where the checksum h of the decimal id is a multiple of 10, the words from a = h / 10 mod n
    on repeat their first p = 1 + (n - a) / (3 + h / 10 mod 8). A null id plants nothing."""
    place = np.arange(offsets[-1])
    for key, lo, hi in zip(ids.to_pylist(), offsets[:-1], offsets[1:]):
        h, n = zlib.crc32(str(key).encode()), int(hi - lo)
        if key is None or h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        place[lo + a:hi] = lo + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return place


def strongest(found: Column) -> Column:
    """The run with the greatest exact length / period, the first of equal ones; null without runs."""
    def better(best: Column, one: Column) -> Column:
        more = one.getField("length") * best.getField("period") > best.getField("length") * one.getField("period")
        return F.when(more, one).otherwise(best)
    return F.aggregate(found, F.get(found, F.lit(0)), better)


def report(docs: DataFrame) -> DataFrame:
    """Per document, after planting: its runs in number, the strongest one and digests of all runs and of the collapsed text."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), order=planted)
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
