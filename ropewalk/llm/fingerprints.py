"""Document fingerprints: MinHash signatures over word shingles.

``signatures`` computes many permutations of the 32-bit universe (``a*x + b`` with odd ``a``) over
the shingles of a whole batch. A fingerprint keeps 16 bits of each minimum as hex, and the likeness
of two is the share of equal positions, corrected for chance equality; it estimates the Jaccard
similarity of the shingle sets with a standard error of at most 0.045 at 128 permutations.

Nulls and empty texts share one constant fingerprint (likeness 1 to each other, near 0 to others).
Texts below ``shingle`` words count as one shingle. Equal texts, and texts that differ in white
space or ASCII case only, have equal fingerprints. Other columns of the input are ignored.

``near_duplicates`` joins bands of the signatures in Spark and verifies the shingle sets; a pair at
the threshold of 0.8 shares no band with a chance below 0.0001.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ropewalk.session import durable

from . import flat, jaccard

PERMUTATIONS = 128
SHINGLE = 5


def permutations(count: int = PERMUTATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 1 << 32, count, dtype=np.uint32))


def signatures(texts: pa.Array, count: int = PERMUTATIONS, k: int = SHINGLE, seed: int = 7) -> np.ndarray:
    """Minima of ``count`` permutations per text, uint32 of shape (texts, count)."""
    a, b = permutations(count, seed)
    out = np.full((len(texts), count), np.uint32(0xFFFFFFFF))
    for lo, hi, data, offsets in flat.text_chunks(texts, 1 << 19):
        hashes, at = flat.shingles(flat.words(data, offsets, lower=True), k)
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            continue
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        values = np.empty_like(x)
        cut = at[full]
        for j in range(count):
            np.multiply(x, a[j], out=values)
            np.add(values, b[j], out=values)
            out[lo + full, j] = np.minimum.reduceat(values, cut)
    return out


def prints(sig: np.ndarray) -> np.ndarray:
    """16 mixed bits of each minimum (its own top bits are nearly all zero)."""
    with np.errstate(over="ignore"):
        return ((sig * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    chance = 2.0 ** -16
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def hex_of(p: np.ndarray) -> list[str]:
    raw, width = p.tobytes().hex(), p.shape[1] * 4
    return [raw[i:i + width] for i in range(0, len(raw), width)]


def ordered_buckets(docs: DataFrame, parts: int, key: str = "doc_id") -> DataFrame:
    """Rows in descending key order, cut into ``_b`` buckets, with the head of each bucket copied
    to the end of the bucket before (``_copy``), so that each row meets its successor in its own
    task. The head of the first bucket goes to the end of the last. Only bucket bounds reach the driver.
    """
    bounds = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)
                      .alias("q")).first().q or []
    cuts = sorted(set(bounds), reverse=True)
    bucket = F.lit(len(cuts) + 1)  # null keys come last
    if cuts:
        lits = F.array(*[F.lit(c) for c in cuts])
        bucket = F.when(F.col(key).isNull(), bucket).otherwise(
            F.size(F.filter(lits, lambda c: c >= F.col(key))))
    else:
        bucket = F.when(F.col(key).isNull(), bucket).otherwise(F.lit(0))
    rows = docs.withColumn("_b", bucket.cast("int"))
    heads = sorted((r._b, r.m) for r in rows.groupBy("_b").agg(F.max(key).alias("m")).collect())
    # per bucket its head's key (null: none, or the bucket of null keys) and the bucket before it
    first, before = [None] * (len(cuts) + 2), [None] * (len(cuts) + 2)
    for i, (b, m) in enumerate(heads):
        first[b], before[b] = m, heads[i - 1][0]
    kind = docs.schema[key].dataType.simpleString()
    head = F.get(F.array(*map(F.lit, first)).cast(f"array<{kind}>"), F.col("_b")).eqNullSafe(F.col(key))
    at = F.when(head, F.get(F.array(*map(F.lit, before)).cast("array<int>"), F.col("_b")))
    return rows.withColumn("_to", at).select(
        "*", F.explode(F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("c"))))
                       .otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("c")),
                                          F.struct(F.col("_to").alias("b"), F.lit(True).alias("c"))))).alias("_at")
    ).select(*docs.columns, F.col("_at.b").alias("_b"), F.col("_at.c").alias("_copy"))


def edited(text: str, nxt: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + nxt[:half]


def with_next(docs: DataFrame, count: int = PERMUTATIONS, k: int = SHINGLE) -> DataFrame:
    """Fingerprint of every text, of its edited text (second half replaced from the next document) and
    their likeness. ``docs`` has ``doc_id`` and ``text``; extra columns are ignored. Rows with equal
    ids are ordered by a hash of their text; null ids come last. One shuffle of the texts."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = (ordered_buckets(base, 2 * parts)
            .withColumn("_h", F.xxhash64("text"))
            .repartition(parts, "_b")
            .sortWithinPartitions("_b", "_copy", F.desc_nulls_last("doc_id"), "_h", "text")
            .select("doc_id", "text", "_b", "_copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: (doc_id, text, bucket, copy, fingerprint)
        for batch in batches:
            for piece in _pieces(batch):
                sig = prints(signatures(piece.column("text"), count, k))
                ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
                bucket, copy = piece.column("_b").to_pylist(), piece.column("_copy").to_pylist()
                if held:
                    ids, texts, bucket, copy = [held[0], *ids], [held[1], *texts], [held[2], *bucket], [held[3], *copy]
                    sig = np.concatenate([held[4][None], sig])
                at = [i for i in range(len(ids) - 1) if not copy[i] and bucket[i] == bucket[i + 1]]
                held = (ids[-1], texts[-1], bucket[-1], copy[-1], sig[-1])
                if not at:
                    continue
                new = [edited(texts[i], texts[i + 1]) for i in at]
                own, nxt = sig[at], sig[[i + 1 for i in at]]
                changed = prints(signatures(pa.array(new, pa.string()), count, k))
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    pa.array(hex_of(own)), pa.array(hex_of(changed)),
                    pa.array(likeness(own, changed)), pa.array(likeness(own, nxt))],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                     "near_edited", "near_next"])

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double")


BANDS, ROWS = 25, 5


def bands(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(tok, s1, s2): hashes of the signature bands of every document with words, and the name of its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, at, _ in jaccard.sets(batch.column("text"), k):
                full = np.flatnonzero(np.diff(at))
                sig = signatures(batch.column("text").slice(lo, hi - lo), BANDS * ROWS, k)[full].astype(np.uint64)
                s1, s2 = jaccard.digest(hashes, at)
                tok = np.arange(BANDS, dtype=np.uint64) * flat.BASE
                with np.errstate(over="ignore"):
                    for j in range(ROWS):
                        tok = tok * flat.STEP + sig[:, j::ROWS][:, :BANDS]
                yield pa.RecordBatch.from_arrays([
                    pa.array(flat.mix(tok).ravel().view(np.int64)), pa.array(np.repeat(s1[full], BANDS)),
                    pa.array(np.repeat(s2[full], BANDS))], ["tok", "s1", "s2"])

    return docs.select("text").mapInArrow(run, "tok long, s1 long, s2 long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, s1, s2, root) per row, as ``jaccard.components_of``, by signature bands."""
    _, each, kinds = jaccard.classes(docs, k)
    rows = jaccard.shared(bands(docs, k), "s1").select("tok", "s1", "s2").distinct()
    index = durable(rows.join(kinds.select("s1", "s2", "uid", "n"), ["s1", "s2"]).select(
        "tok", "uid", "n", F.lit(1).alias("l"), F.lit(0).alias("pos")))
    return jaccard.named(each, kinds, jaccard.connect(index, docs, kinds, k, percent, prefix=False))


def _pieces(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text, at least one row each."""
    for lo, hi, _, _ in flat.text_chunks(batch.column("text"), size):
        yield batch.slice(lo, hi - lo)
