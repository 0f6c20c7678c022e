"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles. Two documents link when intersection / union is at least
``percent`` / 100. Shingles are ordered from rare to frequent, by count sketches of words and of shingles over all
documents: a shingle is as frequent as its words make it by chance, or as its own count says if that stands out. So
a set of n shingles that links must share l of its first n - ceil(percent * n / 100) + l shingles with
its partner, for every l. Each document picks its own l: a longer prefix costs index entries, but demands more
shared entries before the sets are compared; the choice weighs the candidates the sketch foresees. A pair is
compared when it shares at least the smaller l of the two.

Work stays near linear in large groups: equal sets are folded first; then every prefix shingle proposes only
pairs with its smallest member, whose verified links give first components; only pairs of different
components are proposed after that, and those must share as many prefix shingles as the sizes of the two demand.
A bitmap of parities per set bounds the symmetric difference from below, which rules out nearly all pairs under the
threshold inside the join. All these filters are exact, so no link between different texts is lost, though links
inside a component are not all listed.

Defined results: a text without words (or null) has the empty set and links with nothing; a text of fewer words
than ``k`` has its whole sequence as its one shingle. Equal texts link. ``component_id`` is the smallest id
reachable, null ids aside. Rows equal in id and text are one document for ``deduplicated``. An empty table gives an
empty table. ``components_of`` reads ``doc_id`` and ``text`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ropewalk.session import durable

from . import flat, graph
from .columns import sheltered

SLOTS = 1 << 20      # counters of the shingle sketch: 4 MB whatever the input
WORDS = 1 << 18      # counters of the word sketch: 1 MB
PIECE = 1 << 14      # counters per row on their way
LONGEST = 4          # largest l
PARITIES = 8         # 64-bit words of the parity bitmap
SHIPPED = 200_000    # ids that may be broadcast to pick texts; beyond, a shuffle join
OPEN, PROBE, VERIFY = 1.0, 0.5, 0.02  # cost of an index entry, of a proposed pair, of a compared shingle


def sets(texts: pa.Array, k: int, word_logs: np.ndarray | None = None
         ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their distinct shingles, text by text in hash order: (from, to, hashes, offsets, extra). ``extra``
    is the sum of each shingle's word logarithms, or without ``word_logs`` the hashes of all words."""
    for lo, hi, data, offsets in flat.text_chunks(texts):
        w = flat.words(data, offsets, lower=True)
        hashes, at = flat.shingles(w, k)
        doc = np.repeat(np.arange(hi - lo), np.diff(at))
        order = np.lexsort((hashes, doc))
        extra = w.hashes if word_logs is None else _log_sums(w, at, k, word_logs)[order]
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[new], doc[new]
        yield (lo, hi, hashes, np.searchsorted(doc, np.arange(hi - lo + 1)),
               extra if word_logs is None else extra[new])


def _log_sums(w: flat.Words, at: np.ndarray, k: int, word_logs: np.ndarray) -> np.ndarray:
    """Sum of the words' logarithms per shingle, added in word order, so that equal shingles have equal sums."""
    logs = np.concatenate([word_logs[(w.hashes & np.uint64(WORDS - 1)).astype(np.int64)], np.zeros(k)])
    counts = np.diff(at)
    first = np.repeat(w.offsets[:-1] - at[:-1], counts) + np.arange(int(at[-1]))
    end = np.repeat(w.offsets[1:], counts)
    out = np.zeros(len(first))
    for j in range(k):
        out += np.where(first + j < end, logs[np.minimum(first + j, len(logs) - 1)], 0.0)
    return out


def digest(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set: two sums of mixed hashes."""
    with np.errstate(over="ignore"):
        out = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.mix(hashes ^ np.uint64(salt)))])
            out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1] & np.int64(-8)  # three bits are left free for l


def parities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, PARITIES) words; bit b says whether an odd number of the set's shingles falls on b."""
    n, width = len(at) - 1, PARITIES * 64
    place = (flat.mix(hashes) % np.uint64(width)).astype(np.int64) + np.repeat(np.arange(n) * width, np.diff(at))
    odd = (np.bincount(place, minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, PARITIES)


def least(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles a set of ``n`` must share with any partner."""
    return (percent * n + 99) // 100


def survey(docs: DataFrame, k: int) -> DataFrame:
    """One pass: rows (doc_id, n, s1, s2, bits) of the documents, and rows (slot, raw) of partial sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "s1", "s2", "bits", "slot", "raw"]
        kind = pa.list_(pa.int64())
        counts, uses, some = np.zeros(SLOTS, np.int32), np.zeros(WORDS, np.int32), False
        for batch in batches:
            for lo, hi, hashes, at, words in sets(batch.column("text"), k):
                np.add.at(uses, (words & np.uint64(WORDS - 1)).astype(np.int64), 1)
                np.add.at(counts, (hashes & np.uint64(SLOTS - 1)).astype(np.int64), 1)
                some, m = True, hi - lo
                s1, s2 = digest(hashes, at)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, m), pa.array(np.diff(at).astype(np.int64)), pa.array(s1), pa.array(s2),
                    pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * PARITIES, pa.int32()), pa.array(parities(hashes, at).ravel())),
                    pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if some:
            raw, m = np.concatenate([counts, uses]), (SLOTS + WORDS) // PIECE
            yield pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, kind), pa.array(range(m), pa.int32()), pa.array(
                [raw[i * PIECE:(i + 1) * PIECE].tobytes() for i in range(m)], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, s1 long, s2 long, bits array<long>, slot int, raw binary")


def sketch_of(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The summed sketches of shingles and words; each piece is added up in its own task and comes to the driver once."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column("slot").to_pylist(), batch.column("raw").to_pylist()):
                part = np.frombuffer(raw, np.int32).astype(np.int64)
                total[slot] = total[slot] + part if slot in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
                [v.tobytes() for v in total.values()], pa.binary())], ["slot", "raw"])

    out = np.zeros(SLOTS + WORDS, np.int64)
    parts = surveyed.filter(F.col("slot").isNotNull()).select("slot", "raw")
    for r in parts.repartition("slot").mapInArrow(add, "slot int, raw binary").collect():  # SLOTS + WORDS counters in all
        out[r.slot * PIECE:(r.slot + 1) * PIECE] = np.frombuffer(r.raw, np.int64)
    return out[:SLOTS], out[SLOTS:]


def choose(n: np.ndarray, freq: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """l of each set. ``freq``: estimated other documents per shingle, in order from rare to frequent."""
    need = least(n, percent)
    sums = np.concatenate([[0.0], np.cumsum(freq)])
    best, pick = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for l in range(1, LONGEST + 1):  # noqa: E741
        size = np.minimum(n - need + l, n)
        foreseen = sums[at[:-1] + size] - sums[at[:-1]]
        cost = OPEN * size + PROBE * foreseen + VERIFY * n * foreseen * 0.3 ** (l - 1)
        better = (cost < best) & (l <= np.maximum(need, 1))
        best, pick = np.where(better, cost, best), np.where(better, l, pick)
    return pick


def expected(count: np.ndarray, logs: np.ndarray, mean: float, words: float, k: int) -> np.ndarray:
    """Documents a shingle is foreseen in: by the chance of its words, or by its count where that stands out."""
    chance = np.exp(np.minimum(logs - (k - 1) * np.log(max(words, 1.0)), 40.0))
    return np.maximum(chance, count - mean - 4 * np.sqrt(mean) - 1)


def prefixes(docs: DataFrame, sketch: tuple[np.ndarray, np.ndarray], k: int, percent: int) -> DataFrame:
    """(tok, s1, s2l, pos): the prefix shingles of every document with their place in its order; l, the number it
    asks to share, is added to s2."""
    mean, words = float(sketch[0].sum()) / SLOTS, float(sketch[1].sum())
    shipped = docs.sparkSession.sparkContext.broadcast((sketch[0].astype(np.int32), np.log(sketch[1] + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, word_logs = shipped.value
        for batch in batches:
            for _, _, hashes, at, logs in sets(batch.column("text"), k, word_logs):
                s1, s2 = digest(hashes, at)
                n = np.diff(at)
                doc = np.repeat(np.arange(len(n)), n)
                foreseen = expected(counts[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)], logs, mean, words, k)
                level = np.floor(2 * np.log2(np.maximum(foreseen, 2.0 ** -40))).astype(np.int64)
                order = np.lexsort((hashes, level, doc))
                hashes, foreseen = hashes[order], foreseen[order]
                pick = choose(n, foreseen, at, percent)
                size = np.minimum(n - least(n, percent) + pick, n) * (n > 0)
                row = np.repeat(np.arange(len(n)), size)
                where = np.repeat(at[:-1], size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes[where].view(np.int64)), pa.array(s1[row]), pa.array((s2 + pick)[row]),
                    pa.array((where - at[row]).astype(np.int32))], ["tok", "s1", "s2l", "pos"])

    return docs.select("text").mapInArrow(run, "tok long, s1 long, s2l long, pos int")


def shared(rows: DataFrame, by: str) -> DataFrame:
    """Rows of the shingles that more than one value of ``by`` has, with the smallest ``uid`` there as ``hub``."""
    some = rows.groupBy("tok").agg(F.min(by).alias("_lo"), F.max(by).alias("_hi")).filter("_lo <> _hi")
    return rows.join(some.select("tok", F.col("_lo").alias("hub")), "tok")


def overlap(percent: int) -> Column:
    """Shingles the pair (n, _n) must have in common."""
    return F.ceil(F.lit(percent) * (F.col("n") + F.col("_n")) / F.lit(100.0 + percent) - F.lit(1e-9))


def near_sizes(percent: int) -> Column:
    return F.lit(100) * F.least("n", "_n") >= F.lit(percent) * F.greatest("n", "_n")


def can_link(percent: int) -> Column:
    """Sizes and parity bitmaps of (n, bits) and (_n, _bits) allow the threshold."""
    sizes = near_sizes(percent)
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("_bits")[i])) for i in range(PARITIES)), F.lit(0))
    return sizes & (apart <= F.col("n") + F.col("_n") - F.lit(2) * overlap(percent))


def prefix_size(n: str, l: str, percent: int) -> Column:  # noqa: E741
    return F.least(F.col(n), F.col(n) - F.floor((F.lit(percent) * F.col(n) + 99) / F.lit(100)) + F.col(l))


def verified(pairs: DataFrame, docs: DataFrame, kinds: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    full = durable(full_sets(docs, kinds, pairs, k))
    one = full.select(F.col("uid").alias("a"), F.col("shingles").alias("_x"))
    two = full.select(F.col("uid").alias("b"), F.col("shingles").alias("_y"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("_x", "_y"))
    return durable(both.filter(F.lit(100) * common >= F.lit(percent) * (F.size("_x") + F.size("_y") - common)).select("a", "b"))


def classes(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survey, documents, classes): documents as (doc_id, n, s1, s2, bits); classes of equal sets as (uid, s1, s2, n,
    bits, rep), rep the smallest id."""
    surveyed = durable(survey(docs, k))
    each = surveyed.filter(F.col("slot").isNull()).select("doc_id", "n", "s1", "s2", "bits")
    kinds = durable(each.filter("n > 0").groupBy("s1", "s2").agg(
        F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("rep"))
        .withColumn("uid", F.monotonically_increasing_id()))
    return surveyed, each, kinds


def index_of(docs: DataFrame, surveyed: DataFrame, kinds: DataFrame, k: int, percent: int) -> DataFrame:
    """(tok, uid, n, l, pos) for the prefix shingles that several classes have."""
    rows = shared(prefixes(docs, sketch_of(surveyed), k, percent), "s1").select("tok", "s1", "s2l", "pos").distinct()
    rows = rows.select("tok", "pos", "s1", F.col("s2l").bitwiseAND(F.lit(-8)).alias("s2"),
                       F.col("s2l").bitwiseAND(F.lit(7)).cast("int").alias("l"))
    return durable(rows.join(kinds.select("s1", "s2", "uid", "n"), ["s1", "s2"]).select("tok", "uid", "n", "l", "pos"))


def unsettled(index: DataFrame, found: DataFrame) -> DataFrame:
    """(tok, uid, n, l, pos, root) of the shingles that several of the components made by ``found`` have."""
    part = graph.components(found).withColumnRenamed("node", "uid")
    rest = index.join(part, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    return shared(rest, "root").select("tok", "uid", "n", "l", "pos", "root")


def early(percent: int) -> Column:
    """The first shingle two sets share stands early in both: each has as many after it as the pair must share."""
    return (F.col("pos") <= F.col("n") - overlap(percent)) & (F.col("_pos") <= F.col("_n") - overlap(percent))


def connect(index: DataFrame, docs: DataFrame, kinds: DataFrame, k: int, percent: int, prefix: bool = True) -> DataFrame:
    """Verified links (a, b) of classes that share a ``tok``, enough of them to connect all that link. With ``prefix``
    the toks are prefix shingles and a pair must share as many as its sizes demand."""
    mine = kinds.select("uid", "n", "bits")
    other = mine.select(*[F.col(c).alias(f"_{c}") for c in mine.columns])
    low = index.groupBy("tok").agg(F.min(F.struct("uid", "n")).alias("_h"), F.max("uid").alias("_hi"))
    low = low.filter(F.col("_h.uid") < F.col("_hi")).select("tok", F.col("_h.uid").alias("_uid"), F.col("_h.n").alias("_n"))
    hubs = index.join(low, "tok").filter((F.col("uid") != F.col("_uid")) & near_sizes(percent)).select("uid", "_uid").distinct()
    tried = durable(hubs.join(mine, "uid").join(other, "_uid").filter(can_link(percent)).select(
        F.col("_uid").alias("a"), F.col("uid").alias("b")))
    found = verified(tried, docs, kinds, k, percent)

    rest = unsettled(index, found)
    if prefix:
        rest = rest.join(rest.groupBy("uid").agg(F.count("*").alias("c")), "uid")
    rest = durable(rest)
    # the bitmaps go into the join, so that it makes rows of the pairs they leave only
    known = rest.join(mine.select("uid", "bits"), "uid")
    left = known.select("tok", *[F.col(c).alias(f"_{c}") for c in known.columns if c != "tok"])
    fits = (known["tok"] == left["tok"]) & (F.col("uid") < F.col("_uid")) & (F.col("root") != F.col("_root"))
    if prefix:
        # each has as many shingles as the pair must share
        fits = fits & early(percent) & (demand(percent) <= F.least("c", "_c"))
    more = known.join(left, fits & can_link(percent)).select("uid", "_uid").distinct()
    more = more.join(tried.select(F.col("a").alias("uid"), F.col("b").alias("_uid")), ["uid", "_uid"], "left_anti")
    if prefix:
        # a row per pair, not one per shingle it shares
        own = rest.groupBy("uid").agg(F.collect_set("tok").alias("toks"), F.first("n").alias("n"), F.first("l").alias("l"))
        both = more.join(own, "uid").join(own.select(*[F.col(c).alias(f"_{c}") for c in own.columns]), "_uid")
        more = durable(both.filter(F.size(F.array_intersect("toks", "_toks")) >= demand(percent)).select("uid", "_uid"))
    more = more.select(F.col("uid").alias("a"), F.col("_uid").alias("b"))
    return found.union(verified(more, docs, kinds, k, percent))


def demand(percent: int) -> Column:
    """Prefix shingles a pair (n, l), (_n, _l) shares at least when it links."""
    return F.greatest(F.lit(1), F.least(overlap(percent) - F.col("n") + prefix_size("n", "l", percent),
                                        overlap(percent) - F.col("_n") + prefix_size("_n", "_l", percent)))


def full_sets(docs: DataFrame, kinds: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(uid, shingles) of the classes in ``pairs``, from the text of their smallest id."""
    ids = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    want = durable(ids.join(kinds, "uid").select("uid", "rep", "s1", "s2"))
    few = F.broadcast(want) if want.count() <= SHIPPED else want
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        few, F.col("doc_id").eqNullSafe(F.col("rep"))).select("uid", "s1", "s2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, at, _ in sets(batch.column("text"), k):
                s1, s2 = digest(hashes, at)
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([
                    own.column("uid"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64))),
                    pa.array((s1 == own.column("s1").to_numpy()) & (s2 == own.column("s2").to_numpy()))],
                    ["uid", "shingles", "_ok"])

    return texts.mapInArrow(run, "uid long, shingles array<long>, _ok boolean").filter("_ok").drop("_ok") \
        .dropDuplicates(["uid"])


def components_of(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, s1, s2, root) per row of ``docs``; ``root`` numbers the components (null for
    the empty set), since different texts may share an id."""
    surveyed, each, kinds = classes(docs, k)
    index = index_of(docs, surveyed, kinds, k, percent)
    return named(each, kinds, connect(index, docs, kinds, k, percent))


def named(each: DataFrame, kinds: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with their component, from the links of their classes."""
    roots = graph.components(found).withColumnRenamed("node", "uid")
    rooted = kinds.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    least_id = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    per_kind = durable(rooted.join(least_id, "root").select("s1", "s2", "component_id", "root"))
    some, none = each.filter("n > 0"), each.filter("n = 0")
    return some.join(per_kind, ["s1", "s2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "s1", "s2", "root").union(
        none.select("doc_id", "n", "doc_id", "s1", "s2", F.lit(None).cast("long")))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id (if ids repeat, one text of it).
    Documents without words stay. A component without any id keeps one of its texts. Other columns pass through, whatever
    their names."""
    docs, back = sheltered(docs, ("doc_id", "text"))
    found = components_of(docs, k, percent)
    chosen = found.filter("n_shingles > 0").groupBy("root").agg(
        F.first("component_id").alias("_id"),
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.struct("s1", "s2"))).alias("_s")).select(
        "_id", F.col("_s.s1").alias("_s1"), F.col("_s.s2").alias("_s2"))
    empty = found.filter("n_shingles = 0").select(
        F.col("doc_id").alias("_id"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2")).distinct()
    keep = durable(chosen.union(empty))
    # texts of a kept id; the set's name tells repeated ids apart
    rows = named_rows(docs, k)
    kept = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k1") == F.col("_s1"))
                     & (F.col("_k2") == F.col("_s2")))
    return back(kept.dropDuplicates(["doc_id", "_k1", "_k2"]))


def named_rows(docs: DataFrame, k: int) -> DataFrame:
    """All columns of ``docs`` and the name (_k1, _k2) of each row's set."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("_k1", T.LongType()), T.StructField("_k2", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, at, _ in sets(batch.column("text"), k):
                s1, s2 = digest(hashes, at)
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(s1), pa.array(s2)],
                                                 [*own.schema.names, "_k1", "_k2"])

    return docs.mapInArrow(run, schema)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    END AS s FROM w),
t AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(low.m, n.doc_id)) AS component_id
FROM n LEFT JOIN low ON low.a = n.doc_id"""
