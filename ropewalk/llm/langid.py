"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order four over the characters of lower-cased words, padded with a boundary
mark. An n-gram is four 16-bit units in one integer; its hash stands in a sorted array, with one column of
discounted probabilities and one of back-off weights per language, so one binary search serves all
languages. A text goes to the language of the lowest cross-entropy per character.

Training counts every n-gram of every labelled training text in Spark, and no language and no n-gram is left out.
Up to ``MAX_ROWS`` counts (and ``MAX_CELLS`` counts times languages) the whole model is shipped. Over that all totals,
discounts, chances and back-off weights are tables; the finished probabilities of the most frequent n-grams
are shipped, and texts look up all others by a join.

Rejection is calibrated on the training texts: per language the mean and deviation of the cross-entropy of
those it gets right; a text ``REJECT`` deviations above the mean is marked ``rejected`` and its score falls.

Defined results: null text, or no letter: ``und`` with score 0. Without any training text all is
``und``. Equal cross-entropies go to the language first in code point order. Null ids and null languages
train nothing. Repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ropewalk.session import durable

from . import flat

ORDER = 4
UNIT = np.uint64(16)
MARK = 2  # boundary unit
MAX_ROWS = 2_000_000
MAX_CELLS = 1 << 25
AT_ONCE = 1 << 22  # n-grams times languages in one product
REJECT = 6.0
SHARP = 12.0


def keys_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of each word and at its end mark: (keys, word offsets)."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    heads = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum(heads)])[offsets - offsets[0]]
    units = np.minimum(points, 0xFFFF).astype(np.uint64)
    units = np.where((units >= 48) & (units < 58), np.uint64(48), units)  # all digits alike
    n, size = len(words), np.diff(at)
    pad = ORDER  # ORDER - 1 marks before, one after
    stream = np.full(len(units) + n * pad, np.uint64(MARK))
    starts = at[:-1] + np.arange(n) * pad + ORDER - 1
    stream[np.repeat(starts - at[:-1], size) + np.arange(len(units))] = units
    cut = np.concatenate([[0], np.cumsum(size + 1)])
    ends = np.repeat(starts - cut[:-1], size + 1) + np.arange(cut[-1])
    key = np.zeros(len(ends), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        key = (key << UNIT) | stream[ends - back]
    return key, cut


def distinct_words(texts: pa.Array) -> Iterator[tuple[int, int, flat.Words, np.ndarray, np.ndarray]]:
    """Runs of rows with their words, the index of one word of each kind, and the kind of every word."""
    for lo, hi, data, offsets in flat.text_chunks(pc.utf8_lower(pc.fill_null(texts, "")), 4 << 20):
        w = flat.words(data, offsets)
        _, first, kind = np.unique(w.hashes, return_index=True, return_inverse=True)
        yield lo, hi, w, first, kind


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``lang, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            codes = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            code = np.array([codes[x] for x in langs])
            for lo, hi, w, first, kind in distinct_words(batch.column("text")):
                keys, cut = keys_of(flat.word_texts(w, first))
                owner = np.repeat(code[lo:hi], np.diff(w.offsets))
                for lang, c in codes.items():
                    uses = np.bincount(kind[owner == c], minlength=len(first))
                    grams, at = np.unique(keys, return_inverse=True)
                    n = np.bincount(at, np.repeat(uses, np.diff(cut)), len(grams)).astype(np.int64)
                    grams, n = grams[n > 0], n[n > 0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)],
                        ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray]     # sorted hashes per order
    chance: list[np.ndarray]    # discounted probability, (grams, langs)
    contexts: list[np.ndarray]  # sorted hashes per order
    back: list[np.ndarray]      # weight of the order below, (contexts, langs)
    base: np.ndarray            # uniform probability per language

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of the last unit of each n-gram in each language."""
        p = np.broadcast_to(self.base, (len(keys), len(self.langs))).astype(np.float32)
        for k in range(1, ORDER + 1):
            own = keys if k == ORDER else keys & np.uint64((1 << (16 * k)) - 1)
            p = p * find(self.contexts[k - 1], self.back[k - 1], hashed(own >> UNIT), 1.0)
            p = p + find(self.grams[k - 1], self.chance[k - 1], hashed(own), 0.0)
        return np.log(p)


def hashed(keys: np.ndarray) -> np.ndarray:
    return flat.mix(keys + np.uint64(1))


def find(table: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where((table[at] == keys)[:, None], values[at], np.float32(missing))


def fit(rows: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Model from (grams, counts) per language."""
    langs = sorted(rows)
    size = len(langs)
    parts: list[list] = [[] for _ in range(ORDER)]
    base = np.zeros(size, np.float32)
    for j, lang in enumerate(langs):
        grams, counts = rows[lang]
        grams, counts = grams.astype(np.uint64), counts.astype(np.float64)
        for k in range(ORDER, 0, -1):
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.9)
            ctx, at = np.unique(grams >> UNIT, return_inverse=True)
            total, kinds = np.bincount(at, counts), np.bincount(at)
            parts[k - 1].append((j, hashed(grams), np.maximum(counts - d, 0) / total[at], hashed(ctx), d * kinds / total))
            if k == 1:
                base[j] = 1.0 / (len(grams) + 1)
            else:  # the order below counts the different units before
                grams, counts = np.unique(grams & np.uint64((1 << (16 * (k - 1))) - 1), return_counts=True)
                counts = counts.astype(np.float64)
    model = Model(langs, [], [], [], [], base)
    for k in range(ORDER):
        g = np.unique(np.concatenate([p[1] for p in parts[k]]))
        c = np.unique(np.concatenate([p[3] for p in parts[k]]))
        chance, back = np.zeros((len(g), size), np.float32), np.ones((len(c), size), np.float32)
        for j, h, p, hc, b in parts[k]:
            chance[np.searchsorted(g, h), j] = p
            back[np.searchsorted(c, hc), j] = b
        model.grams.append(g)
        model.chance.append(chance)
        model.contexts.append(c)
        model.back.append(back)
    return model


class Tables:
    """The model as tables, for counts of any size. ``keys`` and ``logs`` are the shipped n-grams."""

    def __init__(self, counts: DataFrame, langs: list[str]):
        self.langs, spark = langs, counts.sparkSession
        names = spark.createDataFrame(list(enumerate(langs)), "j int, lang string")
        grams = counts.join(names, "lang").select("j", "gram", "n")
        self.orders = []
        for k in range(ORDER, 0, -1):
            if k < ORDER:  # the order below counts the different units before
                grams = durable(grams.groupBy("j", F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1)).alias("gram")).agg(
                    F.count("*").alias("n")))
            ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
            stats = durable(grams.groupBy("j").agg(
                F.least(F.greatest(F.when(ones > 0, ones / (ones + 2 * twos)).otherwise(0.5), F.lit(0.1)), F.lit(0.9)).alias("d"),
                F.count("*").alias("kinds")))
            rows = grams.withColumn("ctx", F.shiftrightunsigned("gram", 16))
            ctx = durable(rows.groupBy("j", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(
                stats.select("j", "d"), "j").select("j", "ctx", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("back")))
            chance = durable(rows.join(ctx, ["j", "ctx"]).select(
                "j", F.col("gram").alias("own"), (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("chance")))
            self.orders.insert(0, (chance, ctx.select("j", "ctx", "back")))
        self.base = stats.select("j", (1.0 / (F.col("kinds") + 1)).alias("p"))
        top = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(
            max(1, min(MAX_ROWS, MAX_CELLS // len(langs))))
        shipped = self.finished(top.select("gram")).toPandas()  # at most MAX_CELLS values
        keys = shipped["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.logs = np.array(shipped["logs"].tolist(), np.float32)[order]

    def finished(self, grams: DataFrame) -> DataFrame:
        """(gram, logs): natural log probability in every language, for distinct grams."""
        rows = grams.crossJoin(self.base)
        for k, (chance, back) in enumerate(self.orders, 1):
            own = F.col("gram") if k == ORDER else F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1))
            rows = rows.withColumn("own", own).withColumn("ctx", F.shiftrightunsigned("own", 16)).join(
                back, ["j", "ctx"], "left").join(chance, ["j", "own"], "left").select(
                "gram", "j", (F.col("p") * F.coalesce("back", F.lit(1.0)) + F.coalesce("chance", F.lit(0.0))).alias("p"))
        return rows.groupBy("gram").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.log("p").alias("log")))),
                                                    lambda e: e["log"]).alias("logs"))


def train(docs: DataFrame) -> Model | Tables | None:
    counts = durable(count_grams(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())))
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    size = sum(sizes.values())
    if not size:
        return None
    if size > MAX_ROWS or size * len(sizes) > MAX_CELLS:
        return Tables(counts, sorted(sizes))
    pdf = counts.toPandas()
    return fit({lang: (part["gram"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy())
                for lang, part in pdf.sort_values("gram").groupby("lang")})


def entropies(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character (nats) of each text in each language, and its characters."""
    n = len(texts)
    out, chars = np.zeros((n, len(model.langs))), np.zeros(n, np.int64)
    step = max(1, AT_ONCE // len(model.langs))
    for lo, hi, w, first, kind in distinct_words(texts):
        if not len(first):
            continue
        keys, cut = keys_of(flat.word_texts(w, first))
        sums = np.zeros((len(first), len(model.langs)))
        for at in range(0, len(keys), step):
            end = min(at + step, len(keys))
            a, b = np.searchsorted(cut, at, "right") - 1, np.searchsorted(cut, end, "left")
            sums[a:b] += np.add.reduceat(model.log_probs(keys[at:end]), np.maximum(cut[a:b] - at, 0), axis=0, dtype=np.float64)
        full = np.flatnonzero(np.diff(w.offsets))
        at = w.offsets[:-1][full]
        out[lo + full] = np.add.reduceat(sums[kind], at, axis=0)
        chars[lo + full] = np.add.reduceat(np.diff(cut)[kind], at)
    return -out / np.maximum(chars, 1)[:, None], chars


def looked_up(rows: DataFrame, key: str, tables: Tables) -> DataFrame:
    """(key, sums, chars): log likelihoods in every language, from shipped n-grams and by a join."""
    shipped = rows.sparkSession.sparkContext.broadcast((tables.keys, tables.logs))
    kind, size = rows.schema[key].dataType.simpleString(), len(tables.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, logs = shipped.value
        for batch in batches:
            for lo, hi, w, first, of in distinct_words(batch.column("text")):
                keys, cut = keys_of(flat.word_texts(w, first))
                spread, held = np.diff(cut), []
                for i in range(hi - lo):
                    words, uses = np.unique(of[w.offsets[i]:w.offsets[i + 1]], return_counts=True)
                    own = np.concatenate([np.arange(cut[x], cut[x + 1]) for x in words]) if len(words) else np.zeros(0, np.int64)
                    grams, at = np.unique(keys[own], return_inverse=True)
                    n = np.bincount(at, np.repeat(uses, spread[words]), len(grams)).astype(np.int64)
                    place = np.minimum(np.searchsorted(top, grams), len(top) - 1)
                    hit, sums = top[place] == grams, np.zeros(size)
                    step = max(1, AT_ONCE // size)
                    for j in range(0, len(grams), step):
                        h = hit[j:j + step]
                        sums += n[j:j + step][h] @ logs[place[j:j + step][h]].astype(np.float64)
                    held.append((sums, int(n.sum()), grams[~hit].view(np.int64), n[~hit]))
                kinds = pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(lo, hi - lo), *(pa.array(x, t) for x, t in zip(zip(*held), kinds))],
                    [key, "sums", "chars", "grams", "ns"])

    got = durable(rows.mapInArrow(run, f"{key} {kind}, sums array<double>, chars long, grams array<long>, ns array<long>")
                  .withColumn("_uid", F.monotonically_increasing_id()))
    rest = got.select("_uid", F.explode(F.arrays_zip("grams", "ns")).alias("g")).select("_uid", "g.grams", "g.ns")
    found = durable(tables.finished(rest.select(F.col("grams").alias("gram")).distinct()))
    more = rest.join(found, rest["grams"] == found["gram"]).select("_uid", "ns", F.posexplode("logs").alias("j", "log")).groupBy(
        "_uid", "j").agg(F.sum(F.col("ns") * F.col("log")).alias("s")).groupBy("_uid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "s"))), lambda e: e["s"]).alias("more"))
    return got.select("_uid", key, "sums", "chars").join(more, "_uid", "left").select(
        key, F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b)).alias("sums"), "chars")


def training_fold(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 3


def predict(docs: DataFrame, model: Model | Tables | None, key: str = "doc_id") -> DataFrame:
    """``key``, best language, its cross-entropy and the share of its likelihood among all languages."""
    if model is None:
        return docs.select(key, F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("entropy"),
                           F.lit(0.0).alias("share"))
    joined = isinstance(model, Tables)
    shipped = docs.sparkSession.sparkContext.broadcast(model.langs if joined else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        names = np.array(m if joined else m.langs, object)
        for batch in batches:
            if joined:
                chars = batch.column("chars").to_numpy()
                h = -batch.column("sums").flatten().to_numpy().reshape(len(chars), len(names)) / np.maximum(chars, 1)[:, None]
            else:
                h, chars = entropies(m, batch.column("text"))
            best = h.argmin(axis=1)
            low = h[np.arange(len(h)), best]
            share = 1.0 / np.exp(-(h - low[:, None]) * SHARP).sum(axis=1)
            none = chars == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(names[best], pa.string(), mask=none),
                 pa.array(low, pa.float64(), mask=none), pa.array(share, pa.float64())],
                [key, "best", "entropy", "share"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    return (looked_up(rows, key, model) if joined else rows).mapInArrow(
        run, f"{key} {kind}, best string, entropy double, share double")


def identify(docs: DataFrame) -> DataFrame:
    """Language of every whole text; learns from the rows of the training folds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    fold = training_fold()
    model = train(rows.filter(fold != 1))
    # the label rides along for the calibration only; no prediction reads it
    keyed = rows.select(F.struct("doc_id", "lang").alias("_row"), "text")
    got = durable(predict(keyed, model, "_row").select("_row.doc_id", "_row.lang", "best", "entropy", "share"))
    stats = got.filter((fold != 1) & (F.col("best") == F.col("lang"))).groupBy("best").agg(
        F.avg("entropy").alias("_mean"), F.coalesce(F.stddev_pop("entropy"), F.lit(0.0)).alias("_dev"))
    z = (F.col("entropy") - F.col("_mean")) / F.greatest("_dev", F.lit(0.02))
    known = F.col("best").isNotNull()
    trust = F.coalesce(1.0 / (1.0 + F.exp(F.least(z - REJECT, F.lit(50.0)))), F.lit(1.0))
    return got.join(F.broadcast(stats), "best", "left").select(  # one row per language
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        F.when(known, F.col("best")).otherwise("und").alias("lang_pred"),
        F.when(known, F.col("share") * trust).otherwise(0.0).alias("score"),
        F.coalesce(z > REJECT, F.lit(False)).alias("rejected"))
