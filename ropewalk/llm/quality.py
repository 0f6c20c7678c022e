"""Quality classifier with hierarchical empirical Bayes.

Document evidence: logistic regressions (toxic, low quality) on shares of byte kinds, word statistics and the log
odds of words and word beginnings. Site evidence: the expected bad documents of each host and of
each path under it, by grouped aggregation; a host's rate is shrunk toward the global rate and a
path's toward its host's, with strengths fitted by the method of moments, so that a sparse site
says nearly nothing. A document's odds are moved by its path's odds against the global odds, at most by ``PULL``.

The fit reads at most ``SAMPLE`` labelled rows (in hash order of the id, which is the same choice in
every run) and keeps at most ``TERMS`` words; rates and counts of sites cover all documents. Word odds
leave the labelled document itself out while fitting.

Defined results: a null text is empty and is judged by its (constant) statistics; null host or path is a
site of its own; without labels, or with one class only, nothing is rejected on that account. Labels repeated
for an id count once (the worst). Rows are judged one by one, so repeated rows give repeated
results. ``filtered`` keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ropewalk.session import durable

from . import flat

SAMPLE = 40_000
TERMS = 60_000
LEAST = 3        # documents a word must be in
PREFIXES = (4, 5, 6, 7)
PULL = 1.0       # most that a site moves a document's log odds
REJECT = 0.5
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

KINDS = np.zeros((256, 6), np.float32)  # upper, lower, digit, mark, line end, beyond ASCII
KINDS[65:91, 0] = KINDS[97:123, 1] = KINDS[48:58, 2] = KINDS[10, 4] = KINDS[128:, 5] = 1
KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 3] = 1
MARKS = [ord(c) for c in "!|#$%&*.,"]
# each byte's row of flags (its kind and whether it is one of the marks), numbered
FLAGS = np.column_stack([KINDS, *[np.arange(256) == m for m in MARKS]])
MEANING, CODES = np.unique(FLAGS, axis=0, return_inverse=True)
CLASSES, CODES = len(MEANING), CODES.astype(np.int64)


@dataclass
class Evidence:
    """Words by sorted hash with their documents, toxic documents and poor documents."""

    hashes: np.ndarray
    counts: np.ndarray
    totals: np.ndarray

    def odds(self, at: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Log odds of (toxic, poor) of the words at ``at``; ``own`` (label pairs) leaves a document out."""
        n, bad = self.counts[at, :1].astype(float), self.counts[at, 1:].astype(float)
        if own is not None:
            n, bad = n - 1, bad - own
        whole, all_bad = float(self.totals[0]), self.totals[1:].astype(float)
        return np.log((bad + 0.2) / (all_bad + 0.4)) - np.log((n - bad + 0.2) / (whole - all_bad + 0.4))


def terms(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs: words and word beginnings, as hashes. With ``known`` (sorted hashes) only terms
    among these, as their places in it."""
    w = flat.words(data, offsets, lower=True, gap=GAP, prefixes=PREFIXES)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.offsets))
    _, first, kind = np.unique(w.hashes, return_index=True, return_inverse=True)
    # (text, kind of word) once each, then its terms
    pair = np.unique(doc * np.int64(max(len(first), 1)) + kind)
    doc, kind = pair // max(len(first), 1), pair % max(len(first), 1)
    docs, found = [], []
    for hashes in (w.hashes, *w.prefixes):
        term = hashes[first]
        if known is None:
            docs.append(doc)
            found.append(term[kind])
            continue
        at = np.minimum(np.searchsorted(known, term), len(known) - 1)
        at = np.where(known[at] == term, at, -1)[kind]
        docs.append(doc[at >= 0])
        found.append(at[at >= 0])
    doc, term = np.concatenate(docs), np.concatenate(found)
    uniq, kind = (np.arange(len(known)), term) if known is not None else np.unique(term, return_inverse=True)
    pair = np.unique(doc * np.int64(max(len(uniq), 1)) + kind)
    return pair // max(len(uniq), 1), uniq[pair % max(len(uniq), 1)] if len(uniq) else term


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense features per text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    code = CODES[data] + np.repeat(np.arange(n) * CLASSES, np.diff(offsets))
    shares = np.bincount(code, minlength=n * CLASSES).reshape(n, CLASSES) @ MEANING / size[:, None]
    w = flat.words(data, offsets)
    count = np.diff(w.offsets).astype(float)
    doc = np.repeat(np.arange(n), np.diff(w.offsets))
    same = np.zeros(len(w.hashes))
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    kinds = np.unique(flat.mix(w.hashes + doc.astype(np.uint64) * flat.STEP), return_index=True)[1]
    some = np.maximum(count, 1)
    return np.column_stack([shares, np.log1p(count), np.bincount(doc, w.ends - w.starts, n) / some,
                            np.bincount(doc, same, n) / some, np.bincount(doc[kinds], minlength=n) / some])


def features(evidence: Evidence, data: np.ndarray, offsets: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, 6))
    if len(evidence.hashes):
        doc, at = terms(data, offsets, evidence.hashes)
        odds = evidence.odds(at, None if own is None else own[doc])
        for j in range(2):
            o = odds[:, j]
            full = np.flatnonzero(np.diff(doc, prepend=-1))  # pairs come text by text
            if len(full):
                out[doc[full], 3 * j] = np.maximum.reduceat(np.clip(o, 0, 6), full)
            out[:, 3 * j + 1] = np.log1p(np.bincount(doc, np.where(o > 2, o, 0), n))
            out[:, 3 * j + 2] = np.log1p(np.bincount(doc, o > 3, n))
    return np.column_stack([statistics(data, offsets), out])


@dataclass
class Model:
    evidence: Evidence
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (features + 1, 2)

    def odds(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), 2))
        for lo, hi, data, offsets in flat.text_chunks(texts):
            x = (features(self.evidence, data, offsets) - self.mean) / self.scale
            out[lo:hi] = x @ self.weights[:-1] + self.weights[-1]
        return np.clip(out, -30, 30)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(key: str = "doc_id") -> Column:
    """Documents the fit never reads: one in five."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, poor) of the first ``sample`` labelled ids in hash order that are not held out."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max(F.coalesce("toxic", F.lit(0))).cast("double").alias("toxic"),
        F.max(1 - F.coalesce("quality", F.lit(1))).cast("double").alias("poor"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(  # at most SAMPLE rows
        F.coalesce("text", F.lit("")).alias("text"), "toxic", "poor")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: int = TERMS) -> Model | None:
    rows = durable(labelled(docs, labels, sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.column_stack([batch.column("toxic").to_numpy(), batch.column("poor").to_numpy()])
            for lo, hi, data, offsets in flat.text_chunks(batch.column("text")):
                doc, term = terms(data, offsets)
                uniq, at = np.unique(term, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uniq.view(np.int64)), pa.array(np.bincount(at, minlength=len(uniq)).astype(np.int64)),
                     *[pa.array(np.bincount(at, own[lo:hi][doc, j], len(uniq)).astype(np.int64)) for j in range(2)]],
                    ["term", "n", "toxic", "poor"])

    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.sum("poor").alias("p")).first()
    if not total.n:
        return None
    counts = rows.mapInArrow(count, "term long, n long, toxic long, poor long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("poor").alias("poor")).filter(F.col("n") >= LEAST)
    # how far the bad documents of a word are from what its frequency would give
    gain = [F.abs(F.col(c) - F.col("n") * (t or 0) / total.n) / F.sqrt(F.col("n"))
            for c, t in (("toxic", total.t), ("poor", total.p))]
    best = counts.orderBy(F.desc(F.greatest(*gain)), "term").limit(keep).toPandas()  # at most TERMS rows
    hashes = best["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    evidence = Evidence(hashes[order], best[["n", "toxic", "poor"]].to_numpy(np.int64).reshape(-1, 3)[order],
                        np.array([total.n, total.t, total.p]))
    shipped = docs.sparkSession.sparkContext.broadcast(evidence)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.column_stack([batch.column("toxic").to_numpy(), batch.column("poor").to_numpy()])
            for lo, hi, data, offsets in flat.text_chunks(batch.column("text")):
                x = features(shipped.value, data, offsets, own[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(list(x)), pa.array(own[lo:hi, 0]), pa.array(own[lo:hi, 1])],
                                                 ["x", "toxic", "poor"])

    seen = rows.mapInArrow(describe, "x array<double>, toxic double, poor double").toPandas()  # at most SAMPLE rows
    x = np.stack(seen["x"].to_numpy())
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z, weights = (x - mean) / scale, []
    for c in ("toxic", "poor"):
        y = seen[c].to_numpy()
        w = logistic(z, y) if 0 < y.sum() < len(y) else np.concatenate([np.zeros(z.shape[1]), [-30.0]])
        weights.append(w)
    return Model(evidence, mean, scale, np.column_stack(weights))


def judged(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` plus the document evidence ``_toxic`` and ``_poor`` (log odds)."""
    if model is None:
        return docs.withColumns({"_toxic": F.lit(-30.0), "_poor": F.lit(-30.0)})
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("_toxic", T.DoubleType()),
                           T.StructField("_poor", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = shipped.value.odds(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds[:, 0]), pa.array(odds[:, 1])],
                                             [*batch.schema.names, "_toxic", "_poor"])

    return docs.mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def strength(rows: DataFrame, rate: str, prior: str) -> float:
    """Observations the prior of a group is worth: method of moments over groups of n documents with
    ``rate`` around ``prior``; large when groups differ no more than chance."""
    n, gap = F.col("n"), (F.col(rate) - F.col(prior)) ** 2
    chance = F.col(prior) * (1 - F.col(prior))
    got = rows.filter(n > 1).agg(F.sum(n * gap).alias("seen"), F.sum(chance).alias("chance"),
                                 F.sum(n * chance).alias("whole")).first()
    if not got.whole or got.whole <= got.chance:
        return 1e6
    spread = (got.seen - got.chance) / (got.whole - got.chance)  # share of the variance between groups
    return float(min(max(1 / spread - 1, 2.0), 1e6)) if spread > 0 else 1e6


def sites(scored: DataFrame) -> DataFrame:
    """Rows (host, path, _chance) to shrunk rates: host, path, host_rate, path_rate, global_rate."""
    paths = durable(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("_chance").alias("bad")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.sum("bad") / F.sum("n")).first()[0] or 0.0
    rate = min(max(total, 1e-4), 1 - 1e-4)
    hosts = hosts.withColumns({"rate": F.col("bad") / F.col("n"), "prior": F.lit(rate)})
    k = strength(hosts, "rate", "prior")
    host_rate = hosts.select(F.col("host").alias("_h"), ((F.lit(k * rate) + F.col("bad")) / (F.lit(k) + F.col("n")))
                             .alias("host_rate"))
    both = durable(paths.join(host_rate, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
                   .withColumn("rate", F.col("bad") / F.col("n")))
    k = strength(both, "rate", "host_rate")
    return both.select("host", "path", "host_rate", ((F.lit(k) * F.col("host_rate") + F.col("bad"))
                                                     / (F.lit(k) + F.col("n"))).alias("path_rate"),
                       F.lit(rate).alias("global_rate"))


def posterior(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
              sample: int = SAMPLE, keep: bool = True) -> DataFrame:
    """``docs`` (without ``text`` unless ``keep``) with host, path, p_toxic, p_poor, host_rate, path_rate, p_bad and ``rejected``.

    ``host`` defaults to the source, ``path`` to the language under it."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit(docs, labels, sample)

    def named(df: DataFrame) -> DataFrame:
        return df.withColumns({"host": host.cast("string"), "path": path.cast("string")})

    p = {c: 1 / (1 + F.exp(-F.col(f"_{c}"))) for c in ("toxic", "poor")}
    chance = 1 - (1 - p["toxic"]) * (1 - p["poor"])
    if keep:
        rows = named(judged(docs, model))  # judged twice, so that texts need neither shuffle nor copy
        narrow = rows
    else:
        rows = narrow = durable(named(judged(docs, model)).drop("text"))
    known = sites(narrow.select("host", "path", chance.alias("_chance"))).select(
        F.col("host").alias("_h"), F.col("path").alias("_p"), "host_rate", "path_rate", "global_rate")
    shift = F.greatest(F.least(_logit(F.col("path_rate")) - _logit(F.col("global_rate")), F.lit(PULL)), F.lit(-PULL))
    moved = lambda c: 1 / (1 + F.exp(-(F.col(f"_{c}") + shift)))
    out = rows.join(known, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    return out.withColumns({"p_toxic": moved("toxic"), "p_poor": moved("poor")}).withColumn(
        "p_bad", 1 - (1 - F.col("p_toxic")) * (1 - F.col("p_poor"))).withColumn(
        "rejected", F.greatest("p_toxic", "p_poor") > REJECT).drop(
        "_h", "_p", "_toxic", "_poor", "global_rate")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, same columns."""
    cols = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source", "lang")}
    named = docs.withColumnsRenamed(cols)
    return posterior(named, labels).filter(~F.col("rejected")).select(
        *[F.col(cols.get(c, c)).alias(c) for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    return posterior(rows, labels, keep=False).select(
        "doc_id", held_out().alias("held_out"), "host", "path", "p_toxic", "p_poor", "host_rate", "path_rate",
        (1 - F.col("p_bad")).alias("score"), "rejected", (~F.col("rejected")).alias("kept"))
