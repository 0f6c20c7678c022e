"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target size in words; all its documents share the expected number of copies
target / source size, at most ``cap``. Whole copies are certain; the fraction left is rounded
dependently: two fractional documents meet, word mass moves from one to the other in a random direction
(with odds that keep both expectations) until one of them is 0 or 1, and the other goes on.
Mass, and so the words taken from a source, is kept exactly up to one last document per source.

Scale: a source is cut into blocks of about ``block`` documents by a hash, so a hot source is many
groups. Each block leaves at most one fractional document; these residuals meet ``FAN`` at a time in
a tree until one is left per source, which is rounded by its own chance. Random numbers are hashes of
the document, so reruns agree whatever the partitioning.

Defined results: a null or empty text has size 0, takes 0 words, and is rounded on its own. A null source is
a source of its own (last in order). Rows equal in id, source and text get equal copies. An empty table
gives an empty table. Other columns are kept by ``mix`` and ignored elsewhere.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ropewalk.operators.ordered import range_rank
from ropewalk.session import durable

from .columns import sheltered

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BLOCK = 20_000
FAN = 256
WORD = r"[^\x20\x09-\x0D]+"
ITEM = ["doc_id", "source", "_h"]


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS,
            cap: float = CAP) -> DataFrame:
    """(source, source_size) to targets: ``share`` of the total goes out by weight in code point order of
    the names, null last; what a source gets above ``cap`` times its size is shared again.

    The common level solves sum(min(cap * size, level * weight)) = share * total. It is found by raising it
    until no further source is capped; each step is one aggregate over the sources.
    """
    ranked = range_rank(sources, [F.asc_nulls_last("source")], "_rank")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int"))
    rows = durable(ranked.select("source", "source_size", weight.alias("_w"),
                                 (F.lit(cap) * F.col("source_size")).alias("_most")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("_most") <= F.lit(level) * F.col("_w")
        got = rows.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("_most"))).alias("most"),
                       F.sum(F.when(~over, F.col("_w"))).alias("w")).first()
        if got.n == capped or not got.w:
            break
        capped, level = got.n, (share * total - (got.most or 0.0)) / got.w
    return rows.select("source", "source_size", F.least("_most", F.lit(level) * F.col("_w")).alias("target"))


def items(docs: DataFrame) -> DataFrame:
    """One row per distinct (id, source, text): its size and how many rows it has."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("_h"), word_count("text").alias("size")) \
        .groupBy(*ITEM).agg(F.first("size").alias("size"), F.count("*").alias("_rows"))


def pivot(p: np.ndarray, mass: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round chances ``p`` of items of ``mass`` one after the other: (rounded, index still fractional or -1)."""
    out, eps = p.copy(), 1e-9
    held = -1
    for i in range(len(p)):
        if out[i] <= eps or out[i] >= 1 - eps:
            out[i] = round(out[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, ma, mb = out[held], out[i], mass[held], mass[i]
        up, down = min((1 - a) * ma, b * mb), min(a * ma, (1 - b) * mb)
        move = up if u[i] * (up + down) < down else -down
        a, b = a + move / ma, b - move / mb
        out[held], out[i] = a, b
        if a <= eps or a >= 1 - eps:
            out[held], held = round(a), i
        if b <= eps or b >= 1 - eps:
            out[i] = round(b)
            held = -1 if held == i else held
    return out, held


def _round_group(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["_mass", "_u", "doc_id", "_h"], ascending=[False, True, True, True], kind="stable")
    p, u = pdf["_p"].to_numpy(float), pdf["_u"].to_numpy()
    out, held = pivot(p, pdf["_mass"].to_numpy(float), u)
    if held >= 0 and last:
        out[held], held = float(u[held] < out[held]), -1
    open_ = np.zeros(len(p), bool)
    if held >= 0:
        open_[held] = True
    return pdf.assign(_p=out, _open=open_)


def rounded(rows: DataFrame, block: int = BLOCK, fan: int = FAN, seed: int = 1) -> DataFrame:
    """``rows`` (items with ``_p`` and ``_mass``) with ``_p`` rounded to 0 or 1, by source."""
    u = lambda level: ((F.xxhash64(*ITEM, F.lit(seed), F.lit(level)) / F.lit(2.0 ** 64)) + F.lit(0.5))
    even = rows.filter((F.col("_mass") <= 0) | (F.col("_p") <= 0) | (F.col("_p") >= 1)).withColumn(
        "_p", (u(0) < F.col("_p")).cast("double"))
    odd = rows.filter((F.col("_mass") > 0) & (F.col("_p") > 0) & (F.col("_p") < 1))
    blocks = odd.groupBy("source").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    state = odd.join(blocks.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s") \
        .withColumn("_blk", F.pmod(F.xxhash64(*ITEM, F.lit("block")), F.col("_blocks")).cast("int"))
    done, level = [even], 0
    while True:
        level += 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields
                           if f.name not in ("_u", "_open"))
        out = durable(state.withColumn("_u", u(level)).groupBy("source", "_blk").applyInPandas(
            lambda pdf: _round_group(pdf, bool(pdf["_blocks"].iloc[0] == 1)),
            schema + ", `_u` double, `_open` boolean"))
        done.append(out.filter(~F.col("_open")).select(*rows.columns))
        open_ = out.filter("_open")
        if open_.isEmpty():
            return reduce(DataFrame.union, [d.select(*rows.columns) for d in done])
        state = open_.drop("_u", "_open").withColumn("_blk", F.floor(F.col("_blk") / fan).cast("int")) \
            .withColumn("_blocks", F.ceil(F.col("_blocks") / fan).cast("int"))


def copies(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP,
           block: int = BLOCK, seed: int = 1) -> DataFrame:
    """Per distinct (doc_id, source, text hash ``_h``): size, its source's size and target, and copies to take."""
    each = durable(items(docs))
    sources = durable(each.groupBy("source").agg(F.sum(F.col("size") * F.col("_rows")).alias("source_size")))
    goal = targets(sources, share, weights, cap).withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    rows = each.join(goal, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_rate", rate).select(
        "*", F.floor("_rate").alias("_whole"), (F.col("_rate") - F.floor("_rate")).alias("_p"),
        (F.col("size") * F.col("_rows")).cast("double").alias("_mass"))
    return rounded(rows, block, seed=seed).select(
        *ITEM, "size", "_rows", "source_size", "target",
        (F.col("_whole") + F.col("_p").cast("long")).cast("int").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as its copies say; other columns pass through, whatever their names."""
    docs, back = sheltered(docs, ("doc_id", "source", "text"))
    plan = copies(docs, **how).filter("copies > 0").select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(ITEM)], F.col("copies").alias("_copies"))
    keyed = docs.withColumn("_kh", F.xxhash64("text"))
    joined = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col("_k0")) & F.col("source").eqNullSafe(F.col("_k1"))
                        & (F.col("_kh") == F.col("_k2")))
    return back(joined.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


def report(docs: DataFrame) -> DataFrame:
    """The mix as one row per document."""
    return copies(docs).withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")
