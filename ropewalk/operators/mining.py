"""Patterns mined from run logs: usage counters, co-occurrence, gap filling, consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import est_tokens, slugify
from ..session import durable, sized_tasks
from .ordered import first_k
from .pairs import member_pairs

# Evidence weights of successful and failed runs.
W_SUCCESS, W_FAIL = 2.0, 0.5
PAIRS = 1_000_000  # pairs that a task makes


def heat_counters(invocations: DataFrame) -> DataFrame:
    """Counters per skill from ``invocations(skill, success, step, ...)``."""
    return invocations.groupBy("skill").agg(
        F.count("*").alias("n_visit"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("failure_count"),
        F.max("step").alias("last_used_step"))


def coverage(invocations: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return invocations.groupBy("skill").agg(count("task_type").alias("coverage"))


def type_entropy(invocations: DataFrame) -> DataFrame:
    """Shannon entropy (nats) of the task types in which a skill was used."""
    by_type = invocations.groupBy("skill", "task_type").agg(F.count("*").alias("_n"))
    # -sum(p ln p) = ln N - sum(n ln n) / N, one pass over the type counts
    agg = by_type.groupBy("skill").agg(
        F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.log("_n")).alias("_s"))
    return agg.select("skill", (F.log("_t") - F.col("_s") / F.col("_t")).alias("entropy"))


def cooccurrence(trace_atoms: DataFrame, w_ok: float = W_SUCCESS,
                 w_fail: float = W_FAIL) -> DataFrame:
    """Weighted co-occurrence (a < b) over ``trace_atoms(trace, atom, success)``.

    Stored. The rows, then the pairs, are counted first, and tasks are cut by that. The input is computed for its count, so
    it should be a table.
    """
    spark = trace_atoms.sparkSession
    with sized_tasks(spark, trace_atoms.count()):
        members = durable(trace_atoms.groupBy("trace", "atom").agg(F.max("success").alias("success")))
        n = F.col("n").cast("double")
        load = members.groupBy("trace").agg(F.count("*").alias("n")).agg(F.sum(n * (n + 1) / 2).alias("n")).first()["n"]
    weight = F.when(F.col("success"), F.lit(w_ok)).otherwise(F.lit(w_fail))
    with sized_tasks(spark, int(load or 0), PAIRS):
        return durable(member_pairs(members, "trace", "atom", ["success"])
                       .groupBy("a", "b").agg(F.sum(weight).alias("weight")))


def atom_evidence(trace_bodies: DataFrame) -> DataFrame:
    """First body recorded per atom from ``(atom, body, seq)``."""
    return trace_bodies.filter(F.col("body").isNotNull()).groupBy("atom").agg(
        F.min_by("body", "seq").alias("body"))


def trace_contains(trace_atoms: DataFrame, skills: DataFrame) -> DataFrame:
    """Traces per atom, and whether the atom has a skill record yet."""
    n = trace_atoms.select("trace", "atom").distinct().groupBy("atom").agg(
        F.count("*").alias("n_traces"))
    known = skills.select(F.col("id").alias("atom"), F.lit(True).alias("_k"))
    return n.join(known, "atom", "left").select(
        "atom", "n_traces", F.coalesce("_k", F.lit(False)).alias("has_skill"))


def cooccurring(seeds: DataFrame, cooc: DataFrame, exclude: DataFrame | None = None,
                top_m: int = 3, min_weight: float = 2.0) -> DataFrame:
    """Per task the partners of its seeds that are not seeds themselves, best ``top_m``. The seeds are stored, as they are read twice."""
    both = cooc.select(F.col("a").alias("id"), F.col("b").alias("partner"), "weight").unionByName(
        cooc.select(F.col("b").alias("id"), F.col("a").alias("partner"), "weight"))
    s = durable(seeds.select("task_id", "id").distinct())
    support = (s.join(both, "id").groupBy("task_id", "partner")
               .agg(F.sum("weight").alias("weight")).filter(F.col("weight") >= min_weight))
    drop = s if exclude is None else s.unionByName(exclude.select("task_id", "id"))
    open_ = support.join(drop.select("task_id", F.col("id").alias("partner")),
                         ["task_id", "partner"], "left_anti")
    return first_k(open_, ["task_id"], [F.col("weight").desc(), F.col("partner").asc()], top_m)


def gap_fill(routes: DataFrame, cooc: DataFrame, evidence: DataFrame, pool: DataFrame,
             max_synth: int = 3, min_weight: float = 3.0) -> DataFrame:
    """Missing atoms to add to a route. The best 2 x max_synth candidates are taken first and
    only then reduced to those without a pool record and with a body."""
    cands = cooccurring(routes, cooc, None, max_synth * 2, min_weight)
    usable = (cands.join(pool.select(F.col("id").alias("partner")), "partner", "left_anti")
              .join(evidence.filter(F.length("body") > 0)
                    .select(F.col("atom").alias("partner"), "body"), "partner"))
    best = first_k(usable.withColumnRenamed("rank", "_r"), ["task_id"], [F.col("_r").asc()],
                   max_synth)
    return best.select("task_id", F.col("partner").alias("id"), "weight", "rank", "body",
                       est_tokens("body").alias("tokens"))


def consolidation(cooc: DataFrame, evidence: DataFrame, skills: DataFrame, step: int,
                  min_weight: float = 4.0, max_new: int = 4) -> DataFrame:
    """Atoms with enough support and a body but no deployed record: the best ``max_new``.

    ``action`` is insert or revive; a revived record keeps its own body when it has one.
    """
    support = (cooc.select(F.explode(F.array("a", "b")).alias("atom"), "weight")
               .groupBy("atom").agg(F.sum("weight").alias("support")))
    have = skills.select(F.col("id").alias("atom"), "status", F.col("body").alias("_own"))
    best = (support.filter(F.col("support") >= min_weight)
            .join(evidence, "atom").join(have, "atom", "left")
            .filter(F.coalesce(F.col("status"), F.lit("")) != "deployed")
            .orderBy(F.col("support").desc(), F.col("atom").asc()).limit(max_new))
    return best.select(
        F.col("atom").alias("id"), "support",
        F.when(F.col("status").isNull(), "insert").otherwise("revive").alias("action"),
        F.when(F.length("_own") > 0, F.col("_own")).otherwise(F.col("body")).alias("body"),
        est_tokens("body").alias("token_cost"), F.lit("deployed").alias("status"),
        slugify(F.concat(F.lit("consolidate_"), F.col("atom").cast("string"),
                         F.lit(f"_{step}"))).alias("rule_id"),
        F.concat(F.lit("consolidate "), F.col("atom").cast("string"),
                 F.lit(" from trace evidence (support "), F.format_string("%.1f", "support"),
                 F.lit(")")).alias("statement"))
