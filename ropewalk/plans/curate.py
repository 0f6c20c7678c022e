"""Plans that change the graph: the lifecycle step and one curation round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scoring import HeatConfig
from ..functions.text import slugify, strip
from ..operators import curation, evaluation, lifecycle, routing
from ..session import durable


def lifecycle_step(skills: DataFrame, block_edges: DataFrame, step: int,
                   cfg: HeatConfig = HeatConfig(), deploy_heat: float = 2.0,
                   retire_floor: float = 0.15, cap: int | None = None, govern: bool = True,
                   min_trials: int = 10, max_rate: float = 0.30, prune_cold: bool = True,
                   cold_after: int = 60) -> dict[str, DataFrame]:
    """Promote, block, retire, prune, in that order.

    Returns the new ``skills``, the ``rules`` it left behind, and ``moves(id, move)``: promoted,
    blocked, retired or pruned.
    """
    moves = [lifecycle.promotable(skills, step, cfg, deploy_heat).select(
        "id", F.lit("promoted").alias("move"))]
    now = lifecycle.promote(skills, step, cfg, deploy_heat, cap)
    rules = []
    if govern:
        failing = lifecycle.chronic_failers(now, routing.blocked(block_edges), min_trials,
                                            max_rate)
        rules.append(lifecycle.block_rules(failing, step, max_rate))
        moves.append(failing.select("id", F.lit("blocked").alias("move")))
    gone = lifecycle.low_value(now, step, retire_floor, cfg)
    rules.append(lifecycle.retire_rules(gone, step))
    moves.append(gone.select("id", F.lit("retired").alias("move")))
    now, _ = lifecycle.retire_ids(now, gone)
    if prune_cold:
        idle = lifecycle.cold(now, step, cold_after)
        moves.append(idle.select("id", F.lit("pruned").alias("move")))
        now, _ = lifecycle.retire_ids(now, idle)
    out_rules, out_moves = rules[0], moves[0]
    for r in rules[1:]:
        out_rules = out_rules.unionByName(r)
    for m in moves[1:]:
        out_moves = out_moves.unionByName(m)
    return {"skills": now, "rules": out_rules, "moves": out_moves}


def validate_round(skills: DataFrame, inserts: DataFrame, scores: DataFrame,
                   step: int) -> tuple[DataFrame, DataFrame]:
    """Accept a round's inserts iff its one-row ``scores(val, baseline)`` strictly improves.

    Accepted candidates are deployed, rejected inserts retired. The rule row keeps the measured and
    the carried score apart.
    """
    verdict = scores.agg(F.max("val").alias("_v"), F.max("baseline").alias("_b")).withColumn(
        "_ok", F.col("_v") > F.col("_b"))
    mine = inserts.select("id", F.lit(True).alias("_new")).distinct()
    status = (F.when(F.col("_new") & F.col("_ok") & (F.col("status") == "candidate"), "deployed")
              .when(F.col("_new") & ~F.col("_ok"), "retired").otherwise(F.col("status")))
    out = (skills.join(mine, "id", "left").crossJoin(F.broadcast(verdict))  # one row
           .withColumn("status", status).select(*skills.columns))
    word = F.when(F.col("_ok"), "accept").otherwise("reject")
    rule = verdict.select(
        slugify(F.concat(word, F.lit(f"_round_{step}"))).alias("id"),
        F.when(F.col("_ok"), "accept").otherwise("rejected_edit").alias("kind"),
        F.concat(F.lit("round "), word, F.lit("ed: val "), F.format_string("%.3f", "_v"),
                 F.when(F.col("_ok"), " > baseline ").otherwise(" !> baseline "),
                 F.format_string("%.3f", "_b")).alias("statement"),
        F.col("_v").alias("measured"), F.greatest("_v", "_b").alias("carried"))
    return out, rule


def navlog_curation(nav: DataFrame, outcomes: DataFrame, fragments: DataFrame, skills: DataFrame,
                    step: int, threshold: float = 0.80) -> dict[str, DataFrame]:
    """Credit visited records and fold the skills written for off-graph notes.

    ``fragments(instance, note, ord, name, description, body, task_types)`` is what a distiller made
    of the notes; blank notes and empty bodies drop out, and the run is added as evidence.
    """
    notes = nav.filter((F.col("action") == "go_off_graph") & (F.length(strip("note")) > 0))
    usable = (fragments.filter(F.length(strip("body")) > 0)
              .join(notes.select("instance", "note").distinct(), ["instance", "note"],
                    "left_semi"))
    frags = durable(usable.select(
        F.col("ord").cast("string").alias("frag"), "ord", "name", "description", "body",
        "task_types", F.array(F.col("instance").cast("string")).alias("evidence")))
    credit = durable(evaluation.nav_attribution(nav, outcomes, skills))
    folded = curation.fold_fragments(frags, skills, step, threshold)
    summary = (credit.agg(F.count("*").alias("attributed_nodes"))
               .crossJoin(F.broadcast(frags.agg(F.count("*").alias("offgraph_fragments"))))
               .crossJoin(F.broadcast(folded["inserted"].agg(F.count("*").alias("inserted")))))
    return {"credit": credit, **folded, "summary": summary}


def curate_round(skills: DataFrame, edges: DataFrame, guarded: DataFrame, fragments: DataFrame,
                 scores: DataFrame, step: int, round_no: int, do_merge: bool = True,
                 do_split: bool = True, do_gate: bool = True, do_checkpoint: bool = True,
                 dim: int = 256) -> dict[str, DataFrame]:
    """One round: fold fragments, split divergent records, gate the inserts, mint checkpoints.

    ``skills`` has id, ord, name, description, body, status, task_types and the counters; list
    evidence stays in long tables. ``scores(val, baseline)`` holds the round's measurement. Every
    stage ends in reliable storage, as a round is also the unit of restart.
    """
    # A cosine of 2 is out of reach, so nothing merges when merging is off.
    threshold = 0.80 if do_merge else 2.0
    folded = curation.fold_fragments(fragments, skills, step, threshold, dim)
    kinds = folded["types"].groupBy("id").agg(F.collect_set("task_type").alias("_tt"))
    visits = folded["merged"].groupBy("id").agg(F.count("*").alias("_v"))
    empty = {c: F.lit(0).cast("long") for c in
             ("success_count", "failure_count", "n_visit", "coverage", "token_cost")}
    fresh = folded["inserted"].select(
        "id", "ord", "name", "description", "body", "status",
        F.array().cast("array<string>").alias("task_types"),
        *[v.alias(c) for c, v in empty.items()],
        F.lit(-1).cast("long").alias("last_used_step"))
    cols = fresh.columns
    # task types are a small vocabulary, so the per-record union stays short
    now = (skills.select(*cols).unionByName(fresh).join(kinds, "id", "left")
           .join(visits, "id", "left")
           .withColumn("task_types", F.when(F.col("_tt").isNull(), F.col("task_types")).otherwise(
               F.array_union("task_types", F.array_sort("_tt"))))
           .withColumn("n_visit", F.col("n_visit") + F.coalesce("_v", F.lit(0)))
           .select(*cols))
    now = durable(now)
    new_rules = folded["rules"].select("id", "kind", "statement")
    new_edges = edges.select("src", "dst", "type")
    n_split = now.limit(0).agg(F.count("*").alias("split"))
    if do_split:
        wide = durable(lifecycle.divergent(now))
        parts = curation.split(now, curation.propose_children(wide, "copies"), step)
        n_split = wide.agg(F.count("*").alias("split"))
        kids = parts["children"].select(
            "id", "ord", "name", "description", "body",
            "status", F.array("child_type").alias("task_types"),
            *[v.alias(c) for c, v in empty.items()],
            F.lit(-1).cast("long").alias("last_used_step"))
        top = now.agg(F.max("ord").alias("_top"))
        kids = kids.crossJoin(F.broadcast(top)).withColumn(  # one row
            "ord", F.col("_top") + 1 + F.col("ord")).select(*cols)
        stubs = parts["parents"].select(F.col("parent").alias("id"), "stub")
        now = durable(now.join(stubs, "id", "left").withColumn(
            "body", F.coalesce("stub", "body")).select(*cols).unionByName(kids))
        new_rules = new_rules.unionByName(parts["rules"].select("id", "kind", "statement"))
        new_edges = new_edges.unionByName(parts["edges"].select("src", "dst", "type"))
    if do_gate:
        now, rule = validate_round(now, folded["inserted"], scores, step)
        accepted = rule.select((F.col("kind") == "accept").alias("accepted"),
                               F.round("carried", 4).alias("val"))
        new_rules = new_rules.unionByName(rule.select("id", "kind", "statement"))
    else:
        mine = folded["inserted"].select("id", F.lit(True).alias("_new"))
        now = now.join(mine, "id", "left").withColumn(
            "status", F.when(F.col("_new") & (F.col("status") == "candidate"), "deployed")
            .otherwise(F.col("status"))).select(*cols)
        accepted = scores.agg(F.round(F.max("val"), 4).alias("val")).select(
            F.lit(True).alias("accepted"), "val")
    now = durable(now)
    minted = lifecycle.mint_checkpoints(now, guarded, step)
    if not do_checkpoint:
        minted = minted.limit(0)
    minted = durable(minted)
    new_rules = new_rules.unionByName(minted.select("id", "kind", "statement"))
    counts = [
        folded["inserted"].agg(F.count("*").alias("inserted")),
        folded["merged"].agg(F.count("*").alias("merged")), n_split, accepted,
        now.agg(F.count_if(F.col("status") == "deployed").alias("deployed"),
                F.count_if(F.col("status") == "retired").alias("retired_total")),
        minted.agg(F.count("*").alias("checkpoints"))]
    history = counts[0].withColumn("round", F.lit(round_no).cast("long"))
    for c in counts[1:]:
        history = history.crossJoin(F.broadcast(c))  # one row each
    return {"skills": now, "edges": new_edges, "rules": new_rules, "checkpoints": minted,
            "history": history, **{k: folded[k] for k in ("inserted", "merged", "evidence")}}
