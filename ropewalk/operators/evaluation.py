"""Joining outcomes to what was used, and rolling them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import rule_stats, rule_step, type_key
from ..functions.scoring import success_rate, trials
from ..functions.text import est_tokens, loaded_tokens, strip
from .ordered import first_k, prefix, range_rank, row_index


# ---------------------------------------------------------------------------------- scoring
def score_on_split(results: DataFrame, split: DataFrame, missing: str = "exclude") -> DataFrame:
    """n, N and accuracy per split; ``split(split, id)``, ``results(id, success)``.

    ``missing="fail"`` counts ids of the split that have no result as failures.
    """
    how = "inner" if missing == "exclude" else "left"
    ok = F.coalesce(F.col("success"), F.lit(False))
    return (split.select("split", "id").distinct().join(results, "id", how).groupBy("split")
            .agg(F.count_if(ok).alias("n_correct"), F.count("*").alias("n_total"))
            .withColumn("accuracy", F.round(F.col("n_correct") / F.col("n_total"), 6)))


def attribute_routes(results: DataFrame, routes: DataFrame, ids: DataFrame,
                     skills: DataFrame, count_visits: bool = False, step: int | None = None) -> DataFrame:
    """Credit each routed record with the outcome of its task. Visits are only counted on
    request, as attribution and the online loop differ in that. With the current ``step``, credited records were last used at it."""
    hits = (routes.join(ids.select("task_id"), "task_id", "left_semi")
            .join(results.select("task_id", "success"), "task_id")
            .join(skills.select("id"), "id", "left_semi"))
    out = hits.groupBy("id").agg(F.count_if("success").alias("success_add"),
                                 F.count_if(~F.col("success")).alias("failure_add"))
    return _used_at(out.withColumn("visit_add", F.col("success_add") + F.col("failure_add")
                                   if count_visits else F.lit(0).cast("long")), step)


def _used_at(credit: DataFrame, step: int | None) -> DataFrame:
    return credit if step is None else credit.withColumn("last_used_step", F.lit(step).cast("long"))


def credited(skills: DataFrame, credit: DataFrame) -> DataFrame:
    """``skills`` with the counters of ``credit(id, success_add, failure_add, ...)`` added; ``visit_add`` and
    ``last_used_step`` where the credit has them. Time never runs backwards."""
    adds = {"success_count": "success_add", "failure_count": "failure_add", "n_visit": "visit_add"}
    had = {c: a for c, a in adds.items() if a in credit.columns and c in skills.columns}
    row = credit.select("id", *had.values(), *([F.col("last_used_step").alias("_step")] if "last_used_step" in credit.columns else []))
    out = skills.join(row, "id", "left").withColumns({c: F.col(c) + F.coalesce(a, F.lit(0)) for c, a in had.items()})
    if "_step" in out.columns:
        out = out.withColumn("last_used_step", F.greatest("last_used_step", "_step"))  # null where not credited
    return out.select(*skills.columns)


def evidence_edges(traces: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """evidence_for edges trace -> skill for every used skill, and (id, trace) for known ones."""
    used = traces.select(F.col("trace").alias("src"), F.explode("used_skills").alias("dst"))
    edges = used.distinct().withColumn("type", F.lit("evidence_for"))
    known = used.join(skills.select(F.col("id").alias("dst")), "dst", "left_semi").select(
        F.col("dst").alias("id"), F.col("src").alias("trace"))
    return edges, known


def rule_edges(rules: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "checkpoint", "guards_skill").otherwise("applies_to_skill")
    return rules.select(F.col("id").alias("src"), F.explode("targets").alias("dst"),
                        kind.alias("type"))


def never_used(skills: DataFrame, routes: DataFrame) -> DataFrame:
    return skills.filter(F.col("status") == "deployed").join(
        routes.select("id"), "id", "left_anti")


def instance_report(results: DataFrame, routes: DataFrame, ids: DataFrame | None = None,
                    link: str = ", ") -> DataFrame:
    """Per instance: pass or fail, subtests, routed records or a dash. ``place`` orders failures
    first, then by id. A route is one task's short list."""
    listed = routes.groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_set("node")), link).alias("routed"))
    r = results if ids is None else results.join(ids.select("id"), "id", "left_semi")
    return r.join(listed, "id", "left").select(
        "id", type_key("instruction_type").alias("type"),
        F.when(F.col("success"), "pass").otherwise("fail").alias("result"),
        F.concat(F.coalesce(F.col("passed_count").cast("string"), F.lit("?")), F.lit("/"),
                 F.coalesce(F.col("total_count").cast("string"), F.lit("?"))).alias("subtests"),
        F.coalesce("routed", F.lit("—")).alias("routed"),
        F.col("success").cast("int").alias("place")).orderBy("place", "id")


def paired_arms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Transition of each item from arm a to arm b: counts per class."""
    sa, sb = F.col("a_ok"), F.col("b_ok")
    kind = (F.when(sa & sb, "both_right").when(~sa & sb, "rescued")
            .when(sa & ~sb, "regressed").otherwise("both_wrong"))
    j = a.select("id", F.col("success").alias("a_ok")).join(
        b.select("id", F.col("success").alias("b_ok")), "id")
    return j.groupBy(kind.alias("transition")).agg(
        F.count("*").alias("n"), F.sum(sb.cast("int") - sa.cast("int")).alias("net"))


def instance_filter(items: DataFrame, ids: DataFrame,
                    done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Requested items (minus those with output) and requested ids that do not exist."""
    kept = items.join(ids.select("id"), "id", "left_semi")
    if done is not None:
        kept = kept.join(done.select("id"), "id", "left_anti")
    return kept, ids.select("id").distinct().join(items.select("id"), "id", "left_anti")


def sample_instances(items: DataFrame, seed: int, n: int) -> DataFrame:
    """First n in a seeded hash order: the same rows however the table is partitioned."""
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")).cast("binary"))
    return items.orderBy(key, "id").limit(n)


def skill_listing(skills: DataFrame) -> DataFrame:
    text = F.substring(F.replace("description", F.lit("|"), F.lit("\\|")), 1, 90)
    return skills.select("id", "status", F.array_join("task_types", ",").alias("task_types"),
                         text.alias("description"))


# ---------------------------------------------------------------------------------- roll-ups
def nav_attribution(nav: DataFrame, outcomes: DataFrame, skills: DataFrame, step: int | None = None) -> DataFrame:
    """+1 success or failure per distinct visited record and run; ``nav(instance, action,
    cursor)``, ``outcomes(instance, success)``. With the current ``step``, credited records were last used at it."""
    seen = (nav.filter(F.col("action").isin("locate", "step_to") & (F.length("cursor") > 0))
            .select("instance", F.col("cursor").alias("id")).distinct()
            .join(skills.select("id"), "id", "left_semi"))
    return _used_at(seen.join(outcomes, "instance").groupBy("id")
                    .agg(F.count_if("success").alias("success_add"),
                         F.count_if(~F.col("success")).alias("failure_add")), step)


def nav_evidence(nav: DataFrame, outcomes: DataFrame, skills: DataFrame, first: int = 0) -> dict[str, DataFrame]:
    """One trace per run and visited record, in order of (instance, first visit), numbered from ``first`` (the traces there are
    already): ``traces(id, task_id, task_type, success, used_skills)`` and ``edges(src, dst, type)``, fixed_by from the record to
    the trace of a run that passed, caused_failure to that of one that failed. ``nav`` has a unique integer ``pos``."""
    seen = (nav.filter(F.col("action").isin("locate", "step_to") & (F.length("cursor") > 0))
            .groupBy("instance", F.col("cursor").alias("skill")).agg(F.min("pos").alias("_pos"))
            .join(skills.select(F.col("id").alias("skill")), "skill", "left_semi").join(outcomes, "instance"))
    at = range_rank(seen, [F.col("instance"), F.col("_pos")], "_n")
    trace = F.concat(F.lit("trace_"), (F.col("_n") + first).cast("string"))
    return {
        "traces": at.select(trace.alias("id"), F.col("instance").alias("task_id"), F.lit("").alias("task_type"), "success",
                            F.array("skill").alias("used_skills")),
        "edges": at.select(F.col("skill").alias("src"), trace.alias("dst"),
                           F.when(F.col("success"), "fixed_by").otherwise("caused_failure").alias("type")),
    }


def unique_visited(nav: DataFrame) -> DataFrame:
    """Visited records per run in first-seen order; ``nav`` has a unique integer ``pos``."""
    first = (nav.filter(F.col("action").isin("locate", "step_to") & (F.length("cursor") > 0))
             .groupBy("instance", F.col("cursor").alias("id")).agg(F.min("pos").alias("pos")))
    return row_index(first, ["instance"], "pos", "rn").select("instance", "id", "rn")


def graph_stats(skills: DataFrame, edges: DataFrame, rules: DataFrame, traces: DataFrame,
                governance_edges: DataFrame) -> DataFrame:
    """(metric, n): totals, and one row per status."""
    by_status = skills.groupBy(F.concat(F.lit("status:"), "status").alias("metric")).agg(
        F.count("*").alias("n"))

    def total(name, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")

    return (by_status.unionByName(total("skills_total", skills))
            .unionByName(total("capability_edges", edges))
            .unionByName(total("trace_nodes", traces))
            .unionByName(total("governance_nodes", rules))
            .unionByName(total("governance_edges", governance_edges)))


def rule_kind_counts(rules: DataFrame, by: str, kinds: list[str]) -> DataFrame:
    """Counts per run and kind, one column per kind."""
    return rules.groupBy(by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def accuracy_by(results: DataFrame, key: str) -> DataFrame:
    """Correct, total and accuracy per key, and over all rows (key null)."""
    return results.rollup(key).agg(
        F.count_if("success").alias("n_correct"), F.count("*").alias("n_total"),
    ).withColumn("accuracy", F.round(F.col("n_correct") / F.col("n_total"), 6))


def _mean(value: Column, when: Column | None = None) -> Column:
    v = value if when is None else F.when(when, value)
    return F.coalesce(F.avg(v), F.lit(0.0))


def run_metrics(outcomes: DataFrame, by: list[str], baseline: DataFrame | None = None,
                digits: int = 6) -> DataFrame:
    """Run-level averages from per-task rows (success, tokens, loaded, negative_transfer,
    precision, covered, synth, ood). ``ood_gain`` is ood minus id success, or minus the success of
    a baseline run ``(by..., base_ood)`` when one is given."""
    s = F.col("success").cast("double")
    out = outcomes.groupBy(*by).agg(
        F.count("*").alias("n"), _mean(s).alias("success"), _mean(F.col("tokens")).alias("tokens"),
        _mean(F.col("loaded")).alias("loaded"),
        _mean(F.col("negative_transfer")).alias("neg_transfer"),
        _mean(F.col("precision")).alias("route_precision"),
        _mean(F.col("covered")).alias("covered"), _mean(F.col("synth")).alias("synth"),
        _mean(s, F.col("ood")).alias("ood_success"), _mean(s, ~F.col("ood")).alias("id_success"))
    if baseline is None:
        gain = F.col("ood_success") - F.col("id_success")
    else:
        out = out.join(baseline, by, "left")
        gain = F.col("ood_success") - F.coalesce("base_ood", F.lit(0.0))
    out = out.withColumn("ood_gain", gain)
    return out.select(*by, "n", *[F.round(c, digits).alias(c) for c in (
        "success", "tokens", "loaded", "neg_transfer", "route_precision", "covered", "synth",
        "ood_success", "id_success", "ood_gain")])


def route_quality(loaded: DataFrame, required: DataFrame, direct: DataFrame, anti: DataFrame,
                  poison: DataFrame | None = None) -> DataFrame:
    """Coverage, negative transfer and precision per task.

    ``loaded``, ``required`` (closed over dependencies), ``direct`` (not closed) and ``anti`` are
    (task_id, id); ``poison(id)`` marks records that harm wherever they are loaded.
    """
    def flag(df, name):
        return df.select("task_id", "id", F.lit(1).alias(name)).distinct()

    m = (flag(loaded, "_l").join(flag(required, "_r"), ["task_id", "id"], "full")
         .join(flag(direct, "_d"), ["task_id", "id"], "left")
         .join(flag(anti, "_a"), ["task_id", "id"], "left"))
    if poison is not None:
        m = m.join(poison.select("id", F.lit(1).alias("_p")).distinct(), "id", "left")
    else:
        m = m.withColumn("_p", F.lit(None).cast("int"))
    on = F.col("_l").isNotNull()
    req = F.col("_r").isNotNull()
    bad = on & ~req & F.col("_a").isNotNull()
    t = m.groupBy("task_id").agg(
        F.count_if(on).alias("loaded"), F.count_if(req).alias("required"),
        F.count_if(on & req).alias("hit"), F.count_if(bad).alias("anti"),
        F.count_if(on & ~req & F.col("_a").isNull()).alias("irrelevant"),
        F.count_if(on & F.col("_p").isNotNull()).alias("poison"),
        F.count_if(on & F.col("_d").isNotNull()).alias("direct_hit"))
    harm = (F.col("anti") + F.col("poison") + F.lit(0.2) * F.col("irrelevant")) / F.greatest(
        F.lit(1), F.col("loaded") + F.col("poison"))
    return t.select(
        "task_id", "loaded", "required",
        F.round(F.when(F.col("required") > 0, F.col("hit") / F.col("required")).otherwise(1.0), 4)
        .alias("covered"),
        F.round(F.least(F.lit(1.0), harm), 4).alias("negative_transfer"),
        F.round(F.when(F.col("loaded") > 0, F.col("direct_hit") / F.col("loaded"))
                .otherwise(0.0), 4).alias("precision"))


def seed_mean(runs: DataFrame, by: list[str], metrics: list[str], digits: int = 6) -> DataFrame:
    return runs.groupBy(*by).agg(*[F.round(F.avg(m), digits).alias(m) for m in metrics])


def seed_matrix(runs: DataFrame, by: list[str], tiers: list[str], value: str,
                digits: int = 6) -> DataFrame:
    """Mean and count of a value per group, one pair of columns per tier; empty cells null."""
    out = runs.groupBy(*by).pivot("tier", tiers).agg(
        F.round(F.avg(value), digits).alias("mean"), F.count(value).alias("n"))
    return out.select(*by, *[F.col(f"{t}_{s}") for t in tiers for s in ("mean", "n")])


def token_load(routes: DataFrame, skills: DataFrame, digits: int = 6) -> DataFrame:
    """Mean tokens and nodes per routed task, the full load, and their ratio."""
    cost = skills.select("id", est_tokens("body").alias("_c"))
    per_task = routes.join(cost, "id").groupBy("task_id").agg(
        F.sum("_c").alias("_t"), F.count("*").alias("_k"))
    mean = per_task.agg(F.avg("_t").alias("mean_tokens"), F.avg("_k").alias("mean_nodes"))
    full = cost.agg(F.sum("_c").alias("full_tokens"))
    return mean.crossJoin(F.broadcast(full)).select(  # one row each
        F.round("mean_tokens", digits).alias("mean_tokens"),
        F.round("mean_nodes", digits).alias("mean_nodes"), "full_tokens",
        F.round(F.col("full_tokens") / F.col("mean_tokens"), digits).alias("ratio"))


def usage(routes: DataFrame, skills: DataFrame) -> DataFrame:
    """Routings per deployed record, zero included."""
    n = routes.groupBy("id").agg(F.count("*").alias("_n"))
    return skills.filter(F.col("status") == "deployed").select("id").join(n, "id", "left").select(
        "id", F.coalesce("_n", F.lit(0)).alias("n_routed"))


def usage_summary(routes: DataFrame, skills: DataFrame, guarded: DataFrame,
                  digits: int = 6) -> DataFrame:
    """Used and unused records, nodes per task, share of tasks with a guarded node."""
    u = usage(routes, skills).agg(F.count_if(F.col("n_routed") > 0).alias("n_used"),
                                  F.count_if(F.col("n_routed") == 0).alias("n_unused"))
    g = guarded.select("id", F.lit(1).alias("_g")).distinct()
    per = routes.join(g, "id", "left").groupBy("task_id").agg(
        F.count("*").alias("_k"), F.max("_g").alias("_g"))
    t = per.agg(F.count("*").alias("n_tasks"), F.round(F.avg("_k"), digits).alias("mean_nodes"),
                F.min("_k").alias("min_nodes"), F.max("_k").alias("max_nodes"),
                F.count("_g").alias("n_guarded"))
    return u.crossJoin(F.broadcast(t))  # one row each


def theme_usage(skills: DataFrame, themes: DataFrame) -> DataFrame:
    """Trials and record count per theme, from a name -> theme table."""
    return skills.filter(F.col("status") == "deployed").join(themes, "name").groupBy("theme").agg(
        F.sum(trials()).alias("trials"), F.count("*").alias("n_skills"))


def attempt_outcomes(attempts: DataFrame, max_retries: int = 2) -> DataFrame:
    """Per guarded run: passed within 1 + max_retries attempts, and how many were made.
    ``attempts(run, skill, n, ok)`` with n counting from 0."""
    tried = attempts.filter(F.col("n") <= max_retries)
    out = tried.groupBy("run").agg(
        F.min("skill").alias("skill"), F.min(F.when(F.col("ok"), F.col("n"))).alias("first_ok"),
        F.max("n").alias("_last"))
    return out.select("run", "skill", F.col("first_ok").isNotNull().alias("ok"),
                      (F.coalesce("first_ok", "_last") + 1).alias("n_attempts"))


def attempt_evidence(attempts: DataFrame, max_retries: int = 2,
                     rule: str = "after_retry") -> DataFrame:
    """Evidence rows of the attempts that were made: caused_failure for each failure, fixed_by for
    a pass (only after a failure, or any pass with ``rule="any_success"``)."""
    tried = attempts.filter(F.col("n") <= max_retries)
    stop = tried.groupBy("run").agg(F.min(F.when(F.col("ok"), F.col("n"))).alias("_s"))
    made = tried.join(stop, "run").filter(F.col("_s").isNull() | (F.col("n") <= F.col("_s")))
    fixed = F.col("ok") & (F.lit(rule == "any_success") | (F.col("n") > 0))
    return made.select("run", "skill", "n", "ok", F.when(~F.col("ok"), "caused_failure").when(
        fixed, "fixed_by").alias("evidence"))


def attempt_counters(evidence: DataFrame, step: int | None = None) -> DataFrame:
    return _used_at(evidence.groupBy("skill").agg(
        F.count_if("ok").alias("success_add"), F.count_if(~F.col("ok")).alias("failure_add"),
        F.count_if(F.col("evidence") == "fixed_by").alias("fixed_by"),
        F.count_if(F.col("evidence") == "caused_failure").alias("caused_failure")), step)


def round_history(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Per round: one count per kind, and whether the round was accepted."""
    return events.groupBy("round").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds],
        (F.count_if(F.col("kind") == "accept") > 0).alias("accepted"))


def per_round_accuracy(evals: DataFrame, baseline: DataFrame, category: str) -> DataFrame:
    """Accuracy per round x category, x difficulty (easy = the baseline arm was right), and over
    all; ``grp`` names the slice."""
    base = baseline.select("id", F.when(F.col("success"), "easy").otherwise("hard")
                           .alias("difficulty"))
    j = evals.join(base, "id")
    out = j.groupingSets(
        [(F.col("round"), F.col(category)), (F.col("round"), F.col("difficulty")),
         (F.col("round"),)],
        "round", category, "difficulty").agg(
        F.count_if("success").alias("n_correct"), F.count("*").alias("n_total"))
    return out.select(
        "round", F.coalesce(F.concat(F.lit("category:"), category),
                            F.concat(F.lit("difficulty:"), "difficulty"), F.lit("overall"))
        .alias("grp"), "n_correct", "n_total",
        F.round(F.col("n_correct") / F.col("n_total"), 6).alias("accuracy"))


def ablation_delta(metrics: DataFrame, name: str, reference: str, values: list[str],
                   digits: int = 6) -> DataFrame:
    """Every variant's metrics minus the reference variant's."""
    ref = metrics.filter(F.col(name) == reference).agg(
        *[F.max(v).alias(f"_r_{v}") for v in values])
    return metrics.crossJoin(F.broadcast(ref)).select(  # one row
        name, *values, *[F.round(F.col(v) - F.col(f"_r_{v}"), digits).alias(f"delta_{v}")
                         for v in values])


# ---------------------------------------------------------------------------------- over time
def late_success(outcomes: DataFrame, order: str, frac: float = 0.7,
                 digits: int = 6) -> DataFrame:
    """Success over the rows from position int(n * frac) on."""
    placed = row_index(outcomes, [], order, "_at", total="_n")
    return placed.filter(F.col("_at") >= F.floor(F.col("_n") * F.lit(frac))).agg(
        F.round(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)), digits)
        .alias("late_success"), F.count("*").alias("n_late"))


def window_means(outcomes: DataFrame, order: str, parts: int = 10) -> DataFrame:
    """Mean success per run of max(1, n // parts) consecutive rows; the last may be shorter."""
    placed = row_index(outcomes, [], order, "_at", total="_n")
    width = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(parts)))
    return placed.groupBy(F.floor(F.col("_at") / width).alias("window")).agg(
        F.avg(F.col("success").cast("double")).alias("mean"), F.count("*").alias("n"))


def window_stability(outcomes: DataFrame, order: str, parts: int = 10,
                     digits: int = 6) -> DataFrame:
    """Population deviation of the window means, and 1 minus it."""
    m = window_means(outcomes, order, parts).agg(F.count("*").alias("n_windows"),
                                                 F.stddev_pop("mean").alias("_s"))
    std = F.coalesce("_s", F.lit(0.0))
    return m.select("n_windows", F.round(std, digits).alias("window_std"),
                    F.round(F.lit(1.0) - std, digits).alias("stability"))


def gate_replay(rounds: DataFrame, key: str, order: str, baseline: float) -> DataFrame:
    """Accepted iff the score beats everything before it, the baseline included; ``carried`` is
    the running best, ``measured`` the round's own score."""
    best = prefix(rounds, [key], order, {"_best": ("max", "score")})
    before = F.greatest(F.coalesce("_best", F.lit(baseline)), F.lit(baseline))
    return best.select(key, order, F.col("score").alias("measured"),
                       (F.col("score") > before).alias("accepted"),
                       F.greatest(before, F.col("score")).alias("carried"))


def library_growth(events: DataFrame, key: str, order: str, added: str = "n") -> DataFrame:
    """Running total per key, this row included."""
    run = prefix(events, [key], order, {"_before": ("sum", added)})
    return run.select(key, order, added, (F.col("_before") + F.col(added)).alias("cumulative"))


def failures_first(trajectories: DataFrame, cap: int = 12) -> DataFrame:
    """Failures before successes in arrival order per round, blank traces skipped, at most cap."""
    seen = trajectories.filter(F.length(strip("trace")) > 0)
    return first_k(seen, ["round"], [F.col("hard").asc(), F.col("seq").asc()], cap)


def lifecycle_spans(ledger: DataFrame) -> DataFrame:
    """Label deployed records: used, unmeasured (minted in the last round, so no later run could
    use it) or zombie (never used although it could have been)."""
    last = ledger.agg(F.max("mint_round").alias("_last"))
    label = (F.when(F.col("status") != "deployed", F.col("status"))
             .when(F.col("trials") > 0, "used")
             .when(F.col("mint_round") == F.col("_last"), "unmeasured").otherwise("zombie"))
    return ledger.crossJoin(F.broadcast(last)).withColumn("label", label).drop("_last")  # one row


# ---------------------------------------------------------------------------------- history
def with_parsed_step(rules: DataFrame) -> DataFrame:
    """Rules of old exports with the step their id ends in. A name that ends in a number makes that
    number the step, which is why new tables carry the step as a column."""
    return rules.withColumn("step", rule_step("id"))


def ledger(skills: DataFrame, rules: DataFrame) -> DataFrame:
    """Per skill: round it was minted in, its checkpoint round and stats, trials, rate, status.

    ``rules(id, kind, statement, target, seq, step)``; the first insert and the last checkpoint
    count. Old exports have no step, see ``with_parsed_step``."""
    r = rules.withColumn("_step", F.col("step")).withColumn("_st", rule_stats("statement"))
    mint = r.filter(F.col("kind") == "insert_decision").groupBy(F.col("target").alias("id")).agg(
        F.min_by("_step", "seq").alias("_m"))
    guard = r.filter(F.col("kind") == "checkpoint").groupBy(F.col("target").alias("id")).agg(
        F.max_by(F.struct("_step", "_st"), "seq").alias("_c"))
    return (skills.join(mint, "id", "left").join(guard, "id", "left").select(
        "id", "status", (F.col("_m") - 1).alias("mint_round"), trials().alias("trials"),
        F.when(trials() > 0, F.round(success_rate(), 2)).alias("succ"),
        (F.col("_c._step") - 1).alias("checkpoint_round"),
        F.col("_c._st.succ").alias("checkpoint_succ"),
        F.col("_c._st.trials").alias("checkpoint_trials")))


def round_decisions(rules: DataFrame) -> DataFrame:
    """accept or reject per round, the last rule of a round counting."""
    r = rules.filter(F.col("kind").isin("accept", "rejected_edit"))
    return r.groupBy((F.col("step") - 1).alias("round")).agg(
        F.max_by(F.when(F.col("kind") == "accept", "accept").otherwise("reject"), "seq")
        .alias("decision"))


def graph_at_round(led: DataFrame, skills: DataFrame, edges: DataFrame, r: int
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Skills finally deployed and minted by round r, their edges, their checkpoints by round r."""
    keep = led.filter((F.col("status") == "deployed") & (F.col("mint_round") <= r)).select("id")
    sk = skills.join(keep, "id", "left_semi")
    ed = (edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi")
          .join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    cp = led.filter(F.col("checkpoint_round") <= r).select("id", "checkpoint_round").join(
        keep, "id", "left_semi")
    return sk, ed, cp


def route_costs(routes: DataFrame, skills: DataFrame) -> DataFrame:
    return routes.join(skills.select("id", loaded_tokens("token_cost", "body").alias("tokens")),
                       "id")
