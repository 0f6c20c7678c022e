"""Status transitions driven by usage counters.

``skills`` needs id, name, status, body, task_types and the counters success_count,
failure_count, n_visit, coverage, last_used_step. Sweeps return a new skills table, and rule rows
where the sweep leaves a record: ``rules(id, kind, statement, target)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scoring import HeatConfig, skill_heat, success_rate, trials, utility
from ..functions.text import est_tokens, slugify, strip
from .ordered import rank_index, row_index


# ---------------------------------------------------------------------------------- predicates
def should_split(skills: DataFrame, max_tokens: int = 600, min_types: int = 3,
                 unit: str = "tokens") -> DataFrame:
    """Large and serving many task types. ``unit`` is tokens (four characters) or chars."""
    size = F.floor(F.length("body") / 4) if unit == "tokens" else F.length("body")
    return skills.filter((size >= max_tokens) & (F.size("task_types") >= min_types))


def split_by_entropy(skills: DataFrame, entropies: DataFrame, max_tokens: int = 600,
                     min_entropy: float = 1.0) -> DataFrame:
    """Third mode of the same test: body size and entropy of the task types in the use log."""
    hot = entropies.filter(F.col("entropy") > min_entropy).select("id")
    return skills.filter(est_tokens("body") > max_tokens).join(hot, "id", "left_semi")


def divergent(skills: DataFrame, min_types: int = 3, min_body: int = 600) -> DataFrame:
    return should_split(skills.filter(F.col("status") != "retired"), min_body, min_types, "chars")


def chronic_failers(skills: DataFrame, blocked_ids: DataFrame, min_trials: int = 10,
                    max_rate: float = 0.30) -> DataFrame:
    return skills.filter((F.col("status") != "retired") & (trials() >= min_trials)
                         & (success_rate() < max_rate)).join(blocked_ids, "id", "left_anti")


def error_prone(skills: DataFrame, guarded_ids: DataFrame, min_trials: int = 3,
                max_rate: float = 0.6) -> DataFrame:
    return skills.filter((F.col("status") == "deployed") & (trials() >= min_trials)
                         & (success_rate() <= max_rate)).join(guarded_ids, "id", "left_anti")


def cold(skills: DataFrame, step: int, cold_after: int = 60) -> DataFrame:
    out = skills.filter(~F.col("status").isin("candidate", "retired") & (F.col("n_visit") == 0))
    return out if step >= cold_after else out.filter(F.lit(False))


def low_value(skills: DataFrame, step: int, floor: float, cfg: HeatConfig = HeatConfig(),
              min_trials: int = 6) -> DataFrame:
    """Tried, mostly failing, and under the utility floor. Utility of one record does not depend
    on the others, so removing the worst one at a time equals this filter."""
    return skills.filter(
        ~F.col("status").isin("candidate", "retired") & (trials() >= min_trials)
        & (success_rate() < 0.5) & (utility(F.lit(step), cfg) < floor))


def verify_gate(changes: DataFrame, tol: float = 0.01, mode: str = "gain") -> DataFrame:
    """Accept flag and reason per row of before/after numbers.

    Inputs: before_success, before_tokens, before_transfer and the same with ``after_``.
    ``gain`` tolerates a small loss but wants a strict gain in tokens or negative transfer;
    ``non_worse`` wants none of the three worse.
    """
    kept = F.col("after_success") >= F.col("before_success") - F.lit(tol)
    cheaper = F.col("after_tokens") < F.col("before_tokens")
    safer = F.col("after_transfer") < F.col("before_transfer")
    if mode == "non_worse":
        ok = ((F.col("after_success") >= F.col("before_success"))
              & (F.col("after_tokens") <= F.col("before_tokens"))
              & (F.col("after_transfer") <= F.col("before_transfer")))
        return changes.withColumn("accept", ok).withColumn(
            "reason", F.when(ok, "accept: none worse").otherwise("reject: something worse"))
    # The words of the decision text.
    gains = F.concat_ws("+", F.when(cheaper, "tokens↓"), F.when(safer, "neg-transfer↓"))
    reason = (F.when(~kept, "reject: success regressed")
              .when(cheaper | safer, F.concat(F.lit("accept: "), gains))
              .otherwise("reject: no cost/transfer gain"))
    return changes.withColumn("accept", kept & (cheaper | safer)).withColumn("reason", reason)


# ---------------------------------------------------------------------------------- changes
def update_fields(skills: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overwrite the non-null fields of ``changes`` by id. Returns the new table with a
    ``reembed`` flag, and the ids that do not exist."""
    fields = [c for c in changes.columns if c != "id" and c in skills.columns]
    new = changes.select("id", *[F.col(c).alias(f"_n_{c}") for c in fields])
    touched = [F.col(f"_n_{c}").isNotNull() for c in ("body", "description") if c in fields]
    flag = F.lit(False)
    for t in touched:
        flag = flag | t
    out = skills.join(new, "id", "left").select(
        *[F.coalesce(f"_n_{c}", c).alias(c) if c in fields else F.col(c) for c in skills.columns],
        flag.alias("reembed"))
    return out, changes.select("id").join(skills.select("id"), "id", "left_anti")


def _set_status(skills: DataFrame, ids: DataFrame, status: str | Column) -> DataFrame:
    value = F.lit(status) if isinstance(status, str) else status
    mark = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return (skills.join(mark, "id", "left")
            .withColumn("status", F.when(F.col("_hit"), value).otherwise(F.col("status")))
            .drop("_hit"))


def retire_ids(skills: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retire the given ids; also returns the ids that do not exist."""
    return _set_status(skills, ids, "retired"), ids.select("id").join(
        skills.select("id"), "id", "left_anti")


def deploy_ids(skills: DataFrame, ids: DataFrame) -> DataFrame:
    """Deploy the given ids."""
    return _set_status(skills, ids, "deployed")


def deploy_cap(skills: DataFrame, cap: int, step: int,
               cfg: HeatConfig = HeatConfig()) -> DataFrame:
    """Ids to demote so that at most ``cap`` stay deployed: lowest utility first, earlier ord on
    ties.

    Ranks come from counts per utility level, so the records are never sorted in one task.
    """
    on = skills.filter(F.col("status") == "deployed").select(
        "id", "ord", F.round(utility(F.lit(step), cfg), 6).alias("utility"))
    ranked = rank_index(on.withColumn("_u", F.round(F.col("utility") * 1000000).cast("long")),
                        "_u", "ord", "_at")
    over = on.agg((F.count("*") - F.lit(cap)).alias("_over"))
    return (ranked.crossJoin(F.broadcast(over))  # one row
            .filter(F.col("_at") < F.col("_over")).select("id", "utility"))


def promotable(skills: DataFrame, step: int | Column, cfg: HeatConfig = HeatConfig(),
               deploy_heat: float = 2.0) -> DataFrame:
    """Validated records that are hot enough, or untried, at ``step`` (a number, or a column of the rows)."""
    now = step if isinstance(step, Column) else F.lit(step)
    return skills.filter((F.col("status") == "validated")
                         & ((skill_heat(now, cfg) >= deploy_heat) | (trials() == 0)))


def promote(skills: DataFrame, step: int, cfg: HeatConfig = HeatConfig(),
            deploy_heat: float = 2.0, cap: int | None = None) -> DataFrame:
    """Validated records that are hot enough, or untried, become deployed; then the cap."""
    hot = (skill_heat(F.lit(step), cfg) >= deploy_heat) | (trials() == 0)
    out = skills.withColumn("status", F.when((F.col("status") == "validated") & hot, "deployed")
                            .otherwise(F.col("status")))
    return out if cap is None else _set_status(out, deploy_cap(out, cap, step, cfg), "validated")


def block_rules(failers: DataFrame, step: int, max_rate: float = 0.30) -> DataFrame:
    """Rule rows that keep chronic failers out of routing."""
    return failers.select(
        slugify(F.concat(F.lit("block_"), F.col("id").cast("string"), F.lit(f"_{step}")))
        .alias("id"), F.lit("block_signal").alias("kind"),
        F.concat(F.lit("BLOCKS_ROUTING "), F.col("id").cast("string"),
                 F.lit(f" (success_rate<{max_rate})")).alias("statement"),
        F.col("id").alias("target"), F.lit("blocks_routing").alias("edge_type"))


def retire_rules(gone: DataFrame, step: int) -> DataFrame:
    return gone.select(
        slugify(F.concat(F.lit("retire_"), F.col("id").cast("string"), F.lit(f"_{step}")))
        .alias("id"), F.lit("retirement_signal").alias("kind"),
        F.concat(F.lit("RETIRE "), F.col("id").cast("string"),
                 F.lit(" (utility below floor)")).alias("statement"),
        F.col("id").alias("target"), F.lit("applies_to_skill").alias("edge_type"))


def mint_checkpoints(skills: DataFrame, guarded_ids: DataFrame, step: int,
                     min_trials: int = 3, max_rate: float = 0.6, max_retries: int = 2,
                     postcondition: Column | None = None) -> DataFrame:
    """Checkpoint rules for error-prone records that have no guard yet.

    ``postcondition`` is a Column over the skill row; where it is null or blank the default text
    stands.
    """
    sid = F.col("id").cast("string")
    # The wording of generated checkpoints.
    default = F.concat(F.lit("The result of '"), F.col("name"),
                       F.lit("' is correct and complete: it did the task's intended edit, ran "
                             "without error, and left the spreadsheet consistent."))
    given = F.lit(None).cast("string") if postcondition is None else strip(postcondition)
    return error_prone(skills, guarded_ids, min_trials, max_rate).select(
        slugify(F.concat(F.lit("checkpoint_"), sid, F.lit(f"_{step}"))).alias("id"),
        F.lit("checkpoint").alias("kind"),
        F.concat(F.lit("verify-loop guards '"), sid, F.lit("' (succ "),
                 # hundredths of the rate as it is stored: rounding its shortest decimal would take 23/40 up
                 F.format_string("%.2f", F.round(success_rate() * 100) / 100), F.lit(" over "),
                 trials().cast("string"), F.lit(" trials)")).alias("statement"),
        F.col("id").alias("target"),
        F.when(F.length(given) > 0, given).otherwise(default).alias("postcondition"),
        F.lit(max_retries).cast("long").alias("max_retries"),
        F.concat(F.lit("Previous attempt at '"), F.col("name"),
                 F.lit("' failed its check. Re-read the requirement and fix the specific "
                       "failure.")).alias("repair_hint"),
        F.lit("guards_skill").alias("edge_type"))


def validate_candidates(skills: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates become validated where the gate accepted; ``decisions(id, accept)``."""
    ok = decisions.filter("accept").select("id", F.lit(True).alias("_ok")).distinct()
    return (skills.join(ok, "id", "left")
            .withColumn("status", F.when(F.col("_ok") & (F.col("status") == "candidate"),
                                         "validated").otherwise(F.col("status"))).drop("_ok"))


def logical_clock(stream: DataFrame, order: str, name: str = "step") -> DataFrame:
    """Step number 1, 2, 3, ... over the whole stream by a unique integer order."""
    return row_index(stream, [], order, "_at").withColumn(name, F.col("_at") + 1).drop("_at")
