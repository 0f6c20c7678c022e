"""Evaluation: labels as outcomes, orders as rounds and rules, routes over parts."""

from pyspark.sql import functions as F

from ropewalk.operators import evaluation as e

from .registry import check
from .routing import part_routes


def arm(v, name):
    return v.eval.select("id", "instruction_type", "lang", F.col(name).alias("success"))


for _mode, _join in (("exclude", "JOIN"), ("fail", "LEFT JOIN")):
    def _make(mode):
        def j01(v):
            return e.score_on_split(arm(v, "a").select("id", "success"), v.splits, mode)
        return j01
    check(f"j01_score_on_split_{_mode}", f"""--- SELECT split, count(*) FILTER (coalesce(a, false)) AS n_correct,
        count(*) AS n_total, round(count(*) FILTER (coalesce(a, false)) / count(*), 6) AS accuracy
        FROM v_splits s {_join} v_eval e ON e.id = s.id GROUP BY 1""")(_make(_mode))

_ROUTED = """ok AS (SELECT o_custkey AS task_id, count(*) FILTER (o_orderstatus = 'F') * 2 >= count(*) AS success
    FROM orders GROUP BY 1)"""


def outcomes(v):
    return v.table("orders").groupBy(F.col("o_custkey").alias("task_id")).agg(
        (F.count_if(F.col("o_orderstatus") == "F") * 2 >= F.count("*")).alias("success"))


@check("j02_attribute_routes", _ROUTED + """--- SELECT r.id, count(*) FILTER (success) AS success_add,
    count(*) FILTER (NOT success) AS failure_add, count(*) AS visit_add FROM v_route r JOIN ok USING (task_id)
    WHERE task_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def j02(v):
    ids = v.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("task_id"))
    return e.attribute_routes(outcomes(v), part_routes(v).nodes, ids, v.parts, count_visits=True)




@check("j03_evidence_edges", """--- SELECT trace AS src, atom AS dst, 'evidence_for' AS type FROM v_trace_atoms""")
def j03(v):
    one = v.trace_atoms.groupBy("trace").agg(F.collect_set("atom").alias("used_skills"))
    return e.evidence_edges(one, v.parts)[0]


@check("j03_evidence_known", """--- SELECT atom AS id, trace FROM v_trace_atoms JOIN v_parts ON id = atom
    WHERE status = 'deployed'""")
def j03_known(v):
    one = v.trace_atoms.groupBy("trace").agg(F.collect_set("atom").alias("used_skills"))
    return e.evidence_edges(one, v.parts.filter("status = 'deployed'"))[1]


@check("j04_rule_edges", """--- SELECT id AS src, target AS dst, CASE kind WHEN 'checkpoint' THEN 'guards_skill' ELSE
    'applies_to_skill' END AS type FROM v_rules UNION ALL SELECT id, round, CASE kind WHEN 'checkpoint' THEN
    'guards_skill' ELSE 'applies_to_skill' END FROM v_rules""")
def j04(v):
    return e.rule_edges(v.rules.select("id", "kind", F.array("target", "round").alias("targets")))


@check("j09_never_used", """--- SELECT id FROM v_parts WHERE status = 'deployed' AND id NOT IN (SELECT id FROM v_route)""")
def j09(v):
    return e.never_used(v.parts, part_routes(v).nodes).select("id")


@check("j14_instance_report", """r AS (SELECT l_orderkey AS id, string_agg(DISTINCT l_suppkey::VARCHAR, ', ' ORDER BY
    l_suppkey::VARCHAR) AS routed FROM lineitem GROUP BY 1)
    --- SELECT e.id, lang AS type, CASE WHEN a THEN 'pass' ELSE 'fail' END AS result, CASE WHEN e.id % 5 = 0 THEN '?'
    ELSE (e.id % 4)::VARCHAR END || '/4' AS subtests, coalesce(routed, '—') AS routed, CAST(a AS INTEGER) AS place
    FROM v_eval e LEFT JOIN r ON r.id = e.id""")
def j14(v):
    r = v.table("lineitem").select(F.col("l_orderkey").alias("id"),
                                   F.col("l_suppkey").cast("string").alias("node"))
    res = arm(v, "a").select("id", "success", "instruction_type", F.when(F.col("id") % 5 != 0, F.col("id") % 4)
                             .alias("passed_count"), F.lit(4).alias("total_count"))
    return e.instance_report(res, r)


@check("j15_paired_arms", """--- SELECT CASE WHEN a AND b THEN 'both_right' WHEN b THEN 'rescued' WHEN a THEN 'regressed'
    ELSE 'both_wrong' END AS transition, count(*) AS n, CAST(sum(CAST(b AS INTEGER) - CAST(a AS INTEGER)) AS BIGINT) AS net
    FROM v_eval GROUP BY 1""")
def j15(v):
    return e.paired_arms(arm(v, "a"), arm(v, "b"))


@check("p14_instance_filter", """--- SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT p_partkey * 3 FROM part)
    AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def p14(v):
    items = v.table("documents").select(F.col("doc_id").alias("id"))
    ids = v.table("part").select((F.col("p_partkey") * 3).alias("id"))
    return e.instance_filter(items, ids, v.table("labels").select(F.col("doc_id").alias("id")))[0]


@check("p14_instance_missing", """--- SELECT p_partkey * 3 AS id FROM part WHERE p_partkey * 3 NOT IN (SELECT doc_id
    FROM documents)""")
def p14_missing(v):
    items = v.table("documents").select(F.col("doc_id").alias("id"))
    return e.instance_filter(items, v.table("part").select((F.col("p_partkey") * 3).alias("id")))[1]


@check("p15_type_key", """--- SELECT doc_id, CASE WHEN source = '' THEN '?' ELSE split_part(trim(lang || ' ' || source), ' ', 1)
    END AS type FROM documents""")
def p15(v):
    from ropewalk.functions import type_key
    return v.table("documents").select("doc_id", type_key(F.when(
        F.col("source") != "", F.concat(F.lit(" "), "lang", F.lit("  "), "source"))).alias("type"))


@check("p16_sample_instances", """--- SELECT doc_id AS id FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 100""")
def p16(v):
    return e.sample_instances(v.table("documents").select(F.col("doc_id").alias("id")), 7, 100)


@check("p17_skill_listing", r"""--- SELECT id, status, lang AS task_types, left(replace(replace(body, '. ', '|'), '|', '\|'), 90)
    AS description FROM v_skills""")
def p17(v):
    return e.skill_listing(v.skills.withColumn("description", F.replace("body", F.lit(". "), F.lit("|"))))


@check("a08_graph_stats", """--- SELECT 'status:' || status AS metric, count(*) AS n FROM v_parts GROUP BY 1 UNION ALL
    SELECT 'skills_total', count(*) FROM v_parts UNION ALL SELECT 'capability_edges', count(*) FROM v_edges
    UNION ALL SELECT 'trace_nodes', count(*) FROM orders UNION ALL SELECT 'governance_nodes', count(*) FROM v_rules
    UNION ALL SELECT 'governance_edges', count(*) FROM v_blocked""")
def a08(v):
    return e.graph_stats(v.parts, v.edges, v.rules, v.table("orders"), v.block_edges)


_KINDS = ["insert_decision", "checkpoint", "merge_decision"]


@check("a09_rule_kind_counts", """--- SELECT target, count(*) FILTER (kind = 'insert_decision') AS insert_decision,
    count(*) FILTER (kind = 'checkpoint') AS "checkpoint", count(*) FILTER (kind = 'merge_decision') AS merge_decision
    FROM v_rules GROUP BY 1""")
def a09(v):
    return e.rule_kind_counts(v.rules, "target", _KINDS)


@check("a10_accuracy_by", """--- SELECT coalesce(lang, 'all') AS type, count(*) FILTER (a) AS n_correct, count(*) AS n_total,
    round(count(*) FILTER (a) / count(*), 6) AS accuracy FROM v_eval GROUP BY ROLLUP (lang)""")
def a10(v):
    return e.accuracy_by(arm(v, "a"), "lang").select(
        F.coalesce("lang", F.lit("all")).alias("type"), "n_correct", "n_total", "accuracy")


def runs(v):
    """Per-invocation rows with every column the run roll-up averages."""
    return v.inv.select(
        "user_id", "success", "ood", F.col("value").alias("tokens"), F.col("skill").alias("loaded"),
        (F.col("skill") / 100.0).alias("negative_transfer"), (F.col("step") % 7 / 7.0).alias("precision"),
        (F.col("step") % 5 / 5.0).alias("covered"), (F.col("step") % 2).alias("synth"))


_RUN = """r AS (SELECT user_id, count(*) AS n, round(avg(CAST(success AS INTEGER)), 6) AS success, round(avg(value), 6) AS tokens,
    round(avg(skill), 6) AS loaded, round(avg(skill / 100.0), 6) AS neg_transfer, round(avg(step % 7 / 7.0), 6)
    AS route_precision, round(avg(step % 5 / 5.0), 6) AS covered, round(avg(step % 2), 6) AS synth,
    coalesce(avg(CAST(success AS INTEGER)) FILTER (ood), 0.0) AS os, coalesce(avg(CAST(success AS INTEGER)) FILTER
    (NOT ood), 0.0) AS ids FROM v_inv GROUP BY 1)"""


@check("a11_run_metrics", _RUN + """--- SELECT * EXCLUDE (os, ids), round(os, 6) AS ood_success, round(ids, 6) AS id_success,
    round(os - ids, 6) AS ood_gain FROM r""")
def a11(v):
    return e.run_metrics(runs(v), ["user_id"])


@check("a11_run_metrics_baseline", _RUN + """, b AS (SELECT user_id, avg(CAST(step % 2 = 0 AS INTEGER)) AS base FROM v_inv
    WHERE ood GROUP BY 1) --- SELECT r.user_id, round(os - coalesce(base, 0.0), 6) AS ood_gain FROM r
    LEFT JOIN b ON b.user_id = r.user_id""")
def a11_base(v):
    base = v.inv.filter("ood").groupBy("user_id").agg(
        F.avg((F.col("step") % 2 == 0).cast("double")).alias("base_ood"))
    return e.run_metrics(runs(v), ["user_id"], base).select("user_id", "ood_gain")


_Q = """req AS (SELECT task_id, id FROM v_closure), dir AS (SELECT task_id, id FROM v_seeds),
    ld AS (SELECT task_id, id FROM v_route UNION SELECT task_id, (task_id * 13 + 1) % (SELECT count(*) FROM part)
      FROM v_seeds), an AS (SELECT DISTINCT task_id, (task_id * 13 + 1) % (SELECT count(*) FROM part) AS id FROM v_seeds
      WHERE task_id % 2 = 0),
    u AS (SELECT task_id, id FROM req UNION SELECT task_id, id FROM ld),
    f AS (SELECT u.task_id, u.id, ld.id IS NOT NULL AS l, req.id IS NOT NULL AS r, dir.id IS NOT NULL AS d,
      an.id IS NOT NULL AS a, u.id % 23 = 0 AS p FROM u
      LEFT JOIN ld ON ld.task_id = u.task_id AND ld.id = u.id LEFT JOIN req ON req.task_id = u.task_id AND req.id = u.id
      LEFT JOIN dir ON dir.task_id = u.task_id AND dir.id = u.id LEFT JOIN an ON an.task_id = u.task_id AND an.id = u.id),
    t AS (SELECT task_id, count(*) FILTER (l) AS loaded, count(*) FILTER (r) AS required, count(*) FILTER (l AND r) AS hit,
      count(*) FILTER (l AND NOT r AND a) AS bad, count(*) FILTER (l AND NOT r AND NOT a) AS irr,
      count(*) FILTER (l AND p) AS poi, count(*) FILTER (l AND d) AS dh FROM f GROUP BY 1)"""


@check("a12_route_quality", _Q + """--- SELECT task_id, loaded, required, round(CASE WHEN required > 0 THEN hit / required
    ELSE 1.0 END, 4) AS covered, round(least(1.0, (bad + poi + 0.2::DOUBLE * irr) / greatest(1, loaded + poi)), 4)
    AS negative_transfer, round(CASE WHEN loaded > 0 THEN dh / loaded ELSE 0.0 END, 4) AS precision FROM t""")
def a12(v):
    n = v.table("part").count()
    odd = v.part_tasks.select("task_id", F.expr(f"(task_id * 13 + 1) % {n}").alias("id"))
    from ropewalk.operators.routing import dependency_closure
    loaded = part_routes(v).nodes.select("task_id", "id").union(odd)
    req = dependency_closure(v.stored_seeds, v.dep, v.stored_parts)
    poison = v.parts.filter("id % 23 = 0")
    return e.route_quality(loaded, req, v.seeds, odd.filter("task_id % 2 = 0"), poison)


@check("a13_seed_mean", """--- SELECT task_type AS method, round(avg(value), 6) AS value, round(avg(skill), 6) AS skill
    FROM v_inv GROUP BY 1""")
def a13(v):
    return e.seed_mean(v.inv.withColumnRenamed("task_type", "method"), ["method"], ["value", "skill"])


@check("a14_seed_matrix", """--- SELECT o_orderpriority AS bench, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 2)
    AS "F_mean", count(*) FILTER (o_orderstatus = 'F') AS "F_n", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 2)
    AS "O_mean", count(*) FILTER (o_orderstatus = 'O') AS "O_n", round(avg(o_totalprice) FILTER (o_orderstatus = 'X'), 2)::DOUBLE
    AS "X_mean", count(*) FILTER (o_orderstatus = 'X') AS "X_n" FROM orders GROUP BY 1""")
def a14(v):
    o = v.table("orders").select(F.col("o_orderpriority").alias("bench"), F.col("o_orderstatus").alias("tier"),
                                 F.col("o_totalprice").alias("score"))
    m = e.seed_matrix(o, ["bench"], ["F", "O", "X"], "score", 2)
    return m.select("bench", *[F.coalesce(c, F.lit(0)).alias(c) if c.endswith("_n") else F.col(c)
                               for c in m.columns if c != "bench"])


@check("a15_token_load", """c AS (SELECT id, greatest(1, length(body) // 4) AS c FROM v_parts),
    t AS (SELECT task_id, sum(c) AS t, count(*) AS k FROM v_route JOIN c USING (id) GROUP BY 1)
    --- SELECT round(avg(t), 6) AS mean_tokens, round(avg(k), 6) AS mean_nodes, (SELECT CAST(sum(c) AS BIGINT) FROM c)
    AS full_tokens, round((SELECT sum(c) FROM c) / avg(t), 6) AS ratio FROM t""")
def a15(v):
    return e.token_load(part_routes(v).nodes, v.stored_parts)


@check("a16_usage", """--- SELECT p.id, count(r.id) AS n_routed FROM v_parts p LEFT JOIN v_route r ON r.id = p.id
    WHERE p.status = 'deployed' GROUP BY 1""")
def a16(v):
    return e.usage(part_routes(v).nodes, v.stored_parts)


@check("a16_usage_summary", """u AS (SELECT p.id, count(r.id) AS n FROM v_parts p LEFT JOIN v_route r ON r.id = p.id
    WHERE p.status = 'deployed' GROUP BY 1), t AS (SELECT task_id, count(*) AS k, max(CAST(id % 7 = 0 AS INTEGER)) AS g
    FROM v_route GROUP BY 1)
    --- SELECT (SELECT count(*) FROM u WHERE n > 0) AS n_used, (SELECT count(*) FROM u WHERE n = 0) AS n_unused,
    count(*) AS n_tasks, round(avg(k), 6) AS mean_nodes, min(k) AS min_nodes, max(k) AS max_nodes,
    count(*) FILTER (g = 1) AS n_guarded FROM t""")
def a16_summary(v):
    return e.usage_summary(part_routes(v).nodes, v.stored_parts, v.guard_edges)


@check("a17_theme_usage", """--- SELECT split_part(name, ' ', 1) AS theme, CAST(sum(success_count + failure_count) AS BIGINT)
    AS trials, count(*) AS n_skills FROM v_parts WHERE status = 'deployed' GROUP BY 1""")
def a17(v):
    themes = v.parts.select("name", F.split("name", " ")[0].alias("theme")).distinct()
    return e.theme_usage(v.parts, themes)


_ATT = """t AS (SELECT *, min(CASE WHEN ok THEN n END) OVER (PARTITION BY run) AS s FROM v_attempts WHERE n <= 2),
    ev AS (SELECT *, CASE WHEN NOT ok THEN 'caused_failure' WHEN n > 0 THEN 'fixed_by' ELSE '' END AS evidence
    FROM t WHERE s IS NULL OR n <= s)"""


@check("a21_attempt_outcomes", _ATT + """--- SELECT run, min(skill) AS skill, bool_or(ok) AS ok, count(*) AS n_attempts
    FROM ev GROUP BY 1""")
def a21(v):
    return e.attempt_outcomes(v.attempts)


@check("a21_attempt_counters", _ATT + """--- SELECT skill, count(*) FILTER (ok) AS success_add, count(*) FILTER (NOT ok)
    AS failure_add, count(*) FILTER (evidence = 'fixed_by') AS fixed_by, count(*) FILTER (evidence = 'caused_failure')
    AS caused_failure FROM ev GROUP BY 1""")
def a21_counters(v):
    return e.attempt_counters(e.attempt_evidence(v.attempts))


@check("a21_attempt_evidence", _ATT + "--- SELECT run, skill, n, ok, evidence FROM ev")
def a21_evidence(v):
    return e.attempt_evidence(v.attempts).withColumn("evidence", F.coalesce("evidence", F.lit("")))


@check("a22_round_history", """--- SELECT round, count(*) FILTER (kind = 'insert_decision') AS inserted, count(*) FILTER
    (kind = 'merge_decision') AS merged, false AS accepted FROM v_rules GROUP BY 1""")
def a22(v):
    h = e.round_history(v.rules.select("round", "kind"), ["insert_decision", "merge_decision"])
    return h.select("round", F.col("insert_decision").alias("inserted"),
                    F.col("merge_decision").alias("merged"), "accepted")


@check("a23_per_round_accuracy", """r AS (SELECT e.id, e.lang, s.split AS round, b AS success, CASE WHEN a THEN 'easy' ELSE 'hard' END
    AS diff FROM v_eval e JOIN v_splits s ON s.id = e.id), g AS (SELECT round, 'category:' || lang AS grp, success FROM r
    UNION ALL SELECT round, 'difficulty:' || diff, success FROM r UNION ALL SELECT round, 'overall', success FROM r)
    --- SELECT round, grp, count(*) FILTER (success) AS n_correct, count(*) AS n_total,
    round(count(*) FILTER (success) / count(*), 6) AS accuracy FROM g GROUP BY 1, 2""")
def a23(v):
    ev = arm(v, "b").join(v.splits.withColumnRenamed("split", "round"), "id")
    return e.per_round_accuracy(ev, arm(v, "a").select("id", "success"), "lang")


@check("a24_ablation_delta", """m AS (SELECT task_type AS variant, round(avg(value), 6) AS value, round(avg(skill), 6) AS skill
    FROM v_inv GROUP BY 1) --- SELECT m.*, round(m.value - r.value, 6) AS delta_value, round(m.skill - r.skill, 6)
    AS delta_skill FROM m, (SELECT * FROM m WHERE variant = 'view') r""")
def a24(v):
    m = e.seed_mean(v.inv.withColumnRenamed("task_type", "variant"), ["variant"], ["value", "skill"])
    return e.ablation_delta(m, "variant", "view", ["value", "skill"])


_ORD = "o AS (SELECT *, row_number() OVER (ORDER BY step) - 1 AS p, count(*) OVER () AS n FROM v_inv)"


@check("w02_late_success", _ORD + """--- SELECT round(avg(CAST(success AS INTEGER)), 6) AS late_success, count(*) AS n_late
    FROM o WHERE p >= floor(n * 0.7)""")
def w02(v):
    return e.late_success(v.inv, "step")


_WIN = _ORD + """, w AS (SELECT p // greatest(1, n // 10) AS "window", avg(CAST(success AS INTEGER)) AS mean, count(*) AS n
    FROM o GROUP BY 1)"""


@check("w03_window_stability", _WIN + """--- SELECT count(*) AS n_windows, round(stddev_pop(mean), 6) AS window_std,
    round(1 - stddev_pop(mean), 6) AS stability FROM w""")
def w03(v):
    return e.window_stability(v.inv, "step")


@check("w03_window_means", _WIN + """--- SELECT "window", round(mean, 6) AS mean, n FROM w""")
def w03_means(v):
    return e.window_means(v.inv, "step").withColumn("mean", F.round("mean", 6))


@check("w06_unique_visited", """f AS (SELECT instance, cursor AS id, min(pos) AS p FROM v_nav WHERE action IN ('locate', 'step_to')
    GROUP BY 1, 2) --- SELECT instance, id, row_number() OVER (PARTITION BY instance ORDER BY p) - 1 AS rn FROM f""")
def w06(v):
    return e.unique_visited(v.nav)


_BEST = """g AS (SELECT *, greatest(100000.0, coalesce(max(score) OVER (PARTITION BY run ORDER BY round ROWS BETWEEN
    UNBOUNDED PRECEDING AND 1 PRECEDING), 100000.0)) AS best FROM v_rounds)"""


@check("w10_gate_replay", _BEST + """--- SELECT run, round, score AS measured, score > best AS accepted,
    greatest(best, score) AS carried FROM g""")
def w10(v):
    return e.gate_replay(v.rounds, "run", "round", 100000.0)


@check("w11_library_growth", """--- SELECT run, round, 1 AS n, count(*) OVER (PARTITION BY run ORDER BY round) AS cumulative
    FROM v_rounds""")
def w11(v):
    return e.library_growth(v.rounds.withColumn("n", F.lit(1)), "run", "round")


@check("w12_failures_first", """--- SELECT user_id AS round, step AS seq, CAST(success AS INTEGER) AS hard, row_number() OVER
    (PARTITION BY user_id ORDER BY success, step) AS rank FROM v_inv WHERE task_type <> 'error' QUALIFY rank <= 12""")
def w12(v):
    t = v.inv.select(F.col("user_id").alias("round"), F.col("step").alias("seq"), F.col("success").cast("int")
                     .alias("hard"), F.when(F.col("task_type") == "error", " ").otherwise("log").alias("trace"))
    return e.failures_first(t).select("round", "seq", "hard", "rank")


@check("w13_lifecycle_spans", """--- SELECT id, status, mint_round, CASE WHEN status <> 'deployed' THEN status WHEN trials > 0 THEN
    'used' WHEN mint_round = (SELECT max(mint_round) FROM v_ledger) THEN 'unmeasured' ELSE 'zombie' END AS label
    FROM v_ledger""")
def w13(v):
    return e.lifecycle_spans(e.ledger(v.rule_skills, v.rules)).select(
        "id", "status", F.coalesce("mint_round", F.lit(-1)).alias("mint_round"), "label")


@check("g23_ledger", "--- SELECT * FROM v_ledger")
def g23(v):
    led = e.ledger(v.rule_skills, v.rules)
    none = {"mint_round": -1, "checkpoint_round": -1, "checkpoint_trials": -1}
    return led.select(*[F.coalesce(c, F.lit(none[c])).cast("long").alias(c) if c in none else F.col(c)
                        for c in led.columns])


@check("g23_round_decisions", """--- SELECT round, max_by(CASE kind WHEN 'insert_decision' THEN 'accept' ELSE 'reject' END, seq)
    AS decision FROM v_rules WHERE kind <> 'checkpoint' GROUP BY 1""")
def g23_rounds(v):
    k = F.when(F.col("kind") == "insert_decision", "accept").when(
        F.col("kind") == "merge_decision", "rejected_edit").otherwise(F.col("kind"))
    return e.round_decisions(v.rules.withColumn("kind", k))


_AT = """keep AS (SELECT id FROM v_ledger WHERE status = 'deployed' AND mint_round BETWEEN 0 AND 1),
    ed AS (SELECT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS dst FROM orders)"""


@check("g24_graph_at_round", _AT + """--- SELECT 'skill' AS part, count(*) AS n, CAST(coalesce(sum(id), 0) AS BIGINT) AS checksum
    FROM keep UNION ALL SELECT 'edge', count(*), CAST(coalesce(sum(src + dst), 0) AS BIGINT) FROM ed WHERE src IN
    (SELECT id FROM keep) AND dst IN (SELECT id FROM keep) UNION ALL SELECT 'checkpoint', count(*),
    CAST(coalesce(sum(id), 0) AS BIGINT) FROM v_ledger WHERE id IN (SELECT id FROM keep) AND checkpoint_round BETWEEN 0 AND 1""")
def g24(v):
    n = v.table("customer").count()
    ed = v.table("orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % n).alias("dst"))
    sk, edges, cp = e.graph_at_round(e.ledger(v.rule_skills, v.rules), v.rule_skills, ed, 1)

    def row(name, df, value):
        return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("checksum")).select(
            F.lit(name).alias("part"), "n", "checksum")

    return row("skill", sk, F.col("id")).union(row("edge", edges, F.col("src") + F.col("dst"))).union(
        row("checkpoint", cp, F.col("id")))
