"""Lifecycle over parts: order lines are uses, returned lines are failures."""

from pyspark.sql import functions as F

from ropewalk.operators import lifecycle as lc
from ropewalk.operators import routing
from ropewalk.plans.curate import lifecycle_step, validate_round
from ropewalk.session import scratch_path
from ropewalk.sources import readers, sinks

from .registry import check

# The clock stands at a fixed step here; order keys run on, so recency differs by part.
NOW = 1000
_HEAT = (f"(n_visit + coverage + CASE WHEN last_used_step < 0 THEN 0.0 "
         f"ELSE exp(-greatest(0, {NOW} - last_used_step) / 50.0) END)")
_RATE = ("CASE WHEN success_count + failure_count > 0 THEN success_count / "
         "(success_count + failure_count) ELSE {e} END")
_UTIL = f"({_HEAT} * {_RATE.format(e=0.5)})"
_R = _RATE.format(e=0.0)


@check("p05_should_split", """--- SELECT id FROM v_parts WHERE length(body) // 4 >= 5 AND n_types >= 3""")
def p05(v):
    return lc.should_split(v.parts, 5, 3).select("id")


@check("p05_split_by_entropy", """n AS (SELECT id, region, count(*) AS n FROM v_part_use GROUP BY 1, 2),
    p AS (SELECT id, n / sum(n) OVER (PARTITION BY id) AS p FROM n),
    h AS (SELECT id, -sum(p * ln(p)) AS h FROM p GROUP BY 1)
    --- SELECT id FROM v_parts JOIN h USING (id) WHERE greatest(1, length(body) // 4) > 5 AND h > 1.5""")
def p05_entropy(v):
    from ropewalk.operators.mining import type_entropy
    uses = v.part_use.select(F.col("id").alias("skill"), F.col("region").alias("task_type"))
    h = type_entropy(uses).withColumnRenamed("skill", "id")
    return lc.split_by_entropy(v.parts, h, 5, 1.5).select("id")


@check("p06_divergent", """--- SELECT id FROM v_parts WHERE length(body) >= 25 AND n_types >= 5
    AND status <> 'retired'""")
def p06(v):
    return lc.divergent(v.parts, 5, 25).select("id")


def _blocked(v):
    return routing.blocked(v.block_edges)


@check("p07_chronic_failers", f"""--- SELECT id FROM v_parts WHERE status <> 'retired' AND n_visit >= 10
    AND {_R} < 0.6 AND id NOT IN (SELECT id FROM v_blocked)""")
def p07(v):
    return lc.chronic_failers(v.parts, _blocked(v), 10, 0.6).select("id")


@check("p08_error_prone", f"""--- SELECT id FROM v_parts WHERE status = 'deployed' AND n_visit >= 3
    AND {_R} <= 0.6 AND id % 7 <> 0""")
def p08(v):
    return lc.error_prone(v.parts, v.guard_edges).select("id")


@check("p09_cold", """--- SELECT id FROM v_skills WHERE status NOT IN ('candidate', 'retired') AND id NOT IN (SELECT skill FROM v_inv)""")
def p09(v):
    use = v.inv.groupBy(F.col("skill").alias("id")).agg(F.count("*").alias("n_visit"))
    s = v.skills.join(use, "id", "left").withColumn("n_visit", F.coalesce("n_visit", F.lit(0)))
    return lc.cold(s, NOW).select("id")


@check("p10_low_value", f"""--- SELECT id FROM v_parts WHERE status NOT IN ('candidate', 'retired')
    AND n_visit >= 6 AND {_R} < 0.5 AND {_UTIL} < 20""")
def p10(v):
    return lc.low_value(v.parts, NOW, 20.0).select("id")


_GATE = """g AS (SELECT id, {r} AS bs, (success_count + 1) / (n_visit + 2) AS "as", CAST(token_cost AS DOUBLE) AS bt,
    CAST(coverage AS DOUBLE) AS att, failure_count / 40.0 AS bn, coverage / 80.0 AS an FROM v_parts)"""


def _changes(v):
    return v.parts.select(
        "id", F.when(F.col("n_visit") > 0, F.col("success_count") / F.col("n_visit")).otherwise(0.0)
        .alias("before_success"),
        ((F.col("success_count") + 1) / (F.col("n_visit") + 2)).alias("after_success"),
        F.col("token_cost").cast("double").alias("before_tokens"),
        F.col("coverage").cast("double").alias("after_tokens"),
        (F.col("failure_count") / 40.0).alias("before_transfer"),
        (F.col("coverage") / 80.0).alias("after_transfer"))


_G = _GATE.format(r=_R)


@check("p11_verify_gate", _G + """--- SELECT id, "as" >= bs - 0.01 AND (att < bt OR an < bn) AS accept,
    CASE WHEN NOT ("as" >= bs - 0.01) THEN 'reject: success regressed'
         WHEN att < bt AND an < bn THEN 'accept: tokens↓+neg-transfer↓' WHEN att < bt THEN 'accept: tokens↓'
         WHEN an < bn THEN 'accept: neg-transfer↓' ELSE 'reject: no cost/transfer gain' END AS reason FROM g""")
def p11(v):
    return lc.verify_gate(_changes(v)).select("id", "accept", "reason")


@check("p11_verify_gate_non_worse", _G + """--- SELECT id, "as" >= bs AND att <= bt AND an <= bn AS accept FROM g""")
def p11_non_worse(v):
    return lc.verify_gate(_changes(v), mode="non_worse").select("id", "accept")


@check("p12_update_fields", """c AS (SELECT s_suppkey * 20 AS id, s_name AS name, CASE WHEN s_nationkey % 2 = 0
    THEN 'from ' || s_nationkey END AS body FROM supplier)
    --- SELECT p.id, coalesce(c.name, p.name) AS name, coalesce(c.body, p.body) AS body,
    c.body IS NOT NULL AS reembed FROM v_parts p LEFT JOIN c ON c.id = p.id""")
def p12(v):
    c = v.table("supplier").select(
        (F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("from "), "s_nationkey")).alias("body"))
    return lc.update_fields(v.parts, c)[0].select("id", "name", "body", "reembed")


@check("p12_update_missing", """--- SELECT s_suppkey * 25 AS id FROM supplier
    WHERE s_suppkey * 25 NOT IN (SELECT p_partkey FROM part)""")
def p12_missing(v):
    c = v.table("supplier").select((F.col("s_suppkey") * 25).alias("id"),
                                   F.col("s_name").alias("name"))
    return lc.update_fields(v.parts, c)[1]


@check("p12_update_stored", """c AS (SELECT s_suppkey * 20 AS id, s_name AS name, CASE WHEN s_nationkey % 2 = 0
    THEN 'from ' || s_nationkey END AS body FROM supplier)
    --- SELECT p.id, coalesce(c.name, p.name) AS name, coalesce(c.body, p.body) AS body, p.status
    FROM v_parts p LEFT JOIN c ON c.id = p.id""")
def p12_stored(v):
    c = v.table("supplier").select(
        (F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("from "), "s_nationkey")).alias("body"))
    path = scratch_path(v.spark, "parts")
    sinks.store_buckets(v.parts.select("id", "name", "body", "status"), path, ["id"], 64)
    sinks.rewrite_buckets(c, path, lambda old, new: lc.update_fields(old, new)[0])
    return readers.read_buckets(v.spark, path)


@check("p18_retire_ids", """--- SELECT id, CASE WHEN id IN (SELECT s_suppkey * 20 FROM supplier) THEN 'retired'
    ELSE status END AS status FROM v_parts""")
def p18(v):
    ids = v.table("supplier").select((F.col("s_suppkey") * 20).alias("id"))
    return lc.retire_ids(v.parts, ids)[0].select("id", "status")


_CAP = f"""u AS (SELECT id, round({_UTIL}, 6) AS utility FROM v_parts WHERE status = 'deployed'),
    r AS (SELECT *, row_number() OVER (ORDER BY utility, id) AS rn, count(*) OVER () AS n FROM u)"""


@check("w07_deploy_cap", _CAP + "--- SELECT id, utility FROM r WHERE rn <= n - 500")
def w07(v):
    return lc.deploy_cap(v.parts, 500, NOW)


@check("w14_logical_clock", """--- SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS step FROM orders""")
def w14(v):
    return lc.logical_clock(v.table("orders").select("o_orderkey"), "o_orderkey")


@check("g15_promote", f"""u AS (SELECT id, CASE WHEN status = 'validated' AND ({_HEAT} >= 40 OR n_visit = 0)
    THEN 'deployed' ELSE status END AS status, round({_UTIL}, 6) AS utility FROM v_parts),
    r AS (SELECT id, row_number() OVER (ORDER BY utility, id) AS rn, count(*) OVER () AS n FROM u
      WHERE status = 'deployed')
    --- SELECT u.id, CASE WHEN r.rn <= r.n - 1000 THEN 'validated' ELSE u.status END AS status
    FROM u LEFT JOIN r ON r.id = u.id""")
def g15(v):
    return lc.promote(v.parts, NOW, deploy_heat=40.0, cap=1000).select("id", "status")


_STEP = f"""p AS (SELECT *, {_R} AS rate, {_UTIL} AS util, status = 'validated' AND ({_HEAT} >= 40 OR n_visit = 0)
    AS up FROM v_parts), s AS (SELECT *, CASE WHEN up THEN 'deployed' ELSE status END AS st FROM p),
    m AS (SELECT id, 'promoted' AS move FROM s WHERE up
      UNION ALL SELECT id, 'blocked' FROM s WHERE st <> 'retired' AND n_visit >= 10 AND rate < 0.6
        AND id NOT IN (SELECT id FROM v_blocked)
      UNION ALL SELECT id, 'retired' FROM s WHERE st NOT IN ('candidate', 'retired') AND n_visit >= 6
        AND rate < 0.5 AND util < 20
      UNION ALL SELECT id, 'pruned' FROM s WHERE st NOT IN ('candidate', 'retired') AND n_visit = 0)"""


def _step(v):
    return lifecycle_step(v.parts, v.block_edges, NOW, deploy_heat=40.0, retire_floor=20.0,
                          max_rate=0.6)


@check("g16_lifecycle_step", _STEP + "--- SELECT id, move FROM m")
def g16(v):
    return _step(v)["moves"]


@check("g16_lifecycle_status", _STEP + """--- SELECT id, CASE WHEN id IN (SELECT id FROM m WHERE move IN
    ('retired', 'pruned')) THEN 'retired' ELSE st END AS status FROM s""")
def g16_status(v):
    return _step(v)["skills"].select("id", "status")


@check("g16_lifecycle_rules", _STEP + f"""--- SELECT CASE move WHEN 'blocked' THEN 'block_' ELSE 'retire_' END || id
    || '_{NOW}' AS id, id AS target, CASE move WHEN 'blocked' THEN 'BLOCKS_ROUTING ' || id || ' (success_rate<0.6)'
    ELSE 'RETIRE ' || id || ' (utility below floor)' END AS statement FROM m WHERE move IN ('blocked', 'retired')""")
def g16_rules(v):
    return _step(v)["rules"].select("id", "target", "statement")


@check("g17_validate_round", """--- SELECT id, CASE WHEN id % 9 = 4 AND status = 'candidate' THEN 'deployed'
    ELSE status END AS status FROM v_parts""")
def g17(v):
    ins = v.parts.filter("id % 9 = 4")
    sc = v.parts.agg(F.max("success_count").cast("double").alias("val"),
                     F.min("success_count").cast("double").alias("baseline"))
    return validate_round(v.parts, ins, sc, 3)[0].select("id", "status")


@check("g17_validate_round_reject", """--- SELECT id, CASE WHEN id % 9 = 4 THEN 'retired' ELSE status END
    AS status FROM v_parts""")
def g17_reject(v):
    ins = v.parts.filter("id % 9 = 4")
    sc = v.parts.agg(F.min("success_count").cast("double").alias("val"),
                     F.min("success_count").cast("double").alias("baseline"))
    return validate_round(v.parts, ins, sc, 3)[0].select("id", "status")


@check("g18_mint_checkpoints", f"""--- SELECT 'checkpoint_' || id || '_{NOW}' AS id, id AS target,
    'verify-loop guards ''' || id || ''' (succ ' || printf('%.2f', round({_R}, 2)) || ' over ' || n_visit
    || ' trials)' AS statement, 'Previous attempt at ''' || name || ''' failed its check. Re-read the '
    || 'requirement and fix the specific failure.' AS repair_hint, 2 AS max_retries
    FROM v_parts WHERE status = 'deployed' AND n_visit >= 3 AND {_R} <= 0.6 AND id % 7 <> 0""")
def g18(v):
    return lc.mint_checkpoints(v.parts, v.guard_edges, NOW).select(
        "id", "target", "statement", "repair_hint", "max_retries")


@check("g25_validate_candidates", """--- SELECT id, CASE WHEN status = 'candidate' AND coverage < token_cost
    THEN 'validated' ELSE status END AS status FROM v_parts""")
def g25(v):
    d = v.parts.select("id", (F.col("coverage") < F.col("token_cost")).alias("accept"))
    return lc.validate_candidates(v.parts, d).select("id", "status")
