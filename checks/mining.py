"""Mining: orders as traces of parts, events as invocations."""

from pyspark.sql import functions as F

from ropewalk.operators import evaluation, mining as m

from .registry import check


@check("a01_heat_counters", """--- SELECT skill, count(*) AS n_visit, count(*) FILTER (success) AS success_count,
    count(*) FILTER (NOT success) AS failure_count, max(step) AS last_used_step FROM v_inv GROUP BY 1""")
def a01(v):
    return m.heat_counters(v.inv)


@check("a02_nav_attribution", """h AS (SELECT DISTINCT instance, cursor AS id, success FROM v_nav WHERE action IN
    ('locate', 'step_to') AND skill % 10 <> 9)
    --- SELECT id, count(*) FILTER (success) AS success_add, count(*) FILTER (NOT success) AS failure_add
    FROM h GROUP BY 1""")
def a02(v):
    return evaluation.nav_attribution(v.nav, v.nav_outcomes, v.nav_skills)


@check("a02_nav_evidence", """h AS (SELECT instance, cursor AS src, success, min(pos) AS pos FROM v_nav WHERE action IN
    ('locate', 'step_to') AND skill % 10 <> 9 GROUP BY 1, 2, 3)
    --- SELECT src, 'trace_' || (5 + row_number() OVER (ORDER BY instance, pos) - 1) AS dst, instance AS task_id,
    CASE WHEN success THEN 'fixed_by' ELSE 'caused_failure' END AS type FROM h""")
def a02_evidence(v):
    """A trace per run and visited record, behind the five there are, and its edge."""
    out = evaluation.nav_evidence(v.nav, v.nav_outcomes, v.nav_skills, 5)
    return out["edges"].join(out["traces"].select(F.col("id").alias("dst"), "task_id"), "dst").select(
        "src", "dst", "task_id", "type")


@check("a02_credited_records", """h AS (SELECT DISTINCT instance, cursor AS id, success FROM v_nav WHERE action IN
    ('locate', 'step_to') AND skill % 10 <> 9),
    n AS (SELECT id, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS bad FROM h GROUP BY 1),
    sk AS (SELECT 'k' || skill AS id, max(step) AS last FROM v_inv GROUP BY 1)
    --- SELECT sk.id, coalesce(ok, 0) AS success_count, coalesce(bad, 0) AS failure_count,
    CASE WHEN n.id IS NULL THEN last ELSE 1000000000 END AS last_used_step FROM sk LEFT JOIN n ON n.id = sk.id""")
def a02_credited(v):
    """Counters and step of last use after attribution at step 10^9; records that no run visited stay as they were."""
    zero = F.lit(0).cast("long")
    skills = v.inv.groupBy(F.concat(F.lit("k"), "skill").alias("id")).agg(F.max("step").cast("long").alias("last_used_step")).select(
        "id", zero.alias("success_count"), zero.alias("failure_count"), "last_used_step")
    credit = evaluation.nav_attribution(v.nav, v.nav_outcomes, v.nav_skills, 1_000_000_000)
    return evaluation.credited(skills, credit)


@check("a03_coverage", """--- SELECT skill, count(DISTINCT task_type) AS coverage FROM v_inv GROUP BY 1""")
def a03(v):
    return m.coverage(v.inv)


@check("a04_cooccurrence", "--- SELECT a, b, weight FROM v_cooc")
def a04(v):
    return m.cooccurrence(v.trace_atoms)


@check("a05_atom_evidence", """--- SELECT l_partkey AS atom, CAST(min(l_orderkey) AS VARCHAR) AS first_order
    FROM lineitem GROUP BY 1""")
def a05(v):
    rows = v.table("lineitem").select(F.col("l_partkey").alias("atom"), F.col("l_orderkey").alias("seq"),
                                      F.col("l_orderkey").cast("string").alias("body"))
    return m.atom_evidence(rows).select("atom", F.col("body").alias("first_order"))


_COOC = """both_ AS (SELECT a AS id, b AS partner, weight FROM v_cooc UNION ALL SELECT b, a, weight FROM v_cooc),
    sup AS (SELECT s.task_id, partner, sum(weight) AS weight FROM v_{src} s JOIN both_ USING (id)
      WHERE NOT EXISTS (SELECT 1 FROM v_{src} x WHERE x.task_id = s.task_id AND x.id = partner)
      GROUP BY 1, 2 HAVING sum(weight) >= {w}),
    top AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY weight DESC, partner) AS rank FROM sup
      QUALIFY rank <= {m})"""


@check("a06_cooccurring", _COOC.format(src="seeds", w=2, m=3) +
       "--- SELECT task_id, partner, weight, rank FROM top")
def a06(v):
    return m.cooccurring(v.seeds, m.cooccurrence(v.trace_atoms)).select(
        "task_id", "partner", "weight", "rank")


@check("a07_consolidation", """sup AS (SELECT id, sum(weight) AS support FROM (SELECT a AS id, weight FROM v_cooc
    UNION ALL SELECT b, weight FROM v_cooc) GROUP BY 1)
    --- SELECT id, support, 'revive' AS action, 'consolidate_' || id || '_7' AS rule_id, 'consolidate ' || id
    || ' from trace evidence (support ' || printf('%.1f', support) || ')' AS statement
    FROM sup JOIN v_parts USING (id) WHERE status <> 'deployed' AND support >= 4
    ORDER BY support DESC, id LIMIT 4""")
def a07(v):
    ev = m.atom_evidence(v.evidence_rows)
    return m.consolidation(m.cooccurrence(v.trace_atoms), ev, v.parts, 7).select(
        "id", "support", "action", "rule_id", "statement")


@check("a25_type_entropy", """n AS (SELECT skill, task_type, count(*) AS n FROM v_inv GROUP BY 1, 2),
    p AS (SELECT skill, n / sum(n) OVER (PARTITION BY skill) AS p FROM n)
    --- SELECT skill, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1""")
def a25(v):
    return m.type_entropy(v.inv).select("skill", F.round("entropy", 6).alias("entropy"))


@check("a26_trace_contains", """--- SELECT atom, count(*) AS n_traces, atom % 10 <= 5 AS has_skill
    FROM v_trace_atoms GROUP BY 1""")
def a26(v):
    return m.trace_contains(v.trace_atoms, v.parts.filter("status = 'deployed'"))


@check("g10_gap_fill", _COOC.format(src="seeds", w=3, m=6) + """,
    ok AS (SELECT t.*, e.body, row_number() OVER (PARTITION BY task_id ORDER BY rank) AS r2 FROM top t
      JOIN v_evidence e ON e.atom = t.partner JOIN v_parts p ON p.id = t.partner WHERE p.status <> 'deployed')
    --- SELECT task_id, partner AS id, weight, r2 AS rank, body, greatest(1, length(body) // 4) AS tokens
    FROM ok WHERE r2 <= 3""")
def g10(v):
    from ropewalk.operators.routing import candidate_pool
    ev = m.atom_evidence(v.evidence_rows)
    return m.gap_fill(v.seeds, m.cooccurrence(v.trace_atoms), ev, candidate_pool(v.parts)).select(
        "task_id", "id", "weight", "rank", "body", "tokens")
