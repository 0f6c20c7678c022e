"""Routing over parts (dependency graph, customers as tasks) and over documents (text seeds)."""

from pyspark.sql import functions as F

from ropewalk.operators import routing as r
from ropewalk.plans import route as plan

from .registry import check
from .retrieval import pool, stored_index


@check("p02_active_deployed", """--- SELECT id, status = 'deployed' AS deployed FROM v_skills
    WHERE status <> 'retired'""")
def p02(v):
    live = r.deployed(v.skills).select("id", F.lit(True).alias("deployed"))
    return r.active(v.skills).select("id").join(live, "id", "left").select(
        "id", F.coalesce("deployed", F.lit(False)).alias("deployed"))


@check("p03_exec_edges", "--- SELECT src, dst, type FROM v_edges WHERE type <> 'conflicts_with'")
def p03(v):
    return r.exec_edges(v.edges)


@check("p04_layer_of", """e AS (SELECT type FROM v_edges UNION ALL SELECT 'blocks_routing' FROM v_blocked
    UNION ALL SELECT 'co_occurrence' FROM v_cooc)
    --- SELECT type, CASE type WHEN 'blocks_routing' THEN 'governance' WHEN 'co_occurrence' THEN 'trace'
    ELSE 'capability' END AS layer, count(*) AS n FROM e GROUP BY 1, 2""")
def p04(v):
    from ropewalk.operators.mining import cooccurrence
    e = (v.edges.select("type").union(v.block_edges.select("type"))
         .union(cooccurrence(v.trace_atoms).select(F.lit("co_occurrence").alias("type"))))
    return e.groupBy("type", r.layer_of("type").alias("layer")).agg(F.count("*").alias("n"))


@check("g06_dependency_closure", "--- SELECT task_id, id FROM v_closure")
def g06(v):
    return r.dependency_closure(v.stored_seeds, v.dep, v.stored_parts)


@check("g06_dependency_closure_cyclic", """c AS (SELECT task_id, id FROM v_seeds UNION
    SELECT c.task_id, d.dst FROM c JOIN v_dep_cyc d ON c.id = d.src) --- SELECT task_id, id FROM c""")
def g06_cyc(v):
    return r.dependency_closure(v.stored_seeds, v.dep_cyc, v.stored_parts)


@check("g07_k_hop", """u AS (SELECT src, dst FROM v_edges WHERE type <> 'conflicts_with' UNION
    SELECT dst, src FROM v_edges WHERE type <> 'conflicts_with'),
    h AS (SELECT task_id, id, 0 AS d FROM v_seeds UNION SELECT h.task_id, u.dst, h.d + 1 FROM h
    JOIN u ON h.id = u.src WHERE h.d < 2) --- SELECT DISTINCT task_id, id FROM h""")
def g07(v):
    return r.k_hop(v.stored_seeds, v.edges, 2)


@check("j05_drop_blocked", "--- SELECT task_id, id FROM v_open")
def j05(v):
    return r.drop_blocked(r.dependency_closure(v.stored_seeds, v.dep, v.stored_parts), v.block_edges).select(
        "task_id", "id")


@check("j13_resolve_conflicts", """--- SELECT o.task_id, o.id FROM v_open o LEFT JOIN v_fights f
    ON f.task_id = o.task_id AND f.id = o.id WHERE f.id IS NULL""")
def j13(v):
    open_ = r.drop_blocked(r.dependency_closure(v.stored_seeds, v.dep, v.stored_parts), v.block_edges)
    return r.resolve_conflicts(open_, v.stored_seeds, v.conflict, v.stored_parts).select("task_id", "id")


@check("p13_route_status_filter", """--- SELECT s.task_id, s.id FROM v_seeds s JOIN v_parts p ON p.id = s.id
    WHERE p.status IN ('deployed', 'validated')""")
def p13(v):
    return r.route_status_filter(v.stored_seeds, v.stored_parts).select("task_id", "id")


def part_routes(v, **kw):
    """Routes of the customers' seeds over the part graph."""
    nodes = plan.expand(v.stored_seeds, v.stored_parts, v.edges, v.block_edges, **kw)
    return plan.Routes(v.part_tasks, r.candidate_pool(v.stored_parts), v.stored_parts, v.edges, v.guard_edges,
                       v.stored_seeds, plan.durable(nodes.select("task_id", "id")))


@check("g08_route", "--- SELECT task_id, id FROM v_route")
def g08(v):
    return part_routes(v).nodes


@check("g08_route_totals", """--- SELECT task_id, count(*) AS n_nodes, CAST(sum(CASE WHEN token_cost <> 0 THEN
    token_cost ELSE greatest(1, length(body) // 4) END) AS BIGINT) AS loaded_tokens
    FROM v_route JOIN v_parts USING (id) GROUP BY 1""")
def g08_totals(v):
    return part_routes(v).totals()


@check("j06_induced_edges", """--- SELECT a.task_id, e.src, e.dst, e.type FROM (SELECT DISTINCT src, dst, type
    FROM v_edges WHERE type <> 'conflicts_with') e JOIN v_route a ON a.id = e.src
    JOIN v_route b ON b.id = e.dst AND b.task_id = a.task_id""")
def j06(v):
    return part_routes(v).induced_edges().distinct()


@check("j07_guards", """--- SELECT task_id, id, 'checkpoint_' || id || '_1' AS rule_id FROM v_route
    WHERE id % 7 = 0""")
def j07(v):
    return part_routes(v).guards()


_POS = """pool AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM v_parts
    WHERE status = 'deployed'), n AS (SELECT count(*) AS n FROM pool),
    used AS (SELECT task_id, pos FROM v_route JOIN pool USING (id) UNION ALL
      SELECT DISTINCT task_id, n FROM v_seeds CROSS JOIN n),
    cut AS (SELECT task_id, pos, lag(pos) OVER (PARTITION BY task_id ORDER BY pos) AS prev FROM used)"""


@check("j08_excluded", _POS + """--- SELECT task_id, coalesce(prev, -1) + 1 AS first_pos, pos - 1 AS last_pos,
    pos - coalesce(prev, -1) - 1 AS n_excluded FROM cut WHERE pos - coalesce(prev, -1) > 1""")
def j08(v):
    return part_routes(v).excluded()


@check("j12_type_match", """--- SELECT task_id, id FROM v_tasks JOIN v_pool ON lang <> '' AND lang <> 'all'
    AND contains(lower(task_type), lang)""")
def j12(v):
    return r.type_matches(v.tasks, pool(v))


_BOOST = """b AS (SELECT s.task_id, s.id, s.ord, round(s.score + CASE WHEN contains(lower(s.task_type), p.lang)
    THEN 1.0 * coalesce(nullif(max(s.score) OVER (PARTITION BY s.task_id), 0), 1.0) ELSE 0 END, 6) AS score
    FROM v_scores s JOIN v_pool p ON p.id = s.id),
    ranked AS (SELECT task_id, id, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, ord)
    AS rank FROM b)"""


@check("j12_type_boost", _BOOST + "--- SELECT * FROM ranked WHERE rank <= 5")
def j12_boost(v):
    p = pool(v)
    return r.lexical_seeds(v.tasks, p, stored_index(v), 5, type_boost=1.0).select(
        "task_id", "id", "score", "rank")


@check("j18_seed_override", """ext AS (SELECT c_custkey AS task_id, p_partkey AS id, 1 AS r FROM customer
    JOIN part ON p_partkey = c_custkey * 7 WHERE c_nationkey % 2 = 0)
    --- SELECT s.task_id, e.id, 1 AS rank, 'external' AS origin FROM (SELECT DISTINCT task_id FROM v_seeds) s
    JOIN ext e USING (task_id) UNION ALL
    SELECT task_id, id, rank, 'lexical' FROM v_seeds WHERE task_id NOT IN (SELECT task_id FROM ext)""")
def j18(v):
    ext = v.table("customer").filter("c_nationkey % 2 = 0").select(
        F.col("c_custkey").alias("task_id"), (F.col("c_custkey") * 7).alias("id"),
        F.lit(1).alias("rank"))
    return r.seed_override(v.part_tasks, ext, v.stored_parts, v.stored_seeds, 3)


_DOC = """d AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0),
    c AS (SELECT task_id, id FROM v_bm25_top3 UNION SELECT c.task_id, d.dst FROM c JOIN d ON d.src = c.id)
    --- SELECT c.task_id, c.id, greatest(1, length(s.body) // 4) AS tokens FROM c
    JOIN v_skills s ON s.id = c.id WHERE c.id % 17 <> 0 AND s.status IN ('deployed', 'validated')"""


def doc_graph(v):
    d = v.table("documents").select(F.col("doc_id").alias("src"))
    dep = d.filter("src > 0").select("src", F.expr("src div 2").alias("dst"),
                                     F.lit("depends_on").alias("type"))
    block = d.filter("src % 17 = 0").select(
        F.concat(F.lit("block_"), "src").alias("src"), F.col("src").alias("dst"),
        F.lit("blocks_routing").alias("type"))
    return dep, block


def doc_routes(v, **kw):
    dep, block = doc_graph(v)
    return plan.route(v.tasks, v.skills, dep, block, index=stored_index(v), **kw)


@check("g08_route_text", _DOC)
def g08_text(v):
    from ropewalk.operators.evaluation import route_costs
    return route_costs(doc_routes(v).nodes, v.skills).select("task_id", "id", "tokens")


@check("g08_route_hop2", """u AS (SELECT src, dst FROM v_edges WHERE type <> 'conflicts_with' UNION
    SELECT dst, src FROM v_edges WHERE type <> 'conflicts_with'),
    h AS (SELECT task_id, id FROM v_seeds UNION SELECT s.task_id, u.dst FROM v_seeds s JOIN u ON s.id = u.src),
    c AS (SELECT task_id, id FROM h UNION SELECT c.task_id, d.dst FROM c JOIN v_dep d ON c.id = d.src),
    o AS (SELECT * FROM c WHERE id NOT IN (SELECT id FROM v_blocked)),
    f AS (SELECT a.task_id, CASE WHEN (sb.id IS NOT NULL AND sa.id IS NULL) OR rb.rate > ra.rate
      THEN c.src ELSE c.dst END AS id FROM v_conflict c JOIN o a ON a.id = c.src
      JOIN o b ON b.id = c.dst AND b.task_id = a.task_id
      LEFT JOIN h sa ON sa.task_id = a.task_id AND sa.id = c.src
      LEFT JOIN h sb ON sb.task_id = a.task_id AND sb.id = c.dst
      JOIN v_rate ra ON ra.id = c.src JOIN v_rate rb ON rb.id = c.dst)
    --- SELECT o.task_id, o.id FROM o JOIN v_parts p ON p.id = o.id LEFT JOIN f
    ON f.task_id = o.task_id AND f.id = o.id WHERE f.id IS NULL AND p.status IN ('deployed', 'validated')""")
def g08_hop2(v):
    return plan.expand(v.stored_seeds, v.stored_parts, v.edges, v.block_edges, hop=2).select("task_id", "id")


@check("g09_role_routes", """rt AS (SELECT task_id || '/' || role AS task_id, role, text FROM v_tasks CROSS JOIN
    (SELECT 'editor' AS role UNION ALL SELECT 'tester')),
    seeds AS (SELECT r.task_id, CASE r.role WHEN 'editor' THEN b.id ELSE b.id // 2 END AS id FROM rt r
      JOIN v_bm25_top3 b ON r.task_id = b.task_id || '/' || r.role),
    d AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0),
    c AS (SELECT task_id, id FROM seeds UNION SELECT c.task_id, d.dst FROM c JOIN d ON d.src = c.id)
    --- SELECT c.task_id, c.id FROM c JOIN v_skills s ON s.id = c.id WHERE c.id % 17 <> 0
    AND s.status IN ('deployed', 'validated')""")
def g09(v):
    from ropewalk.operators.retrieval import bm25_search
    index = stored_index(v)
    top = bm25_search(v.tasks, index, 3)
    per = top.select("task_id", "id", "rank", F.explode(
        F.array(F.lit("editor"), F.lit("tester"))).alias("role"))
    picks = per.select(
        F.concat(F.col("task_id").cast("string"), F.lit("/"), "role").alias("task_id"),
        F.when(F.col("role") == "editor", F.col("id")).otherwise(F.expr("id div 2")).alias("id"),
        "rank")
    dep, block = doc_graph(v)
    return plan.role_routes(v.tasks, ["editor", "tester"], v.skills, dep, block, index=index,
                            external_seeds=picks).nodes.select("task_id", "id")
