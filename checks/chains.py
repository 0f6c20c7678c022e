"""Chain graph: a user's day of events is a chain of steps."""

from pyspark.sql import functions as F

from ropewalk.operators import chains as ch
from ropewalk.session import durable
from ropewalk.sources.sinks import render_chain_procedure

from .registry import check

_NODES = """nodes AS (SELECT step AS id, count(*) AS n_visit, count(*) FILTER (success) AS n_success,
    sum(pos / len) AS pos_sum, min_by(task_type, seq) AS descr, min(seq) AS ord FROM v_chain GROUP BY 1)"""


@check("w04_step_positions", "--- SELECT chain, pos, step, len AS chain_len, round(pos / len, 6) AS rel FROM v_chain")
def w04(v):
    return ch.step_positions(v.chain).select("chain", "pos", "step", "chain_len",
                                             F.round("rel", 6).alias("rel"))


@check("w05_transitions", "--- SELECT chain, pos, src, dst FROM v_trans")
def w05(v):
    return ch.transitions(v.chain)


@check("a19_chain_nodes", _NODES + """--- SELECT id, n_visit, n_success, round(pos_sum, 6) AS pos_sum, descr, ord
    FROM nodes""")
def a19(v):
    return ch.chain_nodes(v.chain).select("id", "n_visit", "n_success",
                                          F.round("pos_sum", 6).alias("pos_sum"),
                                          F.col("desc").alias("descr"), "ord")


@check("a19_chain_task_types", "--- SELECT step AS id, task_type, count(*) AS n FROM v_chain GROUP BY 1, 2")
def a19_types(v):
    nodes = ch.with_type_map(ch.chain_nodes(v.chain), ch.chain_task_types(v.chain))
    return nodes.select("id", F.explode("task_types").alias("task_type", "n"))


@check("a20_chain_edges", """--- SELECT src, dst, count(*) AS "count", count(*) FILTER (success) AS succ,
    sum(CASE WHEN success THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight, min(seq) AS ord FROM v_trans GROUP BY 1, 2""")
def a20(v):
    return ch.chain_edges(v.chain)


@check("w08_hubs", _NODES + "--- SELECT id, n_visit FROM nodes ORDER BY n_visit DESC, ord LIMIT 8")
def w08(v):
    return ch.hubs(ch.chain_nodes(v.chain), 8).select("id", "n_visit")


_EX = """ex AS (SELECT step AS id, left(question, 120) AS example, row_number() OVER (PARTITION BY step ORDER BY seq)
    AS rank FROM v_chain QUALIFY rank <= 3)"""


@check("w09_examples_per_node", _EX + "--- SELECT id, example, rank FROM ex")
def w09(v):
    return ch.examples_per_node(v.chain).select("id", "example", "rank")


_SEEDS = _NODES + "," + _EX + r""",
  task AS (SELECT user_id AS task_id, 'q ' || max_by(skill, step) || ' ' || max_by(task_type, step) AS text
    FROM v_inv GROUP BY 1),
  doc AS (SELECT n.id, n.ord, replace(n.id, '_', ' ') || ' ' || descr || ' ' || string_agg(example, ' ' ORDER BY rank)
    AS text FROM nodes n JOIN ex ON ex.id = n.id GROUP BY n.id, n.ord, descr),
  dt AS (SELECT id, unnest(string_split(lower(text), ' ')) AS token FROM doc),
  post AS (SELECT id, token, count(*) AS tf FROM dt GROUP BY 1, 2),
  lens AS (SELECT id, count(*) AS len FROM dt GROUP BY 1),
  raw AS (SELECT token, ln((SELECT count(*) FROM doc) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post GROUP BY 1),
  idf AS (SELECT token, CASE WHEN r < 0 THEN (SELECT 0.25 * avg(r) FROM raw) ELSE r END AS idf FROM raw),
  qt AS (SELECT task_id, unnest(string_split(lower(text), ' ')) AS token FROM task),
  bm AS (SELECT task_id, p.id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len)
    FROM lens)))), 6) AS s FROM qt JOIN post p USING (token) JOIN idf USING (token) JOIN lens l ON l.id = p.id GROUP BY 1, 2),
  sc AS (SELECT t.task_id, n.id, n.ord, round(coalesce(s, 0) + 0.25 * n_success / n_visit + 0.05 * n_visit, 6) AS score
    FROM task t CROSS JOIN nodes n LEFT JOIN bm ON bm.task_id = t.task_id AND bm.id = n.id)"""


def _seeds(v):
    # the merged graph is a stored table, steps and examples included
    nodes = durable(ch.chain_nodes(v.chain))
    return nodes, ch.chain_seeds(v.chain_tasks, nodes, durable(ch.examples_per_node(v.chain)))


@check("g20_chain_seeds", _SEEDS + """--- SELECT task_id, id, score, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY task_id ORDER BY score DESC, ord) AS rank FROM sc) WHERE rank <= 3""")
def g20(v):
    return _seeds(v)[1].select("task_id", "id", "score", "rank")


def _paths(v):
    nodes, seeds = _seeds(v)
    return nodes, ch.consensus_path(durable(seeds), nodes, durable(ch.chain_edges(v.chain)))


# The walk as a recursion over states: seed number, direction, current step, chosen steps.
_WALK = _SEEDS + """,
  seed AS (SELECT task_id, list(id ORDER BY score DESC, ord) AS seeds FROM (SELECT *, row_number() OVER
    (PARTITION BY task_id ORDER BY score DESC, ord) AS rank FROM sc) WHERE rank <= 3 GROUP BY 1),
  e AS (SELECT src, dst, sum(CASE WHEN success THEN 2.0 ELSE 0.5 END) AS w, min(seq) AS ord FROM v_trans GROUP BY 1, 2
    HAVING count(*) FILTER (success) >= 1),
  adj AS (SELECT src AS at, 1 AS dir, list(dst ORDER BY w DESC, ord) AS nb FROM e GROUP BY 1
    UNION ALL SELECT dst, -1, list(src ORDER BY w DESC, ord) FROM e GROUP BY 1),
  walk AS (SELECT task_id, seeds, seeds AS chosen, 1 AS i, 1 AS dir, seeds[1] AS at, 0 AS n FROM seed UNION ALL
    SELECT task_id, seeds, CASE WHEN nx IS NOT NULL THEN list_append(chosen, nx) ELSE chosen END,
      CASE WHEN nx IS NULL AND dir = -1 THEN i + 1 ELSE i END, CASE WHEN nx IS NULL THEN -dir ELSE dir END,
      CASE WHEN nx IS NOT NULL THEN nx WHEN dir = -1 THEN seeds[i + 1] ELSE seeds[i] END, n + 1
    FROM (SELECT w.*, list_filter(coalesce(a.nb, []), lambda x: NOT list_contains(w.chosen, x))[1] AS nx FROM walk w
      LEFT JOIN adj a ON a.at = w.at AND a.dir = w.dir WHERE len(w.chosen) < 8 AND w.i <= len(w.seeds) AND w.n < 40)),
  done AS (SELECT task_id, unnest(chosen) AS id FROM walk QUALIFY n = max(n) OVER (PARTITION BY task_id))"""


@check("g21_consensus_path", _WALK + """--- SELECT task_id, d.id, round(pos_sum / n_visit, 6) AS avg_pos FROM done d
    JOIN nodes ON nodes.id = d.id""")
def g21(v):
    return _paths(v)[1].select("task_id", "id", "avg_pos")


@check("s15_render_chain_procedure", _WALK + """, p AS (SELECT task_id, d.id, round(pos_sum / n_visit, 6) AS ap, descr, n_visit,
    CAST(round(100 * n_success / n_visit) AS BIGINT) AS sr FROM done d JOIN nodes ON nodes.id = d.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ap, id) AS k FROM p)
    --- SELECT task_id, '## Procedure' || chr(10) || string_agg(k || '. **' || replace(id, '_', ' ') || '** — ' || descr
    || '  _(' || sr || '% succ over ' || n_visit || ' runs)_', chr(10) ORDER BY k) AS text FROM r GROUP BY 1""")
def s15(v):
    nodes, paths = _paths(v)
    return render_chain_procedure(paths, nodes)
