"""Readers and writers: files that Spark makes from the given tables, read back by the library."""

from pyspark.sql import functions as F

from ropewalk.session import scratch_path
from ropewalk.sources import readers as rd
from ropewalk.sources import sinks as sk

from .registry import check
from .routing import part_routes

def _graph(v):
    """Parts as graph-document rows: string ids, nested heat, one edge in five dangling."""
    p = v.parts
    none = F.array().cast("array<string>")
    sid = F.col("id").cast("string")
    skills = p.select(
        "ord", sid.alias("id"), "name", F.lit("atomic").alias("granularity"), "description", "body",
        "status", none.alias("parents"), none.alias("dependencies"), none.alias("conflicts"),
        "task_types", none.alias("evidence_traces"),
        F.struct("success_count", "failure_count", "n_visit", "coverage", "token_cost",
                 "last_used_step").alias("heat"))
    from ropewalk.operators.ordered import range_rank
    edges = v.dep.select("src", "dst", "type").distinct()
    edges = range_rank(edges, [F.col("src"), F.col("dst"), F.col("type")], "ord").select(
        F.col("ord").cast("long").alias("ord"), F.col("src").cast("string").alias("src"),
        F.when(F.col("src") % 5 == 1, F.concat(F.lit("gone"), "dst")).otherwise(
            F.col("dst").cast("string")).alias("dst"), "type", F.lit(0.5).alias("weight"))
    rules = p.filter("id % 7 = 0").select(
        "ord", F.concat(F.lit("rule_"), "id").alias("id"),
        F.when(F.col("id") % 2 == 0, "checkpoint").otherwise("block_signal").alias("kind"),
        F.lit("s").alias("statement"), F.array(sid).alias("targets"),
        F.lit("holds").alias("postcondition"), F.lit(2).cast("long").alias("max_retries"),
        F.lit("again").alias("repair_hint"))
    return skills, edges, rules


def _read_back(v, compat=False):
    path = scratch_path(v.spark, "graph")
    sk.write_documents(sk.graph_documents(*_graph(v)), path)
    return rd.read_graph(v.spark, path, compat)


@check("s01_read_graph", """--- SELECT CAST(id AS VARCHAR) AS id, name, status, body, success_count, failure_count,
    n_visit, last_used_step, n_types FROM v_parts""")
def s01(v):
    return _read_back(v)["skills"].select(
        "id", "name", "status", "body", "success_count", "failure_count", "n_visit",
        "last_used_step", F.size("task_types").cast("long").alias("n_types"))


@check("s01_read_graph_edges", """--- SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, type, 0.5::DOUBLE AS weight
    FROM (SELECT DISTINCT src, dst, type FROM v_dep) WHERE src % 5 <> 1""")
def s01_edges(v):
    return _read_back(v)["edges"].select("src", "dst", "type", F.col("weight").cast("double").alias("weight"))


@check("s01_read_graph_targets", """--- SELECT 'rule_' || id AS src, CAST(id AS VARCHAR) AS dst, CASE WHEN id % 2 = 0 THEN
    'guards_skill' ELSE 'applies_to_skill' END AS type FROM v_parts WHERE id % 7 = 0""")
def s01_targets(v):
    return _read_back(v, compat=True)["rule_targets"]


@check("s02_write_graph", """--- SELECT status, count(*) AS n, CAST(sum(n_visit) AS BIGINT) AS visits,
    (SELECT count(*) FROM v_edges) AS n_edges FROM v_parts GROUP BY 1""")
def s02(v):
    path = scratch_path(v.spark, "tables")
    rules = v.rules.select("id", "kind", "statement")
    sk.write_graph(v.parts, v.edges, rules, v.rules.select("id", "target"), path)
    back = rd.read_graph_tables(v.spark, path)
    n = back["edges"].agg(F.count("*").alias("n_edges"))
    return back["skills"].groupBy("status").agg(
        F.count("*").alias("n"), F.sum("n_visit").alias("visits")).crossJoin(F.broadcast(n))


@check("s02_graph_versions", """--- SELECT 1 AS version, (SELECT count(*) FROM v_parts WHERE status <> 'retired') AS skills_total,
    (SELECT count(*) FROM v_parts WHERE status = 'deployed') AS deployed, (SELECT count(*) FROM v_edges) AS capability_edges,
    (SELECT count(*) FROM v_rules) AS governance_nodes, (SELECT max(id) FROM v_parts WHERE status <> 'retired') AS last_id""")
def s02_versions(v):
    """A second version over a first one: statistics and tables are the second's."""
    path = scratch_path(v.spark, "tables")
    rules = v.rules.select("id", "kind", "statement")
    for skills in (v.parts, v.parts.filter("status <> 'retired'")):
        sk.write_graph(skills, v.edges, rules, v.rules.select("id", "target"), path)
    back = rd.read_graph_tables(v.spark, path)
    last = back["skills"].agg(F.max("id").alias("last_id"))
    return back["stats"].select(
        F.col("version").cast("long").alias("version"), "skills_total", F.col("by_status")["deployed"].alias("deployed"),
        "capability_edges", "governance_nodes").crossJoin(F.broadcast(last))  # one row


def _chain_back(v):
    from ropewalk.operators import chains as ch
    nodes = ch.with_type_map(ch.chain_nodes(v.chain), ch.chain_task_types(v.chain)).select(
        "ord", "id", "desc", "n_visit", "n_success", "pos_sum", "pos_n", "task_types",
        F.array(F.lit("q")).alias("examples"))
    path = scratch_path(v.spark, "chain")
    sk.write_documents(sk.chain_documents(nodes, ch.chain_edges(v.chain)), path)
    return rd.read_chain_graph(v.spark, path)


@check("s03_read_chain_graph", """--- SELECT step AS id, count(*) AS n_visit, count(*) FILTER (success) AS n_success,
    round(sum(pos / len), 6) AS pos_sum, count(*) FILTER (task_type = 'click') AS clicks FROM v_chain GROUP BY 1""")
def s03(v):
    return _chain_back(v)["nodes"].select(
        "id", "n_visit", "n_success", F.round("pos_sum", 6).alias("pos_sum"),
        F.coalesce(F.try_element_at("task_types", F.lit("click")), F.lit(0)).alias("clicks"))


@check("s03_read_chain_edges", """--- SELECT src, dst, count(*) AS "count", count(*) FILTER (success) AS succ,
    sum(CASE WHEN success THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight FROM v_trans GROUP BY 1, 2""")
def s03_edges(v):
    return _chain_back(v)["edges"]


def nav_folder(v):
    """One JSONL folder per user, with blank and broken lines between the records."""
    n = v.nav.withColumn("user", F.expr("instance div 100000"))
    rec = F.to_json(F.struct("action", F.when(F.col("action") != "go_off_graph", F.col("cursor"))
                             .alias("cursor"), "task", "note"))
    lines = n.select("user", "pos", F.explode(F.array(
        rec, F.when(F.col("pos") % 4 == 0, "").otherwise("{not json"))).alias("value"))
    path = scratch_path(v.spark, "nav")
    sk.write_documents(lines, path, "user", ("pos",))
    return path


@check("s04_read_nav_log", """--- SELECT CAST(instance // 100000 AS VARCHAR) AS instance, action,
    CASE WHEN action <> 'go_off_graph' THEN cursor ELSE note END AS what, count(*) AS n FROM v_nav GROUP BY 1, 2, 3""")
def s04(v):
    nav = rd.read_nav_log(v.spark, nav_folder(v), rd.folder_key())
    return nav.groupBy("instance", "action", F.coalesce("cursor", "note").alias("what")).agg(
        F.count("*").alias("n"))


@check("s04_nav_tasks", """--- SELECT CAST(instance // 100000 AS VARCHAR) AS instance, min_by(task, pos) AS task FROM v_nav
    WHERE action = 'locate' GROUP BY 1""")
def s04_tasks(v):
    return rd.nav_tasks(rd.read_nav_log(v.spark, nav_folder(v), rd.folder_key()))


@check("s05_read_trajectories", """--- SELECT CAST(conv_id AS VARCHAR) AS run, md5(string_agg('[' || role || '] ' || CASE WHEN turn % 2 = 1
    THEN 'part ' || text ELSE text END, chr(10) ORDER BY turn)) AS trace FROM conversations GROUP BY 1""")
def s05(v):
    part = F.array(F.to_json(F.struct(F.lit("part").alias("text"))),
                   F.to_json(F.struct(F.col("text").alias("text"))))
    listed = F.concat(F.lit("["), F.array_join(part, ","), F.lit("]"))
    role = F.to_json(F.struct("role"))
    plain = F.to_json(F.struct(F.col("text").alias("content")))
    msg = F.concat(F.expr("substring(role_json, 1, length(role_json) - 1)"), F.lit(","),
                   F.when(F.col("turn") % 2 == 1, F.concat(F.lit('"content":'), listed, F.lit("}")))
                   .otherwise(F.expr("substring(plain, 2)")))
    c = v.table("conversations").withColumn("role_json", role).withColumn("plain", plain)
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", msg.alias("m")))).alias("l"))
    docs = docs.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["m"]), ","),
                                           F.lit("]")).alias("value"))
    path = scratch_path(v.spark, "conv")
    sk.write_documents(docs, path, "conv_id")
    return rd.read_trajectories(v.spark, path).select("run", F.md5(F.col("trace").cast("binary")).alias("trace"))


@check("s05_read_step_logs", """--- SELECT CAST(user_id AS VARCHAR) AS run, md5(string_agg('[step ' || step || '] think=' || task_type ||
    ' | action=a' || skill || ' | feedback=ok' || CASE WHEN success THEN '  <<DONE>>' ELSE '' END, chr(10) ORDER BY step))
    AS trace FROM v_inv GROUP BY 1""")
def s05_steps(v):
    rec = F.struct("step", F.concat(F.lit("a"), "skill").alias("action"), F.col("task_type").alias("reasoning"),
                   F.lit(" ok ").alias("env_feedback"), F.col("success").alias("done"))
    docs = v.inv.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(rec))).alias("value"))
    path = scratch_path(v.spark, "steps")
    sk.write_documents(docs, path, "user_id")
    return rd.read_step_logs(v.spark, path).select("run", F.md5(F.col("trace").cast("binary")).alias("trace"))


def _eval_back(v):
    rec = F.struct(F.col("id").cast("string").alias("id"), F.col("a").alias("success"), "instruction_type",
                   (F.col("id") % 4).alias("passed_count"), F.lit(4).alias("total_count"))
    shard = F.floor(F.col("id") / 1000).cast("long")
    docs = v.eval.groupBy(shard.alias("run")).agg(
        F.collect_list(rec).alias("results"),
        F.struct(F.count("*").alias("total_instances"), F.count_if("a").alias("fully_correct_instances"),
                 F.avg(F.col("a").cast("double")).alias("instance_accuracy")).alias("summary"))
    path = scratch_path(v.spark, "eval")
    sk.write_documents(docs.select("run", F.to_json(F.struct("results", "summary")).alias("value")), path, "run")
    return rd.read_eval(v.spark, path, rd.folder_key())


@check("s06_read_eval", """--- SELECT CAST(id // 1000 AS VARCHAR) AS run, CAST(id AS VARCHAR) AS id, a AS success, instruction_type,
    id % 4 AS passed_count FROM v_eval""")
def s06(v):
    return _eval_back(v)["results"].select("run", "id", "success", "instruction_type", "passed_count")


@check("s06_read_eval_summary", """--- SELECT CAST(id // 1000 AS VARCHAR) AS run, count(*) AS total_instances, count(*) FILTER (a) AS
    fully_correct_instances, round(avg(CAST(a AS INTEGER)), 6) AS instance_accuracy FROM v_eval GROUP BY 1""")
def s06_summary(v):
    return _eval_back(v)["summary"].select("run", "total_instances", "fully_correct_instances",
                                           F.round("instance_accuracy", 6).alias("instance_accuracy"))


@check("s07_read_result_lines", """--- SELECT CAST(id AS VARCHAR) AS id, lang AS task_type, CAST(a AS INTEGER) AS hard FROM v_eval""")
def s07(v):
    ok = F.col("a")
    m = F.col("id") % 3
    lit = (F.when(m == 0, F.when(ok, "1").otherwise("0")).when(m == 1, F.when(ok, "true").otherwise("false"))
           .otherwise(F.when(ok, '"1.0"').otherwise('"0"')))
    line = F.concat(F.lit('{"id":"'), F.col("id"), F.lit('","task_type":"'), "lang", F.lit('","hard":'), lit, F.lit("}"))
    path = scratch_path(v.spark, "lines")
    v.eval.select(line.alias("value")).write.text(path)
    return rd.read_result_lines(v.spark, path).select("id", "task_type", "hard")


@check("s08_read_routes", """--- SELECT CAST(task_id AS VARCHAR) AS task_id, CAST(id AS VARCHAR) AS id, rank - 1 AS pos,
    task_id % 2 = 0 AS guarded FROM v_seeds""")
def s08(v):
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("id").cast("string").alias("id")))),
                        lambda x: x["id"])
    dumps = v.seeds.groupBy("task_id").agg(nodes.alias("nodes")).select(F.to_json(F.struct(
        F.col("task_id").cast("string").alias("id"), "nodes", (F.col("task_id") % 2 == 0).alias("guarded"))).alias("value"))
    bad = v.part_tasks.select(F.lit('{"id": "torn", "nodes": [').alias("value"))
    path = scratch_path(v.spark, "routes")
    dumps.unionByName(bad).write.text(path)
    return rd.read_routes(v.spark, path, multi=False).select("task_id", "id", "pos", "guarded")


@check("s09_read_split", """--- SELECT CAST(id AS VARCHAR) AS id, split FROM v_splits""")
def s09(v):
    out = None
    for name in ("train", "val", "test"):
        path = scratch_path(v.spark, name)
        ids = v.splits.filter(F.col("split") == name)
        ids.select(F.explode(F.array(F.concat(F.lit("  "), "id", F.lit(" ")), F.lit(" "))).alias("value")).write.text(path)
        one = rd.read_split(v.spark, path, name)
        out = one if out is None else out.unionByName(one)
    return out


@check("s10_read_skill_docs", r"""--- SELECT CAST(id AS VARCHAR) AS path, CAST(id AS VARCHAR) AS name, name || ' kind' AS description,
    md5(ltrim(body, chr(10)) || chr(10)) AS body FROM v_parts""")
def s10(v):
    s = v.parts.withColumn("description", F.concat("name", F.lit(" kind")))
    docs = sk.render_skill_docs(s.select("id"), s)
    path = scratch_path(v.spark, "docs")
    sk.write_documents(docs.select("id", "value"), path, "id")
    # the text writer ends the document with a line break of its own
    return rd.read_skill_docs(v.spark, path, "*.txt").select(
        "path", "name", "description", F.md5(F.regexp_replace("body", r"\n\n$", "\n").cast("binary")).alias("body"))


@check("s11_read_capability_manifest", """--- SELECT p.id, CASE WHEN p.id % 2 = 0 THEN p.body ELSE s.s_name END AS body, 'deployed' AS status,
    'depends_on' AS type, p.id // 2 AS dep FROM v_parts p LEFT JOIN supplier s ON s.s_suppkey = p.id % 100""")
def s11(v):
    rows = v.parts.select(
        "id", "name", "description", "task_types", F.array(F.expr("id div 2")).alias("deps"),
        (F.col("id") % 100).alias("src"), F.when(F.col("id") % 2 == 0, F.col("body")).otherwise("").alias("body"))
    docs = v.table("supplier").select(F.col("s_suppkey").alias("src"), F.concat(
        F.lit("\n"), "s_name", F.lit(" \n")).alias("value"))
    m = rd.read_capability_manifest(rows, docs)
    return m["skills"].select("id", "body", "status").join(
        m["edges"].select(F.col("src").alias("id"), "type", F.col("dst").alias("dep")), "id")


@check("s12_read_history", """--- SELECT kind AS run, round, count(*) AS inserted, count(*) % 2 = 0 AS accepted,
    round(count(*) / 7.0, 4) AS val FROM v_rules GROUP BY 1, 2""")
def s12(v):
    r = v.rules.groupBy("kind", "round").agg(F.count("*").alias("inserted")).select(
        "kind", F.struct("round", "inserted", (F.col("inserted") % 2 == 0).alias("accepted"),
                         F.round(F.col("inserted") / 7.0, 4).alias("val")).alias("h"))
    docs = r.groupBy("kind").agg(F.to_json(F.array_sort(F.collect_list("h"))).alias("value"))
    path = scratch_path(v.spark, "history")
    sk.write_documents(docs, path, "kind")
    return rd.read_history(v.spark, path, rd.folder_key()).select("run", "round", "inserted", "accepted", "val")


@check("s13_render_skill_docs", """--- SELECT DISTINCT id, id || '/SKILL.md' AS path, repeat('-', 3) || chr(10) || 'name: ' || id || chr(10) || 'description: '
    || description || chr(10) || repeat('-', 3) || chr(10) || chr(10) || body || chr(10) AS value FROM v_route JOIN v_parts USING (id)""")
def s13(v):
    return sk.render_skill_docs(part_routes(v).nodes, v.parts)


@check("s14_render_route_text", """b AS (SELECT task_id, string_agg(body, chr(10) || chr(10) ORDER BY id) AS t FROM v_route JOIN v_parts USING (id)
    GROUP BY 1) --- SELECT s.task_id, coalesce('# AGENTS' || chr(10) || chr(10) || '## Skills routed for this task' || chr(10) || chr(10)
    || t || chr(10), '') AS text FROM (SELECT DISTINCT task_id FROM v_seeds) s LEFT JOIN b ON b.task_id = s.task_id""")
def s14(v):
    r = part_routes(v)
    return sk.render_route_text(r.tasks, r.bodies(), "Skills routed for this task", "AGENTS")


@check("s14_route_text_parts", """b AS (SELECT task_id, string_agg(body, chr(10) || chr(10) ORDER BY id) AS t FROM v_route JOIN v_parts USING (id)
    GROUP BY 1), w AS (SELECT DISTINCT s.task_id, coalesce('# AGENTS' || chr(10) || chr(10) || '## Skills routed for this task' || chr(10)
    || chr(10) || t || chr(10), '') AS t FROM v_seeds s LEFT JOIN b ON b.task_id = s.task_id),
    n AS (SELECT task_id, t, unnest(range(greatest(1, (length(t) + 255) // 256))) AS part FROM w)
    --- SELECT task_id, part, substr(t, CAST(part * 256 + 1 AS BIGINT), 256) AS text FROM n""")
def s14_parts(v):
    r = part_routes(v)
    return sk.render_route_parts(r.tasks, r.bodies(), "Skills routed for this task", "AGENTS", limit=1024)
