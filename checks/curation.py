"""Curation over documents (near copies), embeddings (vectors) and parts (merge groups)."""

from pyspark.sql import functions as F

from ropewalk.operators import curation as c
from ropewalk.session import scratch_path
from ropewalk.sources import readers, sinks

from .registry import check

# exact pair similarities by sparse dot products
_PAIRS = """tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
  cnt AS (SELECT id, CAST(('0x' || right(md5(t), 8)) AS BIGINT) % 256 AS bucket, count(*) AS tf FROM tok
    GROUP BY 1, 2),
  nrm AS (SELECT id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM cnt),
  sims AS (SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS sim FROM nrm x JOIN nrm y USING (bucket)
    WHERE x.id > y.id GROUP BY 1, 2)"""


def doc_vectors(v):
    d = v.table("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), "text")
    return c.embed(d)


@check("j10_similarity_edges", _PAIRS + """, r AS (SELECT a AS src, b AS dst, sim AS weight, row_number() OVER
    (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM sims WHERE sim >= 0.9)
    --- SELECT src, dst, weight, rank FROM r WHERE rank <= 8 AND dst <> src // 2""")
def j10(v):
    d = v.table("documents").select(F.col("doc_id").alias("src"), F.expr("doc_id div 2").alias("dst"))
    return c.similarity_edges(doc_vectors(v), d, 0.9, 8).select("src", "dst", "weight", "rank")


@check("j10_similarity_edges_dense", """s AS (SELECT x.vec_id AS src, y.vec_id AS dst, round(list_sum(list_transform(
    list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS weight
    FROM embeddings x JOIN embeddings y ON x.vec_id > y.vec_id)
    --- SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst)
    AS rank FROM s WHERE weight >= 0.25) WHERE rank <= 8""")
def j10_dense(v):
    return c.similarity_edges(v.vec.drop("block"), None, 0.25, 8, dim=64).select(
        "src", "dst", "weight")


@check("j11_nearest", """s AS (SELECT x.item_id AS id, y.vec_id AS node, 0.0 AS z FROM benchmark x, embeddings y LIMIT 0),
  t AS (SELECT 'q' || item_id AS id, text FROM benchmark UNION ALL SELECT 'd' || doc_id, text FROM documents),
  tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM t),
  cnt AS (SELECT id, CAST(('0x' || right(md5(t), 8)) AS BIGINT) % 256 AS bucket, count(*) AS tf FROM tok GROUP BY 1, 2),
  nrm AS (SELECT id, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM cnt),
  sims AS (SELECT x.id, CAST(y.id[2:] AS BIGINT) AS node, round(sum(x.w * y.w), 6) AS sim FROM nrm x JOIN nrm y
    USING (bucket) WHERE x.id[1] = 'q' AND y.id[1] = 'd' GROUP BY 1, 2),
  best AS (SELECT id, node, sim FROM sims WHERE sim >= 0.6 QUALIFY row_number() OVER (PARTITION BY id
    ORDER BY sim DESC, node) = 1)
  --- SELECT item_id AS query, coalesce(node, -1) AS node, coalesce(sim, 0.0) AS sim FROM benchmark b
    LEFT JOIN best ON best.id = 'q' || b.item_id""")
def j11(v):
    q = c.embed(v.table("benchmark").select(
        F.col("item_id").alias("id"), (-1 - F.col("item_id")).alias("ord"), "text"))
    return c.nearest(q, doc_vectors(v), 0.6).select(
        F.col("id").alias("query"), F.coalesce("node", F.lit(-1)).cast("long").alias("node"),
        F.coalesce("sim", F.lit(0.0)).alias("sim"))


# Greedy in order: a fragment is kept iff no kept earlier one is near. The recursion walks ids one by one.
_GREEDY = _PAIRS + """, near AS (SELECT a, b, sim FROM sims WHERE sim >= 0.9),
  ids AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
  walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL
    SELECT i.n, CASE WHEN EXISTS (SELECT 1 FROM near WHERE near.a = i.id AND list_contains(w.kept, near.b))
      THEN w.kept ELSE list_append(w.kept, i.id) END FROM walk w JOIN ids i ON i.n = w.n + 1),
  stay AS (SELECT unnest(kept) AS id FROM walk WHERE n = (SELECT max(n) FROM ids)),
  pick AS (SELECT a AS id, b AS target, sim FROM near JOIN stay ON stay.id = near.b
    WHERE a NOT IN (SELECT id FROM stay)
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) = 1)"""


@check("g11_fold_assignments", _GREEDY + """--- SELECT d.doc_id AS id, CASE WHEN s.id IS NOT NULL THEN 'insert'
    ELSE 'merge' END AS action, coalesce(p.target, -1) AS target, coalesce(p.sim, 0.0) AS sim
    FROM documents d LEFT JOIN stay s ON s.id = d.doc_id LEFT JOIN pick p ON p.id = d.doc_id""")
def g11_assign(v):
    frags = doc_vectors(v)
    return c.fold_assignments(frags, frags.limit(0), 0.9).select(
        "id", "action", F.coalesce("target", F.lit(-1)).cast("long").alias("target"),
        F.coalesce("sim", F.lit(0.0)).alias("sim"))


def fragments(v):
    """Every document as a fragment on top of the deployed ones as skills."""
    d = v.skills
    base = 1 << 40
    frags = d.filter("status <> 'deployed'").select(
        F.col("id").cast("string").alias("frag"), (F.col("ord") + base).alias("ord"), "name",
        "description", "body", "task_types", F.array(F.concat(F.lit("t"), "id")).alias("evidence"))
    skills = d.filter("status = 'deployed'").select(
        F.concat(F.lit("doc"), F.col("id")).alias("id"), "ord", "name", "description", "body", "status",
        "task_types")
    return frags, skills


_FOLD = """src AS (SELECT id, CASE WHEN status = 'deployed' THEN 0 ELSE 1 END AS late, name,
    lower(name || '. ' || description || ' ' || body) AS text FROM v_skills),
  tok AS (SELECT id, late, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS t FROM src),
  cnt AS (SELECT id, late, CAST(('0x' || right(md5(t), 8)) AS BIGINT) % 256 AS bucket, count(*) AS tf FROM tok
    GROUP BY 1, 2, 3),
  nrm AS (SELECT id, late, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM cnt),
  near AS (SELECT x.id AS a, y.id AS b, y.late AS bl, round(sum(x.w * y.w), 6) AS sim FROM nrm x
    JOIN nrm y USING (bucket) WHERE x.late = 1 AND (y.late, y.id) < (x.late, x.id) GROUP BY 1, 2, 3
    HAVING round(sum(x.w * y.w), 6) >= 0.95),
  fr AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM src WHERE late = 1),
  walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL
    SELECT f.n, CASE WHEN EXISTS (SELECT 1 FROM near WHERE near.a = f.id AND (bl = 0 OR list_contains(w.kept, near.b)))
      THEN w.kept ELSE list_append(w.kept, f.id) END FROM walk w JOIN fr f ON f.n = w.n + 1),
  new AS (SELECT unnest(kept) AS id FROM walk WHERE n = (SELECT max(n) FROM fr)),
  num AS (SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') AS slug, row_number() OVER (PARTITION BY
    regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g') ORDER BY id) AS k FROM new JOIN src USING (id)),
  ids AS (SELECT id, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS nid FROM num UNION ALL
    SELECT id, 'doc' || id FROM src WHERE late = 0),
  pick AS (SELECT a, b, sim FROM near WHERE a NOT IN (SELECT id FROM new) AND (bl = 0 OR b IN (SELECT id FROM new))
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, bl, b) = 1)"""


@check("g11_fold_fragments", _FOLD + """--- SELECT nid AS id, CAST(new.id AS VARCHAR) AS frag, 'insert' AS action FROM new
    JOIN ids USING (id) UNION ALL SELECT nid, CAST(a AS VARCHAR), 'merge' FROM pick JOIN ids ON ids.id = pick.b""")
def g11(v):
    frags, skills = fragments(v)
    out = c.fold_fragments(frags, skills, 3, 0.95)
    return out["inserted"].select("id", "frag", F.lit("insert").alias("action")).unionByName(
        out["merged"].select("id", "frag", F.lit("merge").alias("action")))


def _patches(v):
    """Conversations as patches: a turn is an edit of the section its role and length name."""
    t = v.table("conversations")
    return t.select(
        "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("patch"),
        F.concat(F.lit("c"), "conv_id").alias("task_id"), F.col("role").alias("task_type"),
        F.array(F.struct(
            F.lit("SKILL.md").alias("file"),
            F.concat(F.lit("## "), "role", F.lit(" "), F.expr("length(text) div 200")
                     ).alias("target_section"),
            F.lit("").alias("after_section"), F.col("text").alias("content"))).alias("edits"))


# One edit after another: known slug, else a near record that is there, else a new record.
_ABSORB = """ed AS (SELECT (conv_id * 1000 + turn) * 1048576 AS seq, role || ' ' || (length(text) // 200) AS name,
    role || '_' || (length(text) // 200) AS slug, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS body FROM conversations),
  nd AS (SELECT 0 AS late, id AS key, lower(name || '. ' || description || ' ' || body) AS text FROM v_skills
    WHERE status = 'deployed' UNION ALL SELECT 1, seq, lower(name || '. ' || name || ' ' || body) FROM ed),
  nt AS (SELECT late, key, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS t FROM nd),
  nc AS (SELECT late, key, CAST(('0x' || right(md5(t), 8)) AS BIGINT) % 256 AS bucket, count(*) AS tf FROM nt GROUP BY 1, 2, 3),
  nv AS (SELECT late, key, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY late, key)) AS w FROM nc),
  qt AS (SELECT seq, unnest(regexp_extract_all(lower(name || ' ' || body), '[a-z0-9]+')) AS t FROM ed),
  qc AS (SELECT seq, CAST(('0x' || right(md5(t), 8)) AS BIGINT) % 256 AS bucket, count(*) AS tf FROM qt GROUP BY 1, 2),
  qv AS (SELECT seq, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY seq)) AS w FROM qc),
  near AS (SELECT q.seq, n.late, n.key, round(sum(q.w * n.w), 6) AS sim FROM qv q JOIN nv n USING (bucket)
    WHERE n.late = 0 OR n.key < q.seq GROUP BY 1, 2, 3 HAVING round(sum(q.w * n.w), 6) >= 0.82),
  o AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM ed),
  walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept, []::VARCHAR[] AS slugs UNION ALL
    SELECT o.n, CASE WHEN fold THEN kept ELSE list_append(kept, seq) END, CASE WHEN fold THEN slugs ELSE
      list_append(slugs, slug) END FROM (SELECT o.*, w.kept, w.slugs, list_contains(w.slugs, o.slug) OR EXISTS (SELECT 1
      FROM near WHERE near.seq = o.seq AND (late = 0 OR list_contains(w.kept, near.key))) AS fold
      FROM walk w JOIN o ON o.n = w.n + 1) o),
  born AS (SELECT unnest(kept) AS seq FROM walk WHERE n = (SELECT max(n) FROM o)),
  home AS (SELECT slug, ed.seq AS born FROM born JOIN ed USING (seq)),
  pick AS (SELECT near.seq, CASE WHEN late = 0 THEN 'doc' || key ELSE e.slug END AS target FROM near LEFT JOIN ed e
    ON e.seq = near.key AND near.late = 1 WHERE late = 0 OR key IN (SELECT seq FROM born)
    QUALIFY row_number() OVER (PARTITION BY near.seq ORDER BY sim DESC, late, key) = 1)"""


@check("g12_absorb_patches", _ABSORB + """--- SELECT CASE WHEN h.born <= ed.seq THEN ed.slug ELSE p.target END AS id,
    count(*) AS n_edits, min(ed.seq) AS first FROM ed LEFT JOIN home h ON h.slug = ed.slug
    LEFT JOIN pick p ON p.seq = ed.seq GROUP BY 1""")
def g12(v):
    skills = v.skills.filter("status = 'deployed'").select(
        F.concat(F.lit("doc"), F.col("id")).alias("id"), "ord", "name", "description", "body", "status")
    out = c.absorb_edits(c.patch_edits(_patches(v)), skills)
    return out["assigned"].groupBy("id").agg(F.count("*").alias("n_edits"), F.min("seq").alias("first"))


# every edit's slug is known here, so the routing is exact by name and SQL can say it
_KNOWN = """ed AS (SELECT (conv_id * 1000 + turn) * 1048576 AS seq, {slug} AS id, {kind} AS kind, 'c' || conv_id AS trace,
    trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS body FROM conversations),
  pt AS (SELECT id, body, min(seq) AS seq FROM ed WHERE body <> '' GROUP BY 1, 2 UNION ALL
    SELECT DISTINCT id, 'seed text', -1 FROM ed),
  app AS (SELECT * FROM pt p WHERE NOT EXISTS (SELECT 1 FROM pt q WHERE q.id = p.id AND q.seq < p.seq
    AND contains(q.body, p.body)))"""


def _known(v, patches):
    slugs = c.patch_edits(patches).select("slug").distinct()
    return slugs.select(F.col("slug").alias("id"), F.xxhash64("slug").alias("ord"), F.col("slug").alias("name"),
                        F.lit("").alias("description"), F.lit("seed text").alias("body"), F.lit("deployed").alias("status"))


@check("g12_absorb_known", _KNOWN.format(slug="role || '_' || (length(text) // 200)", kind="role") + """--- SELECT ed.id,
    count(*) AS n_edits, max(coalesce(n, 0)) AS n_bodies, count(DISTINCT trace) AS n_evidence FROM ed LEFT JOIN
    (SELECT id, count(*) AS n FROM app WHERE seq >= 0 GROUP BY 1) a ON a.id = ed.id GROUP BY 1""")
def g12_known(v):
    p = _patches(v)
    out = c.absorb_edits(c.patch_edits(p), _known(v, p))
    n = out["assigned"].groupBy("id").agg(F.count("*").alias("n_edits"))
    b = out["bodies"].groupBy("id").agg(F.count("*").alias("n_bodies"))
    e = out["evidence"].groupBy("id").agg(F.count("*").alias("n_evidence"))
    return n.join(b, "id", "left").join(e, "id").select(
        "id", "n_edits", F.coalesce("n_bodies", F.lit(0)).alias("n_bodies"), "n_evidence")


def _mixed_patches(v):
    """Turns as edits of a section named by length alone: a section mixes roles, and the first words of long turns come again as
    edits of their own, so that later bodies are contained in earlier ones."""
    t = v.table("conversations")
    kind = F.concat("role", (F.col("conv_id") % 3).cast("string"))
    return t.select(
        "conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("patch"),
        F.concat(F.lit("c"), "conv_id").alias("task_id"), kind.alias("task_type"),
        F.array(*[F.struct(
            F.lit("SKILL.md").alias("file"),
            F.concat(F.lit("## part "), F.expr("length(text) div 200").cast("string")).alias("target_section"),
            F.lit("").alias("after_section"), content.alias("content"))
            for content in (F.col("text"), F.expr("substring(text, 5, 40)"))]).alias("edits"))


_MIXED = """ed AS (SELECT (conv_id * 1000 + turn) * 1048576 + k AS seq, 'part_' || (length(text) // 200) AS id,
    role || (conv_id % 3) AS kind, 'c' || conv_id AS trace, trim(CASE k WHEN 0 THEN text ELSE substring(text, 5, 40) END,
    ' ' || chr(10) || chr(9) || chr(13)) AS body FROM conversations CROSS JOIN (SELECT unnest([0, 1]) AS k)),""" + \
    _KNOWN[_KNOWN.index("pt AS"):]


@check("g12_absorb_contained", _MIXED + """--- SELECT id, seq, md5(body) AS body FROM app WHERE seq >= 0""")
def g12_contained(v):
    """The parts that records take in: half of the edits repeat a piece of an earlier one."""
    p = _mixed_patches(v)
    out = c.absorb_edits(c.patch_edits(p), _known(v, p))
    return out["bodies"].select("id", "seq", F.md5("body").alias("body"))


@check("g12_absorb_split", _MIXED + r""", ty AS (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY min(seq)) - 1 AS n
    FROM ed GROUP BY 1, 2),
  whole AS (SELECT id, string_agg(body, chr(10) || chr(10) ORDER BY seq) AS body FROM app GROUP BY 1),
  big AS (SELECT id, body, list_filter(list_transform(string_split(body, chr(10) || chr(10)),
    lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS ps FROM whole
    WHERE length(body) // 4 >= 600 AND (SELECT count(*) FROM ty WHERE ty.id = whole.id) >= 3)
  --- SELECT id AS parent, n AS child_no, id || '_for_' || kind AS id, id || ' for ' || kind AS name,
    md5(coalesce(ps[n + 1], ps[1])) AS body, (SELECT count(DISTINCT trace) FROM ed WHERE ed.id = big.id) AS n_evidence
    FROM big JOIN ty USING (id)""")
def g12_split(v):
    """Records that grew over the limit and mix at least three types, and their children."""
    p = _mixed_patches(v)
    out = c.absorb_patches(c.patch_edits(p), _known(v, p), 1)
    n = out["child_evidence"].groupBy("id").agg(F.count("*").alias("n_evidence"))
    return out["children"].select("parent", "child_no", "id", "name", F.md5("body").alias("body")).join(n, "id").select(
        "parent", "child_no", "id", "name", "body", "n_evidence")


@check("g13_split", """k AS (SELECT p.id, p.name, p.description, t.task_type, row_number() OVER (PARTITION BY p.id
    ORDER BY t.task_type) - 1 AS n FROM v_parts p JOIN v_part_types t USING (id) WHERE length(p.body) >= 25
    AND p.n_types >= 5 AND p.status <> 'retired')
    --- SELECT CAST(id AS VARCHAR) AS parent, '# ' || name || chr(10) || description || chr(10) || chr(10) ||
    '## Sub-skills' || chr(10) || string_agg('- **' || name || ' (' || task_type || ')**: ' || description || ' ['
    || task_type || ']', chr(10) ORDER BY n) AS stub, 'SPLIT ' || id || ' into [' || string_agg('''' || id || '--'
    || lower(replace(task_type, ' ', '_')) || '''', ', ' ORDER BY n) || ']' AS statement
    FROM k GROUP BY id, name, description""")
def g13(v):
    from ropewalk.operators.lifecycle import divergent
    out = c.split(v.parts, c.propose_children(divergent(v.parts, 5, 25), "copies"), 4)
    rules = out["rules"].select(F.col("targets")[0].alias("parent"), "statement")
    return out["parents"].select("parent", "stub").join(rules, "parent")


@check("g13_split_children", """--- SELECT id || '--' || lower(replace(task_type, ' ', '_')) AS id,
    CAST(id AS VARCHAR) AS parent, name || ' (' || task_type || ')' AS name, 'candidate' AS status, body
    FROM v_parts JOIN v_part_types USING (id) WHERE length(body) >= 25 AND n_types >= 5 AND status <> 'retired'""")
def g13_children(v):
    from ropewalk.operators.lifecycle import divergent
    out = c.split(v.parts, c.propose_children(divergent(v.parts, 5, 25), "copies"), 4)
    return out["children"].select("id", "parent", "name", "status", "body")


@check("g14_propose_children", r"""p AS (SELECT id, name, description, list_filter(list_transform(string_split(
    replace(body, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10) ||
    chr(9) || chr(13))), lambda x: x <> '') AS ps FROM v_skills),
    k AS (SELECT *, unnest(['cell', 'sheet', 'data']) AS tt, unnest([1, 2, 3]) AS n FROM p)
    --- SELECT id AS parent, n - 1 AS child_no, name || ' for ' || tt AS name, name || ' specialised for ' || tt
    || ' tasks' AS description, md5(coalesce(ps[n], ps[1], description)) AS body FROM k""")
def g14(v):
    s = v.skills.withColumn("body", F.replace("body", F.lit(". "), F.lit(".\n\n"))).withColumn(
        "task_types", F.array(F.lit("cell"), F.lit("sheet"), F.lit("data")))
    return c.propose_children(s).select("parent", "child_no", "name", "description",
                                        F.md5(F.col("body").cast("binary")).alias("body"))


_MERGE = """m AS (SELECT name AS grp, *, row_number() OVER (PARTITION BY name ORDER BY success_count DESC, id) AS rn
    FROM v_parts), t AS (SELECT name AS grp, count(DISTINCT task_type) AS cov FROM v_parts JOIN v_part_types
    USING (id) GROUP BY 1)"""


def _groups(v):
    return c.merge_groups(v.parts, v.parts.select(F.col("name").alias("group"), "id"))


@check("a18_merge_groups", _MERGE + """--- SELECT m.grp AS "group", max(id) FILTER (rn = 1) AS survivor,
    count(*) AS members, CAST(sum(success_count) AS BIGINT) AS success_count, CAST(sum(failure_count) AS BIGINT)
    AS failure_count, CAST(sum(n_visit) AS BIGINT) AS n_visit, coalesce(max(cov), 0) AS coverage
    FROM m LEFT JOIN t ON t.grp = m.grp GROUP BY 1 HAVING count(*) >= 2""")
def a18(v):
    return _groups(v)["survivors"]


@check("a18_merge_edges", _MERGE + """--- SELECT a.id AS src, b.id AS dst, 'alternative_to' AS type FROM m a
    JOIN m b ON a.grp = b.grp AND b.rn = 1 WHERE a.rn > 1""")
def a18_edges(v):
    return _groups(v)["edges"]


@check("a18_merge_lists", _MERGE + """--- SELECT DISTINCT b.id AS survivor, x.task_type AS value FROM m a JOIN m b
    ON a.grp = b.grp AND b.rn = 1 JOIN v_part_types x ON x.id = a.id""")
def a18_lists(v):
    return c.merge_lists(v.parts, _groups(v)["members"], "task_types")


def _seq_edges(v):
    """Edges as they arrived: splits link a pair twice, and conflicts reuse pairs."""
    d = v.dep.select("src", "dst")
    first = d.select("src", "dst", F.lit("parent_child").alias("type"), F.lit(1.0).alias("weight"),
                     (F.col("src") * 2).alias("seq"))
    later = d.filter("src % 3 = 0").select("src", "dst", F.lit("depends_on").alias("type"),
                                           F.lit(0.5).alias("weight"), (F.col("src") * 2 + 1).alias("seq"))
    return first, later


_E = """one AS (SELECT src, dst, 'parent_child' AS type, 1.0::DOUBLE AS weight, src * 2 AS seq FROM v_dep),
    two AS (SELECT src, dst, 'depends_on' AS type, 0.5::DOUBLE AS weight, src * 2 + 1 AS seq FROM v_dep
    WHERE src % 3 = 0)"""


@check("j16_link", _E + """, u AS (SELECT * FROM one UNION ALL SELECT t.* FROM two t JOIN v_parts a ON a.id = t.src
    JOIN v_parts b ON b.id = t.dst WHERE a.status <> 'retired' AND b.status <> 'retired')
    --- SELECT 'capability' AS layer, src, dst, max_by(type, seq) AS type, max_by(weight, seq) AS weight,
    max(seq) AS seq FROM u GROUP BY 2, 3""")
def j16(v):
    first, later = _seq_edges(v)
    return c.link(first, later, v.parts.filter("status <> 'retired'"))


@check("j16_link_stored", _E + """, u AS (SELECT * FROM one UNION ALL SELECT t.* FROM two t JOIN v_parts a ON a.id = t.src
    JOIN v_parts b ON b.id = t.dst WHERE a.status <> 'retired' AND b.status <> 'retired')
    --- SELECT 'capability' AS layer, src, dst, max_by(type, seq) AS type, max_by(weight, seq) AS weight,
    max(seq) AS seq FROM u GROUP BY 2, 3""")
def j16_stored(v):
    first, later = _seq_edges(v)
    live = v.parts.filter("status <> 'retired'")
    path = scratch_path(v.spark, "edges")
    sinks.store_buckets(c.latest_edges(first), path, ["src", "dst"], 64)
    sinks.rewrite_buckets(later, path, lambda old, new: c.link(old, new, live))
    return readers.read_buckets(v.spark, path)


@check("j16_declared_links", """--- SELECT DISTINCT src AS id, CASE type WHEN 'depends_on' THEN 'dependencies'
    ELSE 'conflicts' END AS field, dst AS value FROM v_edges WHERE type IN ('depends_on', 'conflicts_with')""")
def j16_lists(v):
    return c.declared_links(v.edges)


@check("j19_unlink", """--- SELECT 'capability' AS layer, src, dst, type FROM v_edges e WHERE NOT EXISTS (SELECT 1
    FROM part WHERE p_partkey % 2 = 0 AND p_partkey = e.src AND p_partkey // 2 = e.dst)""")
def j19(v):
    pairs = v.table("part").filter("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"),
        F.lit("composes_with").alias("type"))
    return c.unlink(v.edges, pairs).select("layer", "src", "dst", "type")


@check("j17_insert", """n AS (SELECT source AS id, min(doc_id) AS ord FROM documents GROUP BY 1)
    --- SELECT id, ord, 'document' AS kind FROM n UNION ALL SELECT DISTINCT 'part ' || p_name, 0, 'part' FROM part""")
def j17(v):
    have = v.table("part").select(F.concat(F.lit("part "), "p_name").alias("id"),
                                  F.lit(0).cast("long").alias("ord"), F.lit("part").alias("kind")).distinct()
    new = v.table("documents").select(F.col("source").alias("id"), F.col("doc_id").alias("ord"),
                                      F.lit("document").alias("kind"))
    again = have.withColumn("kind", F.lit("refused"))
    return c.insert(have, new.unionByName(again))[0]


@check("j17_insert_stored", """n AS (SELECT source AS id, min(doc_id) AS ord FROM documents GROUP BY 1)
    --- SELECT id, ord, 'document' AS kind FROM n UNION ALL SELECT DISTINCT 'part ' || p_name, 0, 'part' FROM part""")
def j17_stored(v):
    have = v.table("part").select(F.concat(F.lit("part "), "p_name").alias("id"),
                                  F.lit(0).cast("long").alias("ord"), F.lit("part").alias("kind")).distinct()
    new = v.table("documents").select(F.col("source").alias("id"), F.col("doc_id").alias("ord"),
                                      F.lit("document").alias("kind"))
    path = scratch_path(v.spark, "inserted")
    sinks.store_buckets(have, path, ["id"], 64)
    sinks.rewrite_buckets(new, path, lambda old, rows: c.insert(old, rows)[0])
    return readers.read_buckets(v.spark, path)


@check("j17_insert_refused", """--- SELECT source AS id, doc_id AS ord FROM documents QUALIFY row_number() OVER
    (PARTITION BY source ORDER BY doc_id) > 1""")
def j17_refused(v):
    have = v.table("part").select(F.concat(F.lit("part "), "p_name").alias("id"),
                                  F.lit(0).cast("long").alias("ord")).distinct()
    new = v.table("documents").select(F.col("source").alias("id"), F.col("doc_id").alias("ord"))
    return c.insert(have, new)[1]


@check("g26_monolith_rollup", """r AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY id) - 1 AS n
    FROM v_skills) --- SELECT description, n // 256 AS part, md5(string_agg(body, chr(10) || chr(10) ORDER BY id))
    AS body, count(*) AS n_skills, CAST(sum(greatest(1, length(body) // 4)) AS BIGINT) AS tokens FROM r GROUP BY 1, 2""")
def g26(v):
    return c.monolith_rollup(v.skills, "description").withColumn(
        "body", F.md5(F.col("body").cast("binary")))


@check("u01_union_lists", """--- SELECT p.id, array_to_string(list_sort(list_distinct(coalesce(t.l, []) || [p.description,
    p.name])), ',') AS merged FROM v_parts p LEFT JOIN (SELECT id, list(task_type) AS l FROM v_part_types GROUP BY 1) t
    ON t.id = p.id""")
def u01(v):
    return v.parts.select("id", F.array_join(F.array_sort(c.union_lists(
        "task_types", F.array("description", "name"))), ",").alias("merged"))


@check("u02_minus_per_task", "--- SELECT task_id, id FROM v_seeds WHERE id NOT IN (SELECT id FROM v_blocked)")
def u02(v):
    b = v.block_edges.select(F.col("dst").alias("id"))
    return c.minus_per_task(v.seeds.select("task_id", "id"), v.seeds.join(b, "id", "left_semi"))


@check("u03_both_per_task", """--- SELECT s.task_id, s.id FROM v_seeds s WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders
    ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_custkey = s.task_id AND l_partkey = s.id)""")
def u03(v):
    f = v.table("lineitem").join(v.table("orders").filter("o_orderstatus = 'F'"),
                                 F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("task_id"), F.col("l_partkey").alias("id"))
    return c.both_per_task(v.seeds.select("task_id", "id"), f)


@check("u04_id_differences", """--- SELECT p_partkey AS id, 'not_found' AS side FROM part WHERE p_partkey NOT IN
    (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'not_requested' FROM documents
    WHERE doc_id NOT IN (SELECT p_partkey FROM part)""")
def u04(v):
    return c.id_differences(v.table("part").select(F.col("p_partkey").alias("id")),
                            v.table("documents").select(F.col("doc_id").alias("id")))


def _round(v, **kw):
    from ropewalk.plans.curate import curate_round
    frags, skills = fragments(v)
    zero = {c: F.lit(0).cast("long") for c in
            ("success_count", "failure_count", "n_visit", "coverage", "token_cost")}
    skills = skills.select("*", *[x.alias(n) for n, x in zero.items()],
                           F.lit(-1).cast("long").alias("last_used_step"))
    edges = skills.select(F.col("id").alias("src"), F.col("id").alias("dst"),
                          F.lit("depends_on").alias("type")).limit(0)
    score = v.table("labels").agg(F.avg("quality").alias("val"), F.avg("toxic").alias("baseline"))
    return curate_round(skills, edges, skills.select("id").limit(0), frags, score, 5, 4, **kw)


@check("g19_curate_round", _FOLD.replace("0.95", "0.8") + """--- SELECT 4::BIGINT AS round, (SELECT count(*) FROM new) AS inserted,
    (SELECT count(*) FROM pick) AS merged, (SELECT avg(quality) > avg(toxic) FROM labels) AS accepted,
    round((SELECT greatest(avg(quality), avg(toxic)) FROM labels), 4) AS val, (SELECT count(*) FROM src WHERE late = 0)
    + (SELECT count(*) FROM new) AS deployed, 0::BIGINT AS retired_total, 0::BIGINT AS checkpoints""")
def g19(v):
    return _round(v)["history"].drop("split")


@check("g19_curate_round_no_merge", """--- SELECT 4::BIGINT AS round, count(*) FILTER (status <> 'deployed') AS inserted,
    0::BIGINT AS merged, 0::BIGINT AS split, true AS accepted, round((SELECT avg(quality) FROM labels), 4) AS val,
    count(*) AS deployed, 0::BIGINT AS retired_total, 0::BIGINT AS checkpoints FROM v_skills""")
def g19_no_merge(v):
    return _round(v, do_merge=False, do_gate=False)["history"]


_OFF = """f AS (SELECT skill, min(pos) AS p, count(*) AS n FROM v_nav WHERE action = 'go_off_graph' GROUP BY 1),
  tok AS (SELECT skill, unnest(regexp_extract_all('note ' || skill || '. off graph howto k' || skill || ' k' || skill
    || ' k' || skill || ' k' || skill, '[a-z0-9]+')) AS t FROM f),
  cnt AS (SELECT skill, CAST(('0x' || right(md5(t), 8)) AS BIGINT) % 256 AS bucket, count(*) AS tf FROM tok GROUP BY 1, 2),
  nrm AS (SELECT skill, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY skill)) AS w FROM cnt),
  near AS (SELECT x.skill AS a, y.skill AS b FROM nrm x JOIN nrm y USING (bucket) JOIN f fa ON fa.skill = x.skill
    JOIN f fb ON fb.skill = y.skill WHERE fb.p < fa.p GROUP BY 1, 2 HAVING round(sum(x.w * y.w), 6) >= 0.8),
  o AS (SELECT skill, row_number() OVER (ORDER BY p) AS n FROM f),
  walk AS (SELECT 0::BIGINT AS n, []::INTEGER[] AS kept UNION ALL SELECT o.n, CASE WHEN EXISTS (SELECT 1 FROM near
    WHERE near.a = o.skill AND list_contains(w.kept, near.b)) THEN w.kept ELSE list_append(w.kept, o.skill) END
    FROM walk w JOIN o ON o.n = w.n + 1)"""


@check("g22_navlog_curation", _OFF + """--- SELECT (SELECT count(DISTINCT cursor) FROM v_nav WHERE action IN ('locate', 'step_to') AND
    skill % 10 <> 9) AS attributed_nodes, (SELECT CAST(sum(n) AS BIGINT) FROM f) AS offgraph_fragments,
    max(len(kept)) AS inserted FROM walk""")
def g22(v):
    from ropewalk.plans.curate import navlog_curation
    k = F.concat(F.lit("k"), F.substring("note", 6, 10))
    frags = v.nav.filter("action = 'go_off_graph'").select(
        "instance", "note", (F.col("pos") + (1 << 40)).alias("ord"), F.col("note").alias("name"),
        F.lit("off graph").alias("description"),
        F.concat_ws(" ", F.lit("howto"), k, k, k, k).alias("body"),
        F.array(F.lit("cell")).alias("task_types"))
    skills = v.nav_skills.select(
        "id", F.expr("cast(substring(id, 2) as bigint)").alias("ord"), F.col("id").alias("name"),
        F.lit("").alias("description"), F.lit("x").alias("body"), F.lit("deployed").alias("status"))
    return navlog_curation(v.nav, v.nav_outcomes, frags, skills, 2)["summary"]
