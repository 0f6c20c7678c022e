"""Retrieval over documents (the pool) and benchmark passages (the tasks)."""

from pyspark.sql import functions as F

from ropewalk.functions.text import bm25_text
from ropewalk.operators import retrieval as r
from ropewalk.operators.routing import candidate_pool
from ropewalk.plans.route import pool_index

from .registry import check


@check("p01_candidate_pool", "--- SELECT id, status FROM v_pool")
def p01(v):
    return candidate_pool(v.skills).select("id", "status")


def pool(v):
    return candidate_pool(v.skills)


STORED: dict[tuple[str, str], str] = {}


def stored_index(v, fresh=False):
    """The index over the pool's texts: written once per session and input, read by every search."""
    key = (v.spark.sparkContext.applicationId, v.dir)
    if fresh or key not in STORED:
        STORED[key] = pool_index(pool(v)).path
    return r.Bm25Index.read(v.spark, STORED[key])


@check("g01_bm25_index", """--- SELECT i.token, i.df, round(i.idf, 6) AS idf, CAST(sum(p.tf) AS BIGINT)
    AS cf FROM v_idf i JOIN v_postings p ON p.token = i.token GROUP BY 1, 2, 3""")
def g01(v):
    index = stored_index(v, fresh=True)
    cf = index.postings.groupBy("token").agg(F.sum("tf").alias("cf"))
    return index.terms.join(cf, "token").select("token", "df", F.round("idf", 6).alias("idf"), "cf")


@check("g01_index_append", """--- SELECT i.token, i.df, round(i.idf, 6) AS idf, CAST(sum(p.tf) AS BIGINT)
    AS cf FROM v_idf i JOIN v_postings p ON p.token = i.token GROUP BY 1, 2, 3""")
def g01_append(v):
    """The same numbers when one record in 100 arrives later, as a segment of its own."""
    p = pool(v)
    index = pool_index(p.filter("id % 100 <> 7"))
    late = p.filter("id % 100 = 7").select("id", "ord", bm25_text("name", "description", "body").alias("text"))
    index = index.append(late)
    cf = index.postings.groupBy("token").agg(F.sum("tf").alias("cf"))
    return index.terms.join(cf, "token").select("token", "df", F.round("idf", 6).alias("idf"), "cf")


@check("g02_bm25_search", "--- SELECT task_id, id, score, rank FROM v_bm25_top3")
def g02(v):
    return r.bm25_search(v.tasks, stored_index(v), 3).select("task_id", "id", "score", "rank")


@check("g02_negative_idf", r"""doc AS (SELECT c_custkey AS id, 'the client of ' || lower(c_mktsegment) AS text FROM customer),
    dt AS (SELECT id, unnest(string_split(text, ' ')) AS token FROM doc),
    raw AS (SELECT token, ln((SELECT count(*) FROM doc) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM dt GROUP BY 1),
    idf AS (SELECT token, CASE WHEN r < 0 THEN (SELECT 0.25 * avg(r) FROM raw) ELSE r END AS idf FROM raw),
    task AS (SELECT n_nationkey AS task_id, CASE n_nationkey % 3 WHEN 0 THEN 'the building' WHEN 1 THEN 'of ' || lower(n_name)
      ELSE lower(n_name) || ' machinery' END AS text FROM nation),
    q AS (SELECT task_id, unnest(string_split(text, ' ')) AS token FROM task),
    s AS (SELECT task_id, id, round(sum(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4.0 / 4.0))), 6) AS s FROM q JOIN dt USING (token)
      JOIN idf USING (token) GROUP BY 1, 2),
    al AS (SELECT t.task_id, d.id, coalesce(s, 0.0) AS score FROM task t CROSS JOIN doc d LEFT JOIN s ON s.task_id = t.task_id
      AND s.id = d.id)
    --- SELECT task_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, id)
    AS rank FROM al) WHERE rank <= 4""")
def g02_negative(v):
    """Words that nearly all records share: their weight is below zero, so a match can rank below no match."""
    docs = v.table("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"),
        F.concat(F.lit("the client of "), F.lower("c_mktsegment")).alias("text"))
    name, kind = F.lower("n_name"), F.col("n_nationkey") % 3
    asked = v.table("nation").select(F.col("n_nationkey").alias("task_id"), F.when(kind == 0, "the building").when(
        kind == 1, F.concat(F.lit("of "), name)).otherwise(F.concat(name, F.lit(" machinery"))).alias("text"))
    return r.bm25_search(asked, r.bm25_index(docs), 4).select("task_id", "id", "score", "rank")


@check("w01_topk_per_task", """--- SELECT task_id, id, score, rank FROM (SELECT task_id, id, score,
    row_number() OVER (PARTITION BY task_id ORDER BY score DESC, id) AS rank FROM v_bm25)
    WHERE rank <= 10""")
def w01(v):
    scores = r.bm25_scores(v.tasks, stored_index(v))
    return r.topk_per_task(scores, 10).select("task_id", "id", "score", "rank")


_VEC = """tv AS (SELECT task_id, CAST(('0x' || right(md5(t), 8)) AS BIGINT) % 256 AS bucket,
    count(*) AS tf FROM (SELECT task_id, unnest(regexp_extract_all(lower({q}), '[a-z0-9]+')) AS t
    FROM v_tasks) GROUP BY 1, 2),
  dv AS (SELECT id, CAST(('0x' || right(md5(t), 8)) AS BIGINT) % 256 AS bucket, count(*) AS tf
    FROM (SELECT id, unnest(regexp_extract_all(lower(name || '. ' || description || ' ' || body),
    '[a-z0-9]+')) AS t FROM v_pool) GROUP BY 1, 2),
  tn AS (SELECT task_id, sqrt(sum(tf * tf)) AS n FROM tv GROUP BY 1),
  dn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM dv GROUP BY 1),
  dots AS (SELECT task_id, id, sum(tv.tf / tn.n * dv.tf / dn.n) AS s FROM tv JOIN tn USING (task_id)
    JOIN dv USING (bucket) JOIN dn USING (id) GROUP BY 1, 2),
  allp AS (SELECT t.task_id, p.id, coalesce(round(s, 6), 0) AS score FROM v_tasks t CROSS JOIN v_pool p
    LEFT JOIN dots d ON d.task_id = t.task_id AND d.id = p.id)
  --- SELECT task_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id
    ORDER BY score DESC, id) AS rank FROM allp) WHERE rank <= {k}"""


@check("g03_vector_search", _VEC.format(q="text", k=3))
def g03(v):
    text = F.concat("name", F.lit(". "), "description", F.lit(" "), "body")
    return r.vector_search(v.tasks, pool(v), 3, doc_text=text).select(
        "task_id", "id", "score", "rank")


@check("g03_vector_search_dense", """q AS (SELECT vec_id AS task_id, embedding AS e FROM embeddings),
    s AS (SELECT task_id, vec_id AS id, round(list_sum(list_transform(list_zip(v.embedding, q.e),
    lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score FROM embeddings v CROSS JOIN q
    WHERE vec_id <> task_id)
    --- SELECT task_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id
    ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def g03_dense(v):
    from ropewalk.operators.ordered import first_k
    from ropewalk.operators.similarity import similar
    found = similar(v.vec, v.vec, 64, k=5, same_table=True)
    return first_k(found, ["left_id"], [F.col("sim").desc(), F.col("right_ord")], 5).select(
        F.col("left_id").alias("task_id"), F.col("right_id").alias("id"),
        F.col("sim").alias("score"), "rank")


@check("g04_full_load", """--- SELECT task_id, count(*) AS n_nodes, CAST(sum(greatest(1, length(body) // 4))
    AS BIGINT) AS loaded_tokens, min(id) AS first_id, max(id) AS last_id
    FROM v_tasks CROSS JOIN v_pool GROUP BY 1""")
def g04(v):
    return r.full_load(v.tasks, pool(v))


_FLAT_TOK = r"""tq AS (SELECT task_id, token, count(*) AS qtf FROM (SELECT task_id, unnest(
    regexp_extract_all(lower(text || ' ' || task_type), '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))
    AS token FROM v_tasks) GROUP BY 1, 2),
  sc AS (SELECT q.task_id, p.id, round(sum(q.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 *
    (0.25 + 0.75 * l.len / (SELECT avg(len) FROM v_lens)))), 6) AS score FROM tq q
    JOIN v_postings p ON p.token = q.token JOIN v_idf i ON i.token = q.token
    JOIN v_lens l ON l.id = p.id GROUP BY 1, 2),
  al AS (SELECT t.task_id, p.id, coalesce(s.score, 0.0) AS score, greatest(1, length(body) // 4) AS tokens
    FROM v_tasks t CROSS JOIN v_pool p LEFT JOIN sc s ON s.task_id = t.task_id AND s.id = p.id)"""


@check("g05_flat_route", _FLAT_TOK + """--- SELECT task_id, id, score, rank, tokens FROM (SELECT *,
    row_number() OVER (PARTITION BY task_id ORDER BY score DESC, id) AS rank FROM al) WHERE rank <= 5""")
def g05(v):
    p = pool(v)
    return r.flat_route(v.tasks, p, "bm25", 5, stored_index(v)).select(
        "task_id", "id", "score", "rank", "tokens")


@check("g05_flat_route_embed", _VEC.format(q="text || ' ' || task_type", k=5).replace(
    "--- SELECT task_id, id, score, rank FROM", "--- SELECT task_id, id, score, rank FROM"))
def g05_embed(v):
    p = pool(v).withColumn("text", F.concat("name", F.lit(". "), "description", F.lit(" "), "body"))
    return r.flat_route(v.tasks, p, "embed", 5).select("task_id", "id", "score", "rank")
