"""Column functions F01-F22 over whole columns of the given tables."""

from pyspark.sql import functions as F

from ropewalk import functions as fn

from .registry import check

_SLUG = ("coalesce(nullif(left(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), {n})"
         ", ''), '{d}')")


@check("f01_slugify", f"""--- SELECT page_id, {_SLUG.format(x='url', n=64, d='node')} AS slug,
    {_SLUG.format(x='html', n=64, d='node')} AS html_slug FROM pages""")
def f01(v):
    return v.table("pages").select("page_id", fn.slugify("url").alias("slug"),
                                   fn.slugify("html").alias("html_slug"))


@check("f02_canon_id", f"""--- SELECT doc_id, {_SLUG.format(x='text', n=48, d='step')} AS step_id
    FROM documents""")
def f02(v):
    return v.table("documents").select("doc_id", fn.canon_id("text").alias("step_id"))


@check("f03_tokens", """--- SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM
    (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)
    GROUP BY 1""")
def f03(v):
    t = v.table("documents").select("doc_id", F.explode(fn.tokens("text")).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"),
                                  F.count_distinct("doc_id").alias("n_docs"))


@check("f04_ws_tokens", r"""--- SELECT doc_id, len(t) AS n_tokens, coalesce(t[1], '') AS first_token,
    coalesce(t[-1], '') AS last_token FROM (SELECT doc_id, regexp_extract_all(lower(text),
    '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')
    AS t FROM documents)""")
def f04(v):
    t = v.table("documents").select("doc_id", fn.ws_tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                    F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"),
                    F.coalesce(F.try_element_at("t", F.lit(-1)), F.lit("")).alias("last_token"))


_EMBED = """tok AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t
    FROM benchmark), cnt AS (SELECT id, ({bucket}) AS bucket, count(*) AS tf FROM tok GROUP BY 1, 2)
    --- SELECT id, bucket, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)), 6) AS w FROM cnt"""


@check("f05_hash_embed", _EMBED.format(bucket="CAST(('0x' || right(md5(t), 8)) AS BIGINT) % 256"))
def f05(v):
    b = v.table("benchmark").withColumnRenamed("item_id", "id")
    return fn.hash_embed(b, "id", "text").select("id", F.col("bucket").cast("long"),
                                                 F.round("w", 6).alias("w"))


# 128-bit value mod 100, word by word
_FOLD = "0"
for _i in range(4):
    _FOLD = f"(({_FOLD} * 4294967296 + ('0x' || md5(t)[{8 * _i + 1}:{8 * _i + 8}])::BIGINT) % 100)"


@check("f05_hash_embed_any_dim", _EMBED.format(bucket=_FOLD))
def f05_dim(v):
    b = v.table("benchmark").withColumnRenamed("item_id", "id")
    return fn.hash_embed(b, "id", "text", 100).select("id", F.col("bucket").cast("long"),
                                                      F.round("w", 6).alias("w"))


@check("f06_cosine", """head AS (SELECT label, embedding AS e FROM embeddings QUALIFY
    row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
    --- SELECT v.vec_id, round(list_sum(list_transform(list_zip(v.embedding, h.e),
    lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS sim FROM embeddings v JOIN head h USING (label)""")
def f06(v):
    e = v.table("embeddings")
    head = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    return e.join(head, "label").select(
        "vec_id", F.round(fn.cosine("embedding", "e"), 6).alias("sim"))


_NOW = "(SELECT max(o_orderkey) FROM orders)"
_DECAY = "CASE WHEN last_used_step < 0 THEN 0.0 ELSE exp(-greatest(0, {n} - last_used_step) / 50.0) END"


def _now(v):
    return v.table("orders").agg(F.max("o_orderkey").alias("now"))


@check("f07_time_decay", f"--- SELECT id, round({_DECAY.format(n=_NOW)}, 6) AS decay FROM v_parts")
def f07(v):
    return v.parts.crossJoin(F.broadcast(_now(v))).select(
        "id", F.round(fn.time_decay("last_used_step", "now"), 6).alias("decay"))


_HEAT = f"(n_visit + coverage + {_DECAY.format(n=_NOW)})"


@check("f08_skill_heat", f"--- SELECT id, round({_HEAT}, 6) AS heat FROM v_parts")
def f08(v):
    return v.parts.crossJoin(F.broadcast(_now(v))).select(
        "id", F.round(fn.skill_heat("now"), 6).alias("heat"))


_UTIL = (f"({_HEAT} * CASE WHEN success_count + failure_count > 0 THEN success_count / "
         "(success_count + failure_count) ELSE 0.5 END)")


@check("f09_utility", f"--- SELECT id, round({_UTIL}, 6) AS utility FROM v_parts")
def f09(v):
    return v.parts.crossJoin(F.broadcast(_now(v))).select(
        "id", F.round(fn.utility("now"), 6).alias("utility"))


@check("f10_rates", """--- SELECT p.id, success_count + failure_count AS trials,
    round(r.rate, 6) AS success_rate, CASE WHEN n_visit > 0 THEN
    round(coverage / n_visit, 6) ELSE 0.5 END AS avg_pos FROM v_parts p JOIN v_rate r USING (id)""")
def f10(v):
    return v.parts.select("id", fn.trials().alias("trials"),
                          F.round(fn.success_rate(), 6).alias("success_rate"),
                          F.round(fn.avg_pos("coverage", "n_visit"), 6).alias("avg_pos"))


@check("f11_est_tokens", """--- SELECT doc_id, greatest(1, length(text) // 4) AS tokens,
    CASE WHEN n_chars % 2 = 0 THEN greatest(1, length(text) // 4) ELSE n_chars END AS loaded
    FROM documents""")
def f11(v):
    cost = F.when(F.col("n_chars") % 2 == 0, 0).otherwise(F.col("n_chars"))
    return v.table("documents").select("doc_id", fn.est_tokens("text").alias("tokens"),
                                       fn.loaded_tokens(cost, "text").alias("loaded"))


@check("f12_skill_text", """--- SELECT id, md5(name || '. ' || description || ' ' || body) AS vec_text,
    md5(name || ' ' || description || ' ' || body) AS lex_text FROM v_skills""")
def f12(v):
    return v.skills.select(
        "id", F.md5(fn.vector_text("name", "description", "body").cast("binary")).alias("vec_text"),
        F.md5(fn.bm25_text("name", "description", "body").cast("binary")).alias("lex_text"))


@check("f13_section_name", """raw AS (SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 3 = 0 THEN
    '## ' || role ELSE '' END, ''), nullif(CASE WHEN turn % 3 = 1 THEN ' #' || text ELSE '' END, ''),
    CASE WHEN turn % 2 = 0 THEN role || '.md' ELSE 'general' END) AS s FROM conversations)
    --- SELECT conv_id, turn, md5(coalesce(nullif(trim(regexp_replace(trim(s), '^#+', '')), ''),
    'general')) AS section FROM raw""")
def f13(v):
    t = F.col("turn")
    return v.table("conversations").select("conv_id", "turn", F.md5(fn.section_name(
        F.when(t % 3 == 0, F.concat(F.lit("## "), "role")).otherwise(""),
        F.when(t % 3 == 1, F.concat(F.lit(" #"), "text")).otherwise(""),
        F.when(t % 2 == 0, F.concat("role", F.lit(".md")))).cast("binary")).alias("section"))


def _reply(v, body):
    """Model-like replies: prose around a JSON array built from conversation turns."""
    c = v.table("conversations")
    return c.select("conv_id", "turn", "role", "text", F.concat(
        F.lit("Here it is: "), body, F.lit(" done.")).alias("reply"))


@check("f14_parse_fragments", """--- SELECT conv_id, turn, 0 AS pos, left(role || ' lesson', 80) AS name,
    md5(text) AS body, 'cell,' || role AS task_types, 'skill' AS kind FROM conversations
    WHERE length(text) > 0""")
def f14(v):
    lesson = F.struct(F.concat("role", F.lit(" lesson")).alias("name"), F.col("text").alias("body"),
                      F.array(F.lit("cell"), "role").alias("task_types"))
    hollow = F.struct(F.lit("no body").alias("name"), F.lit("").alias("body"),
                      F.array().cast("array<string>").alias("task_types"))
    r = _reply(v, F.to_json(F.array(lesson, hollow)))
    return r.select("conv_id", "turn", F.posexplode(fn.parse_fragments("reply")).alias("pos", "f")
                    ).select("conv_id", "turn", "pos", "f.name",
                             F.md5(F.col("f.body").cast("binary")).alias("body"),
                             F.array_join("f.task_types", ",").alias("task_types"), "f.kind")


@check("f15_parse_id_list", """--- SELECT conv_id, turn, role AS id, 1 AS rank FROM conversations
    UNION ALL SELECT conv_id, turn, 'user', 2 FROM conversations WHERE role <> 'user'""")
def f15(v):
    from ropewalk.operators.routing import seeds_from_replies
    c = v.table("conversations")
    ids = F.to_json(F.array(F.concat(F.lit(" "), "role"), F.lit("nobody"), F.when(
        F.col("role") != "user", "user").otherwise("nobody")))
    text = F.concat(F.lit('first ["assistant", "user"] but better '), ids, F.lit(' not ["nobody"].'))
    pool = c.select(F.col("role").alias("id")).distinct().union(
        v.spark.createDataFrame([("user",)], "id string")).distinct()
    key = F.concat_ws("/", "conv_id", "turn")
    got = seeds_from_replies(c.select(key.alias("task_id"), text.alias("reply")), pool)
    ends = F.split("task_id", "/")
    return got.select(ends[0].cast("long").alias("conv_id"), ends[1].cast("long").alias("turn"),
                      "id", F.when(F.col("rank") > 1, 2).otherwise(1).alias("rank"))


@check("f16_parse_chain", """--- SELECT conv_id, turn, 0 AS pos, role AS id, md5(text) AS descr
    FROM conversations UNION ALL SELECT conv_id, turn, 1, text, md5(text) FROM conversations
    WHERE length(text) > 0""")
def f16(v):
    step = F.struct(F.col("role").alias("id"), F.col("text").alias("desc"))
    bare = F.struct(F.lit("").alias("id"), F.col("text").alias("desc"))
    none = F.struct(F.lit("").alias("id"), F.lit("").alias("desc"))
    r = _reply(v, F.to_json(F.array(step, bare, none)))
    return r.select("conv_id", "turn", F.posexplode(fn.parse_chain("reply")).alias("pos", "s")
                    ).select("conv_id", "turn", "pos", "s.id",
                             F.md5(F.col("s.desc").cast("binary")).alias("descr"))


@check("f17_rule_step", """--- SELECT seq, target AS step, 0.51::DOUBLE AS succ, seq % 50 AS trials
    FROM v_rules""")
def f17(v):
    st = fn.rule_stats("statement")
    return v.rules.select("seq", fn.rule_step("id").alias("step"), st["succ"].alias("succ"),
                          st["trials"].alias("trials"))


@check("f18_is_hard", """--- SELECT doc_id, CAST(quality = 1 AS INTEGER) AS as_int, CAST(toxic = 1 AS INTEGER)
    AS as_text FROM labels""")
def f18(v):
    word = F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, "True").otherwise("1.0")
                  ).otherwise("no")
    return v.table("labels").select("doc_id", fn.is_hard("quality").alias("as_int"),
                                    fn.is_hard(word).alias("as_text"))


@check("f19_trace_cut", "--- SELECT doc_id, md5(left(text, 12000)) AS head, "
       "length(left(text, 400)) AS n FROM documents")
def f19(v):
    return v.table("documents").select(
        "doc_id", F.md5(fn.trace_cut("text").cast("binary")).alias("head"),
        F.length(fn.trace_cut("text", 400)).cast("long").alias("n"))


@check("f20_router_stub", r"""--- SELECT n_nationkey AS parent, '# ' || n_name || chr(10) || r_name
    || chr(10) || chr(10) || '## Sub-skills' || chr(10) || string_agg('- **' || s_name || '**: ' ||
    s_suppkey, chr(10) ORDER BY s_suppkey) AS stub FROM supplier JOIN nation ON s_nationkey =
    n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_nationkey, n_name, r_name""")
def f20(v):
    from ropewalk.operators.curation import router_stub
    kids = (v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return router_stub(kids.select(
        F.col("n_nationkey").alias("parent"), F.col("n_name").alias("parent_name"),
        F.col("r_name").alias("parent_description"), F.col("s_suppkey").alias("child_no"),
        F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("description")))


@check("f21_paragraphs", r"""t AS (SELECT doc_id, list_filter(list_transform(string_split(
    replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p,
    ' ' || chr(10) || chr(9) || chr(13))), lambda p: p <> '') AS p FROM documents)
    --- SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS parts FROM t""")
def f21(v):
    text = F.replace("text", F.lit(". "), F.lit(".\n\n"))
    t = v.table("documents").select("doc_id", fn.paragraphs(text).alias("p"))
    return t.select("doc_id", F.size("p").cast("long").alias("n"),
                    F.md5(F.array_join("p", "|").cast("binary")).alias("parts"))


@check("f22_token_efficiency", """--- SELECT doc_id, round((1 - greatest(1, length(text) // 4) / 2658.0) * 100, 6)
    AS efficiency FROM documents""")
def f22(v):
    return v.table("documents").select("doc_id", F.round(fn.token_efficiency(
        fn.est_tokens("text"), 2658.0), 6).alias("efficiency"))
