"""Stand-in tables: the given tables seen as skills, tasks, traces, chains and evaluations.

Each view exists twice, as a DataFrame and as SQL, with the same columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ropewalk.operators.ordered import first_k, row_index
from ropewalk.session import durable, sized_tasks


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def skills(self) -> DataFrame:
        d, lab = self.table("documents"), self.table("labels")
        status = (F.when(F.col("quality").isNull(), "candidate").when(F.col("quality") == 0, "retired")
                  .when(F.col("toxic") == 1, "validated").otherwise("deployed"))
        return d.join(lab, "doc_id", "left").select(
            F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("source").alias("name"),
            F.col("lang").alias("description"), F.col("text").alias("body"),
            F.array("lang").alias("task_types"), F.lit(0).cast("long").alias("token_cost"),
            status.alias("status"), F.lit(0).cast("long").alias("success_count"),
            F.lit(0).cast("long").alias("failure_count"))

    @cached_property
    def tasks(self) -> DataFrame:
        return self.table("benchmark").select(
            F.col("item_id").alias("task_id"), "text",
            F.when(F.col("item_id") % 2 == 0, "en").otherwise("fr").alias("task_type"))

    @cached_property
    def part_use(self) -> DataFrame:
        """(id, returned, nation, region, order) per order line."""
        s = (self.table("supplier").join(self.table("nation"),
                                         F.col("s_nationkey") == F.col("n_nationkey"))
             .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("s_suppkey", "s_nationkey", "r_name"))
        return self.table("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.col("l_partkey").alias("id"), (F.col("l_returnflag") == "R").alias("returned"),
            F.col("s_nationkey").alias("nation"), F.col("r_name").alias("region"),
            F.col("l_orderkey").alias("order"))

    @cached_property
    def parts(self) -> DataFrame:
        u = self.part_use.groupBy("id").agg(
            F.count_if(~F.col("returned")).alias("success_count"),
            F.count_if("returned").alias("failure_count"), F.count("*").alias("n_visit"),
            F.max("order").alias("last_used_step"),
            F.array_sort(F.collect_set("region")).alias("task_types"),
            F.size(F.collect_set("nation")).cast("long").alias("coverage"))
        digit = F.col("p_partkey") % 10
        status = (F.when(digit <= 5, "deployed").when(digit <= 7, "validated")
                  .when(digit == 8, "candidate").otherwise("retired"))

        def zero(c, v=0):
            return F.coalesce(c, F.lit(v)).cast("long").alias(c)

        return self.table("part").join(u, F.col("p_partkey") == F.col("id"), "left").select(
            F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"),
            F.col("p_name").alias("name"), F.col("p_type").alias("description"),
            F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("body"),
            F.col("p_size").cast("long").alias("token_cost"), status.alias("status"),
            zero("success_count"), zero("failure_count"), zero("n_visit"), zero("coverage"),
            zero("last_used_step", -1),
            F.coalesce("task_types", F.array().cast("array<string>")).alias("task_types"))

    @cached_property
    def stored_parts(self) -> DataFrame:
        """Parts as a stored skills table, for plans that read it at several stages."""
        return durable(self.parts)

    @cached_property
    def stored_seeds(self) -> DataFrame:
        return durable(self.seeds)

    def _part_edges(self, extra: bool = False) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("src")).filter("src > 0")
        half = p.select("src", F.expr("src div 2").alias("dst"))
        third = p.filter("src % 5 = 0").select("src", F.expr("src div 3").alias("dst"))
        out = half.union(third)
        if extra:
            out = out.union(p.filter("src = 1").select("src", F.lit(3).cast("long").alias("dst")))
        return out.withColumn("type", F.lit("depends_on"))

    @cached_property
    def dep(self) -> DataFrame:
        return self._part_edges()

    @cached_property
    def dep_cyc(self) -> DataFrame:
        return self._part_edges(True)

    @cached_property
    def conflict(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("src")).filter("src % 10 = 0")
        return p.select("src", (F.col("src") + 1).alias("dst"),
                        F.lit("conflicts_with").alias("type"))

    @cached_property
    def compose(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("src"))
        return p.filter("src % 4 = 1").select("src", (F.col("src") + 2).alias("dst"),
                                              F.lit("composes_with").alias("type"))

    @cached_property
    def edges(self) -> DataFrame:
        return self.dep.union(self.conflict).union(self.compose)

    @cached_property
    def block_edges(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("dst")).filter("dst % 17 = 0")
        return p.select(F.concat(F.lit("block_"), "dst").alias("src"), "dst",
                        F.lit("blocks_routing").alias("type"))

    @cached_property
    def guard_edges(self) -> DataFrame:
        p = self.table("part").select(F.col("p_partkey").alias("id")).filter("id % 7 = 0")
        return p.select("id", F.explode(F.array(F.lit(2), F.lit(1))).alias("seq")).select(
            "id", "seq", F.concat(F.lit("checkpoint_"), "id", F.lit("_"), "seq").alias("rule_id"))

    @cached_property
    def part_tasks(self) -> DataFrame:
        return self.stored_seeds.select("task_id").distinct()

    @cached_property
    def seeds(self) -> DataFrame:
        """Each customer is a task; its seeds are the three parts it ordered most of."""
        line = self.table("lineitem").join(self.table("orders"),
                                           F.col("l_orderkey") == F.col("o_orderkey"))
        q = line.groupBy(F.col("o_custkey").alias("task_id"), F.col("l_partkey").alias("id")).agg(
            F.sum("l_quantity").alias("q"))
        return first_k(q, ["task_id"], [F.col("q").desc(), F.col("id").asc()], 3).select(
            "task_id", "id", "rank")

    @cached_property
    def trace_atoms(self) -> DataFrame:
        """Stored, as its queries count it before they cut it into tasks."""
        line = self.table("lineitem")
        with sized_tasks(self.spark, line.count()):
            return durable(line.join(
                self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
                F.col("l_orderkey").alias("trace"), F.col("l_partkey").alias("atom"),
                (F.col("o_orderstatus") == "F").alias("success"))
                # dealt first: before a shuffle a task would hold the different rows of its whole split
                .repartition("trace", "atom").distinct())

    @cached_property
    def evidence_rows(self) -> DataFrame:
        """(atom, body, seq): the text of the order line that shows a part at work."""
        return self.table("lineitem").select(
            F.col("l_partkey").alias("atom"),
            F.concat(F.lit("seen in order "), F.col("l_orderkey")).alias("body"),
            F.col("l_orderkey").alias("seq")).distinct()

    @cached_property
    def inv(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("step"), "ts", "user_id", "value",
            F.get_json_object("props", "$.k").cast("int").alias("skill"),
            F.col("event_type").alias("task_type"),
            (F.col("event_id") % 3 != 0).alias("success"),
            (F.col("event_type") == "purchase").alias("ood"))

    @cached_property
    def chain(self) -> DataFrame:
        day = F.unix_date(F.to_date("ts")).cast("long")
        e = self.inv.select(
            (F.col("user_id") * 100000 + day).alias("chain"), F.col("step").alias("seq"),
            "user_id", F.col("skill").alias("k"), "task_type",
            ((F.col("user_id") + day) % 3 != 0).alias("success"))
        placed = row_index(e, ["chain"], "seq", "pos")
        return placed.select(
            "chain", "pos", F.concat(F.lit("s"), F.expr("k div 5")).alias("step"),
            F.col("task_type").alias("desc"), "success", "task_type",
            F.concat(F.lit("q "), "k", F.lit(" "), "task_type").alias("question"), "seq",
            "user_id", "k")

    @cached_property
    def chain_tasks(self) -> DataFrame:
        """Each user is a task, asking what its last event asks."""
        last = self.inv.groupBy(F.col("user_id").alias("task_id")).agg(
            F.max_by(F.struct("skill", "task_type"), "step").alias("_l"))
        return last.select("task_id", F.concat(F.lit("q "), "_l.skill", F.lit(" "),
                                               "_l.task_type").alias("text"))

    @cached_property
    def nav(self) -> DataFrame:
        day = F.unix_date(F.to_date("ts")).cast("long")
        action = (F.when(F.col("task_type") == "click", "locate")
                  .when(F.col("task_type") == "view", "step_to")
                  .when(F.col("task_type") == "error", "go_off_graph").otherwise("idle"))
        return self.inv.select(
            (F.col("user_id") * 100000 + day).alias("instance"), F.col("step").alias("pos"),
            action.alias("action"), F.concat(F.lit("k"), "skill").alias("cursor"),
            F.concat(F.lit("task of "), "user_id").alias("task"),
            F.concat(F.lit("note "), "skill").alias("note"))

    @cached_property
    def nav_outcomes(self) -> DataFrame:
        i = self.nav.select("instance").distinct()
        return i.select("instance", ((F.expr("instance div 100000")
                                      + F.col("instance") % 100000) % 3 != 0).alias("success"))

    @cached_property
    def nav_skills(self) -> DataFrame:
        return self.inv.filter("skill % 10 <> 9").select(
            F.concat(F.lit("k"), "skill").alias("id")).distinct()

    @cached_property
    def vec(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"),
            F.col("embedding").alias("vec"), F.col("label").alias("block"))

    @cached_property
    def eval(self) -> DataFrame:
        lab = self.table("labels")
        return lab.join(self.table("documents").select("doc_id", "lang"), "doc_id").select(
            F.col("doc_id").alias("id"), F.concat("lang", F.lit(" level")).alias("instruction_type"),
            "lang", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))

    @cached_property
    def splits(self) -> DataFrame:
        m = F.col("doc_id") % 10
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.when(m <= 6, "test").when(m == 7, "val").otherwise("train").alias("split"))

    @cached_property
    def rules(self) -> DataFrame:
        kind = (F.when(F.col("o_orderstatus") == "F", "insert_decision")
                .when(F.col("o_orderstatus") == "O", "checkpoint").otherwise("merge_decision"))
        word = F.element_at(F.split(kind, "_"), 1)
        rnd = F.col("o_orderkey") % 4
        return self.table("orders").select(
            F.concat(word, F.lit("_skill_"), "o_custkey", F.lit("_"), rnd + 1).alias("id"),
            kind.alias("kind"), F.concat(F.lit("guard (succ 0.51 over "), F.col("o_orderkey") % 50,
                                         F.lit(" trials)")).alias("statement"),
            F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("seq"),
            rnd.alias("round"), (rnd + 1).alias("step"))

    @cached_property
    def rule_skills(self) -> DataFrame:
        """Customers as the skills that the rules name."""
        bal = F.floor(F.abs("c_acctbal")).cast("long")
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.when(F.col("c_nationkey") % 4 == 3, "retired").otherwise("deployed").alias("status"),
            F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(bal % 100).cast("long")
            .alias("success_count"),
            F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(bal % 7).cast("long")
            .alias("failure_count"))

    @cached_property
    def rounds(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("round"),
            F.col("o_totalprice").alias("score"))

    @cached_property
    def attempts(self) -> DataFrame:
        """A user's day is a guarded run, its events the attempts."""
        return self.chain.select(
            F.col("chain").alias("run"), F.col("user_id").alias("skill"), F.col("pos").alias("n"),
            (F.col("task_type") == "purchase").alias("ok"))


SQL = {
    "v_skills": """SELECT d.doc_id AS id, d.doc_id AS ord, d.source AS name, d.lang AS description,
        d.text AS body, d.lang AS lang, 0 AS token_cost,
        CASE WHEN l.quality IS NULL THEN 'candidate' WHEN l.quality = 0 THEN 'retired'
             WHEN l.toxic = 1 THEN 'validated' ELSE 'deployed' END AS status
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_pool": """SELECT * FROM v_skills WHERE status = 'deployed' OR (status = 'validated' AND
        NOT EXISTS (SELECT 1 FROM v_skills WHERE status = 'deployed'))""",
    "v_tasks": """SELECT item_id AS task_id, text,
        CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'fr' END AS task_type FROM benchmark""",
    "v_part_use": """SELECT l_partkey AS id, l_returnflag = 'R' AS returned,
        s_nationkey AS nation, r_name AS region, l_orderkey AS "order"
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_part_types": """SELECT DISTINCT id, region AS task_type FROM v_part_use""",
    "v_parts": """SELECT p_partkey AS id, p_partkey AS ord, p_name AS name,
        p_type AS description, p_name || ' ' || p_brand || ' ' || p_type AS body,
        CAST(p_size AS BIGINT) AS token_cost,
        CASE WHEN p_partkey % 10 <= 5 THEN 'deployed' WHEN p_partkey % 10 <= 7 THEN 'validated'
             WHEN p_partkey % 10 = 8 THEN 'candidate' ELSE 'retired' END AS status,
        coalesce(s, 0) AS success_count, coalesce(f, 0) AS failure_count,
        coalesce(v, 0) AS n_visit, coalesce(c, 0) AS coverage,
        coalesce(lu, -1) AS last_used_step, coalesce(nt, 0) AS n_types
        FROM part LEFT JOIN (SELECT id, count(*) FILTER (NOT returned) AS s,
            count(*) FILTER (returned) AS f, count(*) AS v, count(DISTINCT nation) AS c,
            max("order") AS lu, count(DISTINCT region) AS nt FROM v_part_use GROUP BY id) u
        ON p_partkey = u.id""",
    "v_rate": """SELECT id, CASE WHEN success_count + failure_count > 0 THEN
        success_count / (success_count + failure_count) ELSE 0.0 END AS rate FROM v_parts""",
    "v_dep": """SELECT p_partkey AS src, p_partkey // 2 AS dst, 'depends_on' AS type FROM part
        WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 3, 'depends_on' FROM part
        WHERE p_partkey > 0 AND p_partkey % 5 = 0""",
    "v_dep_cyc": "SELECT * FROM v_dep UNION ALL SELECT 1, 3, 'depends_on'",
    "v_conflict": """SELECT p_partkey AS src, p_partkey + 1 AS dst, 'conflicts_with' AS type
        FROM part WHERE p_partkey % 10 = 0""",
    "v_compose": """SELECT p_partkey AS src, p_partkey + 2 AS dst, 'composes_with' AS type
        FROM part WHERE p_partkey % 4 = 1""",
    "v_edges": """SELECT * FROM v_dep UNION ALL SELECT * FROM v_conflict
        UNION ALL SELECT * FROM v_compose""",
    "v_blocked": "SELECT p_partkey AS id FROM part WHERE p_partkey % 17 = 0",
    "v_seeds": """SELECT task_id, id, rank FROM (SELECT o_custkey AS task_id, l_partkey AS id,
        row_number() OVER (PARTITION BY o_custkey ORDER BY sum(l_quantity) DESC, l_partkey)
        AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY o_custkey, l_partkey) WHERE rank <= 3""",
    "v_closure": """SELECT task_id, id FROM v_seeds UNION
        SELECT c.task_id, d.dst FROM v_closure c JOIN v_dep d ON c.id = d.src""",
    "v_open": "SELECT * FROM v_closure WHERE id NOT IN (SELECT id FROM v_blocked)",
    "v_fights": """SELECT a.task_id, CASE WHEN (sb.id IS NOT NULL AND sa.id IS NULL)
            OR rb.rate > ra.rate THEN c.src ELSE c.dst END AS id
        FROM v_conflict c JOIN v_open a ON a.id = c.src
        JOIN v_open b ON b.id = c.dst AND b.task_id = a.task_id
        LEFT JOIN v_seeds sa ON sa.task_id = a.task_id AND sa.id = c.src
        LEFT JOIN v_seeds sb ON sb.task_id = a.task_id AND sb.id = c.dst
        JOIN v_rate ra ON ra.id = c.src JOIN v_rate rb ON rb.id = c.dst""",
    "v_route": """SELECT o.task_id, o.id FROM v_open o JOIN v_parts p ON p.id = o.id
        LEFT JOIN v_fights f ON f.task_id = o.task_id AND f.id = o.id
        WHERE f.id IS NULL AND p.status IN ('deployed', 'validated')""",
    "v_trace_atoms": """SELECT DISTINCT l_orderkey AS trace, l_partkey AS atom,
        o_orderstatus = 'F' AS success FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_cooc": """SELECT x.atom AS a, y.atom AS b,
        sum(CASE WHEN x.success THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight
        FROM v_trace_atoms x JOIN v_trace_atoms y ON x.trace = y.trace AND x.atom < y.atom
        GROUP BY 1, 2""",
    "v_evidence": """SELECT l_partkey AS atom, 'seen in order ' || min(l_orderkey) AS body
        FROM lineitem GROUP BY 1""",
    "v_inv": """SELECT event_id AS step, ts, user_id, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS skill, event_type AS task_type,
        event_id % 3 <> 0 AS success, event_type = 'purchase' AS ood FROM events""",
    "v_days": """SELECT *, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day
        FROM v_inv""",
    "v_chain": """SELECT user_id * 100000 + day AS chain, step AS seq, user_id, skill AS k,
        task_type, (user_id + day) % 3 <> 0 AS success, 's' || (skill // 5) AS step,
        'q ' || skill || ' ' || task_type AS question,
        row_number() OVER (PARTITION BY user_id, day ORDER BY v_days.step) - 1 AS pos,
        count(*) OVER (PARTITION BY user_id, day) AS len FROM v_days""",
    "v_trans": """SELECT * FROM (SELECT chain, pos, seq, success,
        lag(step) OVER (PARTITION BY chain ORDER BY pos) AS src, step AS dst FROM v_chain)
        WHERE src IS NOT NULL AND src <> dst""",
    "v_nav": """SELECT user_id * 100000 + day AS instance, step AS pos,
        CASE task_type WHEN 'click' THEN 'locate' WHEN 'view' THEN 'step_to'
             WHEN 'error' THEN 'go_off_graph' ELSE 'idle' END AS action,
        'k' || skill AS cursor, 'task of ' || user_id AS task, 'note ' || skill AS note,
        (user_id + day) % 3 <> 0 AS success, skill FROM v_days""",
    "v_eval": """SELECT l.doc_id AS id, d.lang || ' level' AS instruction_type, d.lang,
        quality = 1 AS a, toxic = 0 AS b FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "v_splits": """SELECT doc_id AS id, CASE WHEN doc_id % 10 <= 6 THEN 'test'
        WHEN doc_id % 10 = 7 THEN 'val' ELSE 'train' END AS split FROM documents""",
    "v_rules": """SELECT split_part(kind, '_', 1) || '_skill_' || target || '_' || (round + 1)
            AS id, * FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'insert_decision'
            WHEN 'O' THEN 'checkpoint' ELSE 'merge_decision' END AS kind,
            'guard (succ 0.51 over ' || (o_orderkey % 50) || ' trials)' AS statement,
            o_custkey AS target, o_orderkey AS seq, o_orderkey % 4 AS round FROM orders)""",
    "v_rule_skills": """SELECT c_custkey AS id, c_name AS name,
        CASE WHEN c_nationkey % 4 = 3 THEN 'retired' ELSE 'deployed' END AS status,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE
             CAST(floor(abs(c_acctbal)) AS BIGINT) % 100 END AS success_count,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE
             CAST(floor(abs(c_acctbal)) AS BIGINT) % 7 END AS failure_count FROM customer""",
    "v_ledger": """SELECT s.id, s.status, coalesce(m.r, -1) AS mint_round,
        s.success_count + s.failure_count AS trials,
        CASE WHEN s.success_count + s.failure_count > 0 THEN
          round(s.success_count / (s.success_count + s.failure_count), 2) END AS succ,
        coalesce(c.r, -1) AS checkpoint_round, c.succ AS checkpoint_succ,
        coalesce(c.trials, -1) AS checkpoint_trials
        FROM v_rule_skills s
        LEFT JOIN (SELECT target, min_by(round, seq) AS r FROM v_rules
                   WHERE kind = 'insert_decision' GROUP BY 1) m ON m.target = s.id
        LEFT JOIN (SELECT target, max_by(round, seq) AS r, 0.51::DOUBLE AS succ,
                   max_by(seq % 50, seq) AS trials FROM v_rules WHERE kind = 'checkpoint'
                   GROUP BY 1) c ON c.target = s.id""",
    "v_rounds": "SELECT o_custkey AS run, o_orderkey AS round, o_totalprice AS score FROM orders",
    "v_attempts": """SELECT chain AS run, user_id AS skill, pos AS n, task_type = 'purchase' AS ok
        FROM v_chain""",
    # Unicode white space plus the four separator characters, as the tokenizer has it
    "v_doc_tokens": r"""SELECT id, ord, unnest(regexp_extract_all(lower(name || ' ' || description
        || ' ' || body), '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))
        AS token FROM v_pool""",
    "v_task_tokens": r"""SELECT task_id, token, count(*) AS qtf FROM (SELECT task_id,
        unnest(regexp_extract_all(lower(text), '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))
        AS token FROM v_tasks) GROUP BY 1, 2""",
    "v_postings": "SELECT id, token, count(*) AS tf FROM v_doc_tokens GROUP BY 1, 2",
    "v_lens": """SELECT p.id, p.ord, coalesce(c.len, 0) AS len FROM v_pool p LEFT JOIN
        (SELECT id, count(*) AS len FROM v_doc_tokens GROUP BY 1) c ON c.id = p.id""",
    "v_raw_idf": """SELECT token, count(*) AS df, ln((SELECT count(*) FROM v_pool) - count(*) + 0.5)
        - ln(count(*) + 0.5) AS raw FROM v_postings GROUP BY 1""",
    "v_idf": """SELECT token, df, CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM v_raw_idf)
        ELSE raw END AS idf FROM v_raw_idf""",
    "v_bm25": """SELECT q.task_id, p.id, round(sum(q.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 *
        (0.25 + 0.75 * l.len / (SELECT avg(len) FROM v_lens)))), 6) AS score
        FROM v_task_tokens q JOIN v_postings p ON p.token = q.token
        JOIN v_idf i ON i.token = q.token JOIN v_lens l ON l.id = p.id GROUP BY 1, 2""",
    "v_scores": """SELECT t.task_id, t.task_type, p.id, p.ord, coalesce(b.score, 0.0) AS score
        FROM v_tasks t CROSS JOIN v_pool p
        LEFT JOIN v_bm25 b ON b.task_id = t.task_id AND b.id = p.id""",
    "v_bm25_top3": """SELECT * FROM (SELECT task_id, id, score, row_number() OVER
        (PARTITION BY task_id ORDER BY score DESC, ord) AS rank FROM v_scores) WHERE rank <= 3""",
}
