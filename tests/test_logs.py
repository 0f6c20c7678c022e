import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from conftest import rows
from ropewalk import functions as fn
from ropewalk.operators import chains as ch
from ropewalk.operators import evaluation as ev
from ropewalk.operators import mining as m
from ropewalk.sources import readers as rd
from ropewalk.streaming import jobs


def test_attempts_until_pass_and_budget(make):
    att = make([("r1", "bad", i, i >= 2) for i in range(4)] + [("r2", "bad", i, False)
                                                             for i in range(5)],
               "run string, skill string, n int, ok boolean")
    assert rows(ev.attempt_outcomes(att, 2)) == [("r1", "bad", True, 3), ("r2", "bad", False, 3)]
    e = ev.attempt_evidence(att, 2)
    assert rows(ev.attempt_counters(e)) == [("bad", 1, 5, 1, 5)]
    first = make([("r", "s", 0, True)], att.schema)
    assert ev.attempt_evidence(first).first()["evidence"] is None
    assert ev.attempt_evidence(first, rule="any_success").first()["evidence"] == "fixed_by"


def test_nav_log_and_attribution(spark, make, tmp_path):
    lines = [json.dumps(x) for x in [
        {"action": "locate", "cursor": "a", "task": "t"}, {"action": "step_to", "cursor": "b"},
        {"action": "step_to", "cursor": "a"},
        {"action": "go_off_graph", "cursor": None, "note": "no skill"}]]
    (tmp_path / "i1.jsonl").write_text("\n".join(lines[:2] + ["", "{broken"] + lines[2:]))
    nav = rd.read_nav_log(spark, str(tmp_path))
    assert rows(nav, "instance", "action") == [("i1", "go_off_graph"), ("i1", "locate"),
                                               ("i1", "step_to"), ("i1", "step_to")]
    assert rows(rd.nav_tasks(nav)) == [("i1", "t")]
    assert rows(ev.unique_visited(nav), "rn", "id") == [(0, "a"), (1, "b")]
    sk = make([("a",), ("b",), ("c",)], "id string")
    got = ev.nav_attribution(nav, make([("i1", False)], "instance string, success boolean"), sk)
    assert rows(got) == [("a", 0, 1), ("b", 0, 1)]


def test_graph_document_compat(spark, tmp_path):
    doc = {"skills": [{"id": "a", "name": "A", "heat": {"success_count": 3}},
                      {"id": "b", "name": "B", "status": "deployed", "task_types": ["t"]}],
           "capability_edges": [{"src": "a", "dst": "b", "type": "depends_on"},
                                {"src": "a", "dst": "gone", "type": "depends_on"}],
           "governance": [{"id": "r1", "kind": "checkpoint", "statement": "s", "targets": ["b"]},
                          {"id": "r2", "kind": "block_signal", "statement": "s", "targets": ["a"]}]}
    p = tmp_path / "g.json"
    p.write_text(json.dumps(doc, indent=1))
    full, lossy = rd.read_graph(spark, str(p)), rd.read_graph(spark, str(p), compat=True)
    assert rows(full["edges"]) == [("a", "b", "depends_on", 1.0)]
    assert rows(full["skills"], "id", "status", "success_count") == [
        ("a", "candidate", 3), ("b", "deployed", 0)]
    assert rows(lossy["skills"], "id", "success_count") == [("a", 0), ("b", 0)]
    assert rows(full["rule_targets"], "type") == [("blocks_routing",), ("guards_skill",)]
    assert rows(lossy["rule_targets"], "type") == [("applies_to_skill",), ("guards_skill",)]
    assert rows(full["rules"], "id", "max_retries") == [("r1", 2), ("r2", 2)]


def test_skill_docs(spark, tmp_path):
    for name, text in {"one": '---\nname: "One"\ndescription: d\n---\n\nBody\n',
                       "two": "---\ndescription: no name\n---\nx", "three": "plain"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(text)
    assert rows(rd.read_skill_docs(spark, str(tmp_path))) == [("one", "One", "d", "Body\n")]


def test_replies(make):
    df = make([('x [{"name":"N","body":"B","task_types":["cell"]},{"name":"no"}] y',), ("none",)],
              "reply string")
    got = [r[0] for r in df.select(fn.parse_fragments("reply")).collect()]
    assert [tuple(x) for x in got[0]] == [("N", "", "B", ["cell"], "skill")] and not got[1]
    one = make([('[{"id":"a","desc":"x"},{"desc":"y"},{"id":""}]',)], "reply string")
    assert [tuple(x) for x in one.select(fn.parse_chain("reply")).first()[0]] == [
        ("a", "x"), ("y", "y")]


def test_whitespace_tokens_follow_unicode(make):
    text = "  Ünï Two three\x1cfour\n"
    got = make([(text,)], "t string").select(fn.ws_tokens("t")).first()[0]
    assert got == text.lower().split()
    assert make([("",)], "t string").select(fn.ws_tokens("t")).first()[0] == []


def test_slugs(make):
    df = make([("Load CSV",), ("  --  ",), ("x" * 80,), ("Été 1",)], "t string")
    assert [r[0] for r in df.select(fn.slugify("t")).collect()] == [
        "load_csv", "node", "x" * 64, "t_1"]


def test_rule_step_is_the_leftmost_number(make):
    df = make([("insert_a_3",), ("merge_a_3_2",), ("insert_v_2_7",), ("none",)], "i string")
    assert [r[0] for r in df.select(fn.rule_step("i")).collect()] == [3, 3, 2, None]


def _steps(make, chains):
    data, seq = [], 0
    for c, (steps, ok) in chains.items():
        for i, s in enumerate(steps):
            data.append((c, i, s, f"does {s}", ok, "t", f"question {c}", seq))
            seq += 1
    return make(data, "chain string, pos long, step string, desc string, success boolean, "
                      "task_type string, question string, seq long")


def test_repeated_step_counts_but_makes_no_self_edge(make):
    s = _steps(make, {"c": (["a", "a", "b"], True), "d": (["a", "b"], False)})
    assert rows(ch.chain_nodes(s), "id", "n_visit", "n_success") == [("a", 3, 2), ("b", 2, 1)]
    assert rows(ch.chain_edges(s), "src", "dst", "count", "succ", "weight") == [
        ("a", "b", 2, 1, 2.5)]


def test_consensus_walk_matches_one_by_one(make):
    rnd = random.Random(4)
    names = [f"s{i}" for i in range(14)]
    es = {}
    for o in range(60):
        s, d = rnd.sample(names, 2)
        es.setdefault((s, d), (s, d, float(rnd.randint(1, 6)), rnd.randint(0, 2), o))
    es = list(es.values())
    edges = make([(s, d, w, 1, k, o) for s, d, w, k, o in es],
                 "src string, dst string, weight double, count long, succ long, ord long")
    nodes = make([(n, 1.0 * i, 2) for i, n in enumerate(names)],
                 "id string, pos_sum double, pos_n long")
    picks = {f"t{i}": rnd.sample(names, rnd.randint(1, 3)) for i in range(12)}
    seeds = make([(t, i, r + 1) for t, ids in picks.items() for r, i in enumerate(ids)],
                 "task_id string, id string, rank int")
    got = ch.consensus_path(seeds, nodes, edges)
    out = {}
    for t, i in rows(got, "task_id", "id"):
        out.setdefault(t, set()).add(i)
    assert out == {t: brute.walk(ids, es) for t, ids in picks.items()}


def test_gap_fill_takes_the_cut_before_the_filter(make):
    cooc = make([("a", f"x{i}", 9.0 - i) for i in range(8)], "a string, b string, weight double")
    ev_ = make([(f"x{i}", "body") for i in range(8)], "atom string, body string")
    pool = make([(f"x{i}",) for i in range(5)], "id string")
    routes = make([("t", "a")], "task_id string, id string")
    got = m.gap_fill(routes, cooc, ev_, pool, max_synth=3)
    assert rows(got, "id") == [("x5",)]  # x6 and x7 lie beyond the first six


def test_consolidation_revives_and_inserts(make):
    cooc = make([("a", "b", 5.0), ("b", "c", 4.0)], "a string, b string, weight double")
    e = make([("a", "A"), ("b", "B"), ("c", "C")], "atom string, body string")
    sk = make([("a", "retired", "own"), ("b", "deployed", "x")],
              "id string, status string, body string")
    got = m.consolidation(cooc, e, sk, 2)
    assert rows(got, "id", "action", "body") == [("a", "revive", "own"), ("c", "insert", "C")]


def test_missing_results(make):
    res = make([("1", True), ("2", False)], "id string, success boolean")
    split = make([("test", "1"), ("test", "2"), ("test", "3")], "split string, id string")
    assert rows(ev.score_on_split(res, split)) == [("test", 1, 2, 0.5)]
    assert rows(ev.score_on_split(res, split, "fail")) == [("test", 1, 3, 0.333333)]


def test_gate_replay(make):
    df = make([("r", i, s) for i, s in enumerate([0.425, 0.475, 0.55, 0.5, 0.6])],
              "run string, round long, score double")
    got = rows(ev.gate_replay(df, "run", "round", 0.45), "round", "accepted", "carried")
    assert got == [(0, False, 0.45), (1, True, 0.475), (2, True, 0.55), (3, False, 0.55),
                   (4, True, 0.6)]


def test_stream_equals_batch(spark, make, tmp_path):
    inv = make([(f"s{i % 5}", i % 3 == 0, i) for i in range(50)], "skill string, success boolean, step long")
    inv.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(inv.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (jobs.stream_heat(s).writeStream.outputMode("complete").format("memory").queryName("heat")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.table("heat")) == rows(m.heat_counters(inv))


def test_stream_lifecycle_counts_tasks_once(spark, make, tmp_path):
    inv = make([(f"s{i % 5}", True, i) for i in range(60)], "skill string, success boolean, step long")
    inv.repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []
    sk = make([("s0", "validated"), ("idle", "validated")], "id string, status string")
    s = spark.readStream.schema(inv.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (jobs.stream_lifecycle(s, lambda: sk, lambda d, n: seen.append(
        (n, rows(d, "id", "n_visit"))), str(tmp_path / "batches"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert [n // 25 for n, _ in seen] == sorted({n // 25 for n, _ in seen}) and seen
    assert dict(seen[-1][1])["idle"] == 0


@pytest.mark.parametrize("files", [1, 4])
def test_stream_lifecycle_steps_once_per_tick(spark, make, tmp_path, files):
    inv = make([(f"s{i % 5}", i % 3 == 0, i) for i in range(60)], "skill string, success boolean, step long")
    inv.repartitionByRange(files, "step").sortWithinPartitions("step").write.parquet(str(tmp_path / "in"))
    seen = []
    s = spark.readStream.schema(inv.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    q = (jobs.stream_lifecycle(s, lambda: make([("s0", "validated")], "id string, status string"), lambda d, n: seen.append(
        (n, rows(d, "n_visit", "success_count", "last_used_step"))), str(tmp_path / "batches"), every=10)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert [n for n, _ in seen] == [10, 20, 30, 40, 50, 60]
    for n, got in seen:
        mine = [i for i in range(n) if i % 5 == 0]
        assert got == [(len(mine), sum(i % 3 == 0 for i in mine), mine[-1])]


def test_cooccurrence_cuts_tasks_by_pairs(spark, make, monkeypatch):
    data = [(t, a, t % 2 == 0) for t in range(40) for a in range(10)] + [(0, 3, False)]
    monkeypatch.setattr(m, "PAIRS", 50)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    got = m.cooccurrence(make(data, "trace long, atom long, success boolean"))
    assert rows(got, "a", "b", "weight") == [(a, b, 50.0) for a in range(10) for b in range(a + 1, 10)]
    # 40 traces of 55 pairs: each task makes about 50, so the 45 sums come out of more tasks than cores
    assert len(got.inputFiles()) > 12
    assert [spark.conf.get(n) for n in names] == before


def test_stream_cooccurrence_deals_traces_to_tasks(spark, make, tmp_path):
    data = make([([f"a{i % 3}", f"a{3 + i % 2}", "z"], i % 2 == 0) for i in range(40)], "atoms array<string>, success boolean")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    dealt = jobs.stream_cooccurrence(s, tasks=7)
    # before the pairs are made
    assert "Repartition 7" in dealt._jdf.queryExecution().logical().toString()
    plain = rows(jobs.stream_cooccurrence(data), "a", "b", "weight")
    assert rows(jobs.stream_cooccurrence(data, tasks=7), "a", "b", "weight") == plain and len(plain) == 11


@pytest.mark.parametrize("every", [10, 7])
def test_stream_lifecycle_by_record_calls_once_a_batch(spark, make, tmp_path, every):
    log = [((None if i % 11 == 0 else i % 5), i % 3 == 0, i) for i in range(96)]
    schema = "skill int, success boolean, step long"
    for lo, hi in ((0, 3), (3, 40), (40, 96)):  # the first batch fills no cut, the others many
        make(log[lo:hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    skills = make([(0, "validated"), (3, "validated"), (9, "candidate")], "id long, status string")
    q = (jobs.stream_lifecycle(s, lambda: skills, lambda d, now: seen.append(rows(d.select(
        "id", now.alias("now"), "n_visit", "success_count", "failure_count", "last_used_step"))),
        str(tmp_path / "batches"), every=every, by_record=True)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(seen) == 2
    for got, done, n in zip(seen, (3, 40), (40, 96)):
        cuts, want = [c for c in range(every, n + 1, every) if c > done], set()
        for i in (0, 3, 9):
            for c in cuts:
                mine = [x for x in log[:c] if x[0] == i]
                if c in (cuts[0], cuts[-1]) or any(x[0] == i for x in log[c - every:c]):
                    ok = sum(x[1] for x in mine)
                    want.add((i, c, len(mine), ok, len(mine) - ok, mine[-1][2] if mine else -1))
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("every", [4, 7])
def test_promotions_equal_a_run_cut_by_cut(spark, make, tmp_path, every):
    rnd = random.Random(every)
    log = [(rnd.choice(["a", "a", "b", "c", "d", None]), rnd.random() < 0.5, i) for i in range(90)]
    log += [("late", True, 90 + i) for i in range(6)]
    recs = [("a", "validated", 0), ("b", "validated", 2), ("c", "candidate", 9), ("d", "validated", 30), ("late", "validated", 0),
            ("idle", "validated", 0), ("never", "retired", 0)]
    live = {}
    for now in range(every, len(log) + 1, every):
        for i, status, cover in recs:
            mine = [x for x in log[:now] if x[0] == i]
            last = mine[-1][2] if mine else -1
            heat = len(mine) + cover + (math.exp(-max(0, now - last) / 50) if mine else 0)
            if status == "validated" and (heat >= 8 or not mine):
                live.setdefault(i, (now, len(mine), sum(x[1] for x in mine), sum(not x[1] for x in mine), last))
    schema = "skill string, success boolean, step long"
    for lo, hi in ((0, 3), (3, 40), (40, 96)):  # batches that fill no cut, or many
        make(log[lo:hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    skills = make(recs, "id string, status string, coverage long")
    q = (jobs.stream_promotions(s, lambda: skills, str(tmp_path / "out"), every=every, deploy_heat=8.0)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "promotions")).drop("batch")
    assert rows(got) == sorted((i, *x) for i, x in live.items())


def test_rows_behind_the_watermark_are_dropped(spark, make, tmp_path):
    schema = "ts timestamp_ntz, success boolean"
    day = datetime.datetime(2024, 5, 1, 12)
    for back in (0, 0, 2):  # the last arrival is two days behind
        at = day - datetime.timedelta(days=back)
        make([(at, True), (at, False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = s.withColumn("ts", F.col("ts").cast("timestamp"))
    for late, days in (("1 hour", 1), ("3 days", 2)):
        name = f"late_{days}"
        q = (jobs.stream_success_windows(s, late=late).writeStream.outputMode("update").format("memory").queryName(name)
             .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
        q.awaitTermination()
        assert spark.table(name).select("start").distinct().count() == days


def test_sample_is_stable(make):
    df = make([(f"i{i}",) for i in range(50)], "id string")
    a, b = (ev.sample_instances(df.repartition(n), 7, 10) for n in (1, 6))
    assert rows(a) == rows(b)


def test_entropy_of_one_type_is_zero(make):
    inv = make([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "skill string, task_type string")
    got = dict(rows(m.type_entropy(inv)))
    assert abs(got["a"]) < 1e-12 and abs(got["b"] - 0.693147) < 1e-6
    assert F is not None


def test_traces_of_white_space_only_are_not_seen(make):
    from pyspark.sql import functions as F
    from ropewalk.functions.text import strip

    df = make([("\n\t",), ("  x y\r\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["", "x y", "", None]


def test_seeds_of_cooccurring_are_computed_once(make):
    """The search for partners and the exclusion of seeds read stored seeds, not their plan twice."""
    from ropewalk.operators.mining import cooccurring
    seeds = make([("t", "a"), ("t", "b"), ("t", "marker")], "task_id string, id string").filter("id <> 'marker'")
    cooc = make([("a", "b", 9.0), ("a", "c", 2.0), ("b", "c", 1.0), ("b", "d", 1.5)], "a string, b string, weight double")
    got = cooccurring(seeds, cooc)
    assert [tuple(r) for r in got.select("partner", "weight", "rank").collect()] == [("c", 3.0, 1)]
    assert "marker" not in got._jdf.queryExecution().optimizedPlan().toString()
