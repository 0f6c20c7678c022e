import random

from pyspark.sql import functions as F

import brute
from conftest import rows
from ropewalk.operators import retrieval as r
from ropewalk.operators import routing
from ropewalk.plans import route as plan
from ropewalk.sources import sinks

SKILL = ("id string, ord long, name string, description string, body string, status string, "
         "task_types array<string>, token_cost long, success_count long, failure_count long")


def skill(i, ord_, body, status="deployed", ok=0, bad=0, types=(), desc=""):
    return (i, ord_, i, desc, body, status, list(types), 0, ok, bad)


def edges(make, data):
    return make(data or [("", "", "")], "src string, dst string, type string").filter("src <> ''")


def tasks(make, *data):
    return make(list(data), "task_id string, text string, task_type string")


def test_route_finds_the_unhinted_prerequisite(make):
    sk = make([skill("parse", 0, "parse handle text"), skill("tokenize", 1, "tokenize split words"),
               skill("unrelated", 2, "plot chart axis")], SKILL)
    e = edges(make, [("parse", "tokenize", "depends_on")])
    got = plan.route(tasks(make, ("t", "parse handle text", "")), sk, e, edges(make, []), top=1)
    assert rows(got.nodes, "id") == [("parse",), ("tokenize",)]
    assert rows(routing.excluded_ids(got.excluded(), got.pool), "id") == [("unrelated",)]


def test_flat_top1_ties_go_to_insertion_order(make):
    sk = make([skill("aaa", 0, "alpha alpha"), skill("bbb", 1, "beta beta")], SKILL)
    got = r.flat_route(tasks(make, ("t", "alpha", "")), sk, "bm25", 1, plan.pool_index(sk))
    assert rows(got, "id") == [("aaa",)]


def test_k_rows_even_when_nothing_matches(make):
    sk = make([skill(c, i, f"word{c}") for i, c in enumerate("abcde")], SKILL)
    got = r.bm25_search(tasks(make, ("t", "zzz", ""), ("u", "wordd", "")), plan.pool_index(sk), 3)
    assert rows(got, "task_id", "rank", "id") == [
        ("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c"), ("u", 1, "d"), ("u", 2, "a"), ("u", 3, "b")]


def test_stored_index_searches_like_a_fresh_one(spark, make, tmp_path):
    sk = make([skill("a", 0, "red fox"), skill("b", 1, "red hen"), skill("c", 2, "blue sea")], SKILL)
    index = plan.pool_index(sk)
    index.write(str(tmp_path))
    t = tasks(make, ("t", "red hen", ""))
    cols = ("id", "score", "rank")
    back = r.Bm25Index.read(spark, str(tmp_path))
    assert rows(r.bm25_search(t, index, 2), *cols) == rows(r.bm25_search(t, back, 2), *cols)


def test_validated_only_pool(make):
    sk = make([skill("a", 0, "x", "validated"), skill("b", 1, "x", "candidate")], SKILL)
    assert rows(routing.candidate_pool(sk), "id") == [("a",)]
    assert rows(routing.candidate_pool(sk.filter("id = 'b'")), "id") == []


def test_closure_with_cycle_and_dangling_id(make):
    sk = make([skill(c, i, "x") for i, c in enumerate("abc")], SKILL)
    e = edges(make, [("a", "b", "depends_on"), ("b", "c", "depends_on"), ("c", "a", "depends_on"),
                     ("b", "ghost", "depends_on"), ("a", "c", "conflicts_with")])
    seeds = make([("t", "a"), ("u", "ghost")], "task_id string, id string")
    for hops in (1, 4):
        got = routing.dependency_closure(seeds, e, sk, hops)
        assert rows(got, "task_id", "id") == [("t", "a"), ("t", "b"), ("t", "c")]


def test_prerequisite_behind_a_blocked_record_stays(make):
    sk = make([skill(c, i, "x") for i, c in enumerate("abc")], SKILL)
    e = edges(make, [("a", "b", "depends_on"), ("b", "c", "depends_on")])
    seeds = make([("t", "a", 1)], "task_id string, id string, rank int")
    block = edges(make, [("rule", "b", "blocks_routing")])
    assert rows(plan.expand(seeds, sk, e, block), "id") == [("a",), ("c",)]


def test_conflict_chains_follow_edge_order(make):
    rnd = random.Random(5)
    names = "abcdefgh"
    for trial in range(4):
        rates = {c: rnd.randint(0, 9) for c in names}
        es = {tuple(rnd.sample(names, 2)) for _ in range(9)}
        seeds = set(rnd.sample(names, 2))
        sk = make([skill(c, i, "x", ok=rates[c], bad=10 - rates[c])
                   for i, c in enumerate(names)], SKILL)
        act = make([("t", c) for c in names], "task_id string, id string")
        sd = make([("t", c) for c in seeds], "task_id string, id string")
        got = routing.resolve_conflicts(act, sd, edges(make, [(s, d, "conflicts_with")
                                                              for s, d in es]), sk)
        want = brute.settle(names, seeds, rates, es)
        assert {x[0] for x in rows(got, "id")} == want, (trial, es, seeds, rates)


def test_conflicts_of_many_tasks_and_hubs(make):
    rnd = random.Random(11)
    names = [f"n{i:02d}" for i in range(24)]
    rates = {c: rnd.randint(0, 4) for c in names}
    es = {tuple(rnd.sample(names, 2)) for _ in range(90)}
    es |= {("n00", c) for c in names[1:]} | {(c, "n23") for c in names[:-1]} | {("n05", "n05")}
    sk = make([skill(c, i, "x", ok=rates[c], bad=10 - rates[c]) for i, c in enumerate(names)], SKILL)
    e = edges(make, [(s, d, "conflicts_with") for s, d in es])
    active = {t: rnd.sample(names, rnd.randint(2, 24)) for t in range(40)}
    seeds = {t: set(rnd.sample(a, min(len(a), 3))) for t, a in active.items()}
    pairs = "task_id long, id string"
    got = routing.resolve_conflicts(make([(t, c) for t, a in active.items() for c in a], pairs),
                                    make([(t, c) for t, a in seeds.items() for c in a], pairs), e, sk)
    want = []
    for t, a in active.items():
        here = {(s, d) for s, d in es if s != d and s in a and d in a}
        want += [(t, c) for c in brute.settle(a, seeds[t], rates, here)]
    assert rows(got, "task_id", "id") == sorted(want)


def test_long_chain_of_conflicts_settles_in_few_rounds(make, monkeypatch):
    n, rounds = 10_000, []
    step = routing._settle_round
    monkeypatch.setattr(routing, "_settle_round", lambda *a: rounds.append(1) or step(*a))
    data = make([(i, 0, 0) for i in range(n)], "id long, success_count long, failure_count long")
    e = edges(make, []).select(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), "type").union(
        make([(i, i + 1, "conflicts_with") for i in range(n - 1)], "src long, dst long, type string"))
    act = data.select(F.lit("t").alias("task_id"), "id")
    got = {i for _, i in rows(routing.resolve_conflicts(act, act.limit(0), e, data), "task_id", "id")}
    assert got == set(range(0, n, 2))
    assert len(rounds) < 20


def test_type_boost_reaches_unmatched_records(make):
    sk = make([skill("a", 0, "common word", types=["sheet"]), skill("b", 1, "other", types=["cell"]),
               skill("c", 2, "thing", types=["all"]), skill("d", 3, "more", types=["cell"])], SKILL)
    t = tasks(make, ("t", "common", "Cell edit"))
    got = routing.lexical_seeds(t, sk, plan.pool_index(sk), 3, type_boost=2.0)
    assert rows(got, "rank", "id") == [(1, "b"), (2, "d"), (3, "a")]


def test_role_routes_follow_selector_replies(make):
    sk = make([skill(c, i, "b " + c) for i, c in enumerate(["edit", "locate", "run"])], SKILL)
    t = tasks(make, ("t", "fix bug", ""))
    replies = make([("t/editor", 'I pick ["edit"] or [bad json'),
                    ("t/explorer", '["nothing"] then ["locate"] then ["unknown"]')],
                   "task_id string, reply string")
    picks = routing.seeds_from_replies(replies, sk)
    got = plan.role_routes(t, ["editor", "explorer"], sk, edges(make, []), edges(make, []),
                           external_seeds=picks)
    assert rows(got.nodes, "task_id", "id") == [("t/editor", "edit"), ("t/explorer", "locate")]


def test_unusable_reply_falls_back_to_text(make):
    sk = make([skill("edit", 0, "edit files"), skill("run", 1, "run tests"),
               skill("see", 2, "look around")], SKILL)
    t = tasks(make, ("t", "run tests", ""))
    picks = routing.seeds_from_replies(make([("t", "no list")], "task_id string, reply string"), sk)
    got = plan.route(t, sk, edges(make, []), edges(make, []), top=1, external_seeds=picks)
    assert rows(got.nodes, "id") == [("run",)]


def test_render(make):
    sk = make([skill("edit", 0, "SECRET-BODY", desc="edit desc")], SKILL)
    got = plan.route(tasks(make, ("t", "edit something", "")), sk, edges(make, []), edges(make, []))
    text = rows(sinks.render_route_text(got.tasks, got.bodies(), "H"), "text")[0][0]
    assert text == "## H\n\nSECRET-BODY"
    doc = rows(sinks.render_skill_docs(got.nodes, sk), "path", "value")[0]
    assert doc == ("edit/SKILL.md", "---\nname: edit\ndescription: edit desc\n---\n\nSECRET-BODY\n")
    none = sinks.render_route_text(make([("z",)], "task_id string"), got.bodies(), "H")
    assert rows(none, "text") == [("",)]


def test_first_checkpoint_guards(make):
    routes = make([("t", "a"), ("t", "b")], "task_id string, id string")
    g = make([("a", 2, "late"), ("a", 1, "early")], "id string, seq int, rule_id string")
    assert rows(routing.guards(routes, g)) == [("t", "a", "early")]


def test_route_does_not_depend_on_partitioning(make):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    data = [skill(f"s{i:02d}", i, " ".join(rnd.choices(words, k=12))) for i in range(40)]
    es = [(f"s{i:02d}", f"s{i // 2:02d}", "depends_on") for i in range(1, 40)]
    t = tasks(make, *[(f"t{i}", " ".join(rnd.choices(words, k=4)), "") for i in range(6)])
    out = []
    for parts in (1, 5):
        sk = make(data, SKILL).repartition(parts, F.xxhash64("body"))
        out.append(rows(plan.route(t, sk, edges(make, es), edges(make, []), hop=2).nodes,
                        "task_id", "id"))
    assert out[0] == out[1]


def test_pruned_search_equals_full_search(make):
    rnd = random.Random(17)
    words = [f"w{i}" for i in range(25)]
    weights = [1.0 / (i + 1) for i in range(25)]
    docs = make([(i, i, " ".join(rnd.choices(words, weights, k=rnd.randint(3, 25))))
                 for i in range(80)], "id long, ord long, text string")
    t = make([(i, " ".join(rnd.choices(words, k=rnd.randint(1, 6)))) for i in range(25)],
             "task_id long, text string")
    index = r.bm25_index(docs)
    cols = ("task_id", "rank", "id", "score")
    full = rows(r.bm25_search(t, index, 4), *cols)
    assert len(full) == 100
    for cut in (2, 8, 20):
        assert rows(r.bm25_search(t, index, 4, frequent=cut), *cols) == full


def test_routing_with_vectors(make):
    sk = make([skill("a", 0, "red fox runs"), skill("b", 1, "blue sea"), skill("c", 2, "red hen")],
              SKILL)
    t = tasks(make, ("t", "blue sea", "x"))
    got = plan.route(t, sk, edges(make, []), edges(make, []), top=1, retriever="embed")
    assert rows(got.nodes, "id") == [("b",)]


def pool_of(make, texts):
    return make([(i, i, t) for i, t in enumerate(texts)], "id long, ord long, text string")


def test_zero_only_for_records_that_match_nothing(make):
    """Negative weights: a record with a negative score must not come back with a made-up zero."""
    from ropewalk.operators.retrieval import bm25_index, bm25_search

    texts = ["alpha beta"] * 3 + ["beta alpha"] * 2 + ["alpha"] + ["gamma"]
    docs, tasks = pool_of(make, texts), make([(1, "alpha"), (2, "none"), (3, "gamma")], "task_id long, text string")
    index = bm25_index(docs)
    for frequent in (None, 1, 100):
        got = {}
        for r in bm25_search(tasks, index, 2, frequent=frequent).collect():
            got.setdefault(r.task_id, []).append((r.score, -r.ord, r.id))
        scores = {}
        for r in bm25_scores_of(tasks, index):
            scores.setdefault(r.task_id, {})[r.id] = r.score
        for task in (1, 2, 3):
            own = scores.get(task, {})
            want = sorted(((own.get(i, 0.0), -i, i) for i in range(7)), reverse=True)[:2]
            assert sorted(got[task], reverse=True) == want


def bm25_scores_of(tasks, index):
    from ropewalk.operators.retrieval import bm25_scores
    return bm25_scores(tasks, index).collect()


def test_first_unmatched_over_many_runs(make, monkeypatch):
    from ropewalk.operators import retrieval

    monkeypatch.setattr(retrieval, "RUN", 3)
    docs = pool_of(make, ["x"] * 20).selectExpr("id", "ord * 1000003 % 7919 AS ord")
    order = sorted((r.ord, r.id) for r in docs.collect())
    used = {1: set(range(20)), 2: {i for _, i in order[:9]}, 3: set(), 4: {i for _, i in order[::2]}}
    matched = make([(t, i) for t, ids in used.items() for i in ids], "task_id long, id long")
    got = {}
    for r in retrieval.first_unmatched(make([(t,) for t in used], "task_id long"), matched, docs, 4).collect():
        got.setdefault(r.task_id, set()).add(r.id)
    assert got == {t: set([i for _, i in order if i not in ids][:4]) for t, ids in used.items() if len(ids) < 20}


def test_null_description_can_be_found(make):
    from ropewalk.functions.text import bm25_text, vector_text

    df = make([("n", None, "red fox")], "name string, description string, body string")
    assert df.select(bm25_text("name", "description", "body"), vector_text("name", "description", "body")).first()[:] == (
        "n  red fox", "n.  red fox")


def _shuffled(spark):
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    stages = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords()
            for i in range(stages.size())}


def test_closure_sets_out_from_the_last_hop_only(spark, make):
    n = 40
    edges = make([(i, i - 1, "depends_on") for i in range(1, n)] + [(0, 5, "depends_on")], "src long, dst long, type string")
    skills = make([(i,) for i in range(n)], "id long")
    seeds = make([(i, i) for i in range(n)], "task_id long, id long")
    before = _shuffled(spark)
    got = rows(routing.dependency_closure(seeds, edges, skills), "task_id", "id")
    assert got == sorted({(i, j) for i in range(n) for j in range(max(i, 5) + 1)})
    after = _shuffled(spark)
    moved = sum(v - before.get(k, 0) for k, v in after.items())
    assert moved < 14 * len(got)
