import random

from pyspark.sql import functions as F

import brute
from conftest import rows
from ropewalk.operators import curation as c
from ropewalk.operators import lifecycle as lc
from ropewalk.plans import curate

NODE = "id string, ord long, name string, description string, body string, status string"


def test_insert_refuses_a_known_id(make):
    have = make([("load_csv", 0, "Load CSV")], "id string, ord long, name string")
    new = make([("load_csv", 1, "again"), ("x", 2, "first"), ("x", 3, "second")], have.schema)
    table, refused = c.insert(have, new)
    assert rows(table, "id", "name") == [("load_csv", "Load CSV"), ("x", "first")]
    assert rows(refused, "ord") == [(1,), (3,)]


def test_split_makes_one_edge_per_pair(make):
    sk = make([("big", "big", "d", "P1\n\nP2", ["t1", "t2"])],
              "id string, name string, description string, body string, task_types array<string>")
    kids = c.propose_children(sk)
    assert rows(kids, "id", "body") == [("big_for_t1", "P1"), ("big_for_t2", "P2")]
    out = c.split(sk, kids, 3)
    assert rows(out["edges"]) == [("big", "big_for_t1", "depends_on"),
                                  ("big", "big_for_t2", "depends_on")]
    assert out["rules"].first()["targets"] == ["big", "big_for_t1", "big_for_t2"]
    assert out["parents"].first()["stub"].startswith("# big\nd\n\n## Sub-skills\n- **big for t1**")


def test_split_renames_a_clashing_child(make):
    sk = make([("big", "big", "d", "x", ["t"]), ("big_for_t", "y", "", "", [])],
              "id string, name string, description string, body string, task_types array<string>")
    out = c.split(sk, c.propose_children(sk.filter("id = 'big'")), 1)
    assert rows(out["children"], "id") == [("big_for_t_big",)]


def test_merge_keeps_the_most_successful(make):
    sk = make([("a", 0, 5, 1, 6, ["t1"]), ("b", 1, 2, 0, 2, ["t2"]), ("c", 2, 9, 0, 9, ["t"])],
              "id string, ord long, success_count long, failure_count long, n_visit long, "
              "task_types array<string>")
    out = c.merge_groups(sk, make([("g", "a"), ("g", "b"), ("h", "c"), ("h", "gone")],
                                  "group string, id string"))
    assert rows(out["survivors"], "group", "survivor", "success_count", "coverage") == [
        ("g", "a", 7, 2)]
    assert rows(out["retired"]) == [("b",)]
    assert rows(c.merge_lists(sk, out["members"], "task_types")) == [("a", "t1"), ("a", "t2")]


def test_later_link_wins_within_its_layer(make):
    e = make([("a", "b", "parent_child", 1.0, 0)], "src string, dst string, type string, "
                                                   "weight double, seq long")
    new = make([("a", "b", "depends_on", 1.0, 1), ("a", "b", "fixed_by", 1.0, 2),
                ("a", "ghost", "depends_on", 1.0, 3)], e.schema)
    ids = make([("a",), ("b",)], "id string")
    got = c.link(e, new, ids)
    assert rows(got, "layer", "type") == [("capability", "depends_on"), ("trace", "fixed_by")]
    left = c.unlink(got, make([("a", "b", "composes_with")], "src string, dst string, type string"))
    assert rows(left, "type") == [("fixed_by",)]


def _texts(rnd, n):
    words = [f"w{i}" for i in range(12)]
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.4:
            out.append(rnd.choice(out) if rnd.random() < 0.5 else rnd.choice(out) + " extra")
        else:
            out.append(" ".join(rnd.choices(words, k=6)))
    return out


def test_folding_matches_one_by_one(make):
    rnd = random.Random(11)
    for _ in range(3):
        texts = _texts(rnd, 40)
        nodes = [(f"n{i}", i, t) for i, t in enumerate(texts[:6])]
        frags = [(f"f{i}", 100 + i, t) for i, t in enumerate(texts[6:])]
        schema = "id string, ord long, text string"
        got = c.fold_assignments(c.embed(make(frags, schema)), c.embed(make(nodes, schema)), 0.8)
        want = brute.fold([(i, t) for i, _, t in nodes], [(i, t) for i, _, t in frags], 0.8)
        assert {r["id"]: (r["action"], r["target"]) for r in got.collect()} == want


def test_similarity_edges_with_many_copies(make):
    texts = ["a b c"] * 15 + ["a b d", "x y z", "a b c d"] + ["a b c"] * 3
    df = make([(f"r{i:02d}", i, t) for i, t in enumerate(texts)], "id string, ord long, text string")
    got = rows(c.similarity_edges(c.embed(df), None, 0.5, 4), "src", "rank", "dst")
    vecs = [brute.hashed(t) for t in texts]
    want = []
    for i in range(len(texts)):
        near = sorted((-brute.dot(vecs[i], vecs[j]), j) for j in range(i)
                      if brute.dot(vecs[i], vecs[j]) >= 0.5)[:4]
        want += [(f"r{i:02d}", k + 1, f"r{j:02d}") for k, (_, j) in enumerate(near)]
    assert got == sorted(want)


def test_nearest_first_on_ties_and_null_below(make):
    nodes = make([("n0", 0, "a b"), ("n1", 1, "a b"), ("n2", 2, "q r s")],
                 "id string, ord long, text string")
    q = make([("x", 10, "a b"), ("y", 11, "zzz"), ("z", 12, "a b")], nodes.schema)
    got = rows(c.nearest(c.embed(q), c.embed(nodes), 0.5), "id", "node")
    assert got == [("x", "n0"), ("y", None), ("z", "n0")]


def test_suffixes_skip_taken_numbers(make):
    taken = make([("fix",), ("fix-2",), ("fix-4",), ("other-2",), ("fix--cell",)], "id string")
    new = make([(i, n) for i, n in enumerate(["Fix", "fix!", "FIX", "Other", "other", "new"])],
               "ord long, name string")
    got = [r["new_id"] for r in c.suffixed_ids(new, taken).orderBy("ord").collect()]
    assert got == ["fix-3", "fix-5", "fix-6", "other", "other-3", "new"]


def _edits(make, data):
    patches = [(i, f"t{i}", "qa", [{"file": "F.md", "target_section": s, "after_section": "",
                                    "content": b}]) for i, (s, b) in enumerate(data)]
    return c.patch_edits(make(patches, (
        "patch long, task_id string, task_type string, edits array<struct<file:string,"
        "target_section:string,after_section:string,content:string>>")))


def test_two_edits_of_a_section_make_one_record(make):
    e = _edits(make, [("## Date Normalization", "normalize dates"),
                      ("Date Normalization", "more date rules")])
    out = c.absorb_edits(e, make([], NODE))
    assert rows(out["nodes"], "id") == [("date_normalization",)]
    assert rows(out["evidence"], "id", "task_id") == [("date_normalization", "t0"),
                                                      ("date_normalization", "t1")]


def test_absorbing_matches_one_by_one(make):
    rnd = random.Random(21)
    names = ["alpha", "beta", "gamma", "delta one", "delta two"]
    for _ in range(3):
        data = [(rnd.choice(names), t) for t in _texts(rnd, 30)]
        e = _edits(make, data)
        known = [("n0", "w1 w2 w3 w4"), ("beta", "beta. beta something")]
        sk = make([(i, n, "", "", t, "deployed") for n, (i, t) in enumerate(known)], NODE)
        got = dict(rows(c.absorb_edits(e, sk, 0.7)["assigned"], "seq", "id"))
        order = [tuple(r) for r in e.select("seq", "name", "slug", "body").orderBy("seq").collect()]
        node_text = [(i, f". {t}") for i, t in known]
        assert got == brute.absorb(node_text, order, 0.7)


def test_fold_fragments_rules_and_lists(make):
    sk = make([("a", 0, "a", "", "one two three", "deployed"),
               ("old", 1, "old", "", "four five six", "retired")], NODE)
    fr = make([("f0", 10, "a", "", "one two three", ["t1"], ["e1"]),
               ("f1", 11, "New One", "d", "seven eight nine", ["t2"], ["e2"]),
               ("f2", 12, "old", "", "four five six", [], ["e3"])],
              "frag string, ord long, name string, description string, body string, "
              "task_types array<string>, evidence array<string>")
    out = c.fold_fragments(fr, sk, 4)
    assert rows(out["inserted"], "id") == [("new_one",), ("old-2",)]
    assert rows(out["merged"], "frag", "id", "sim") == [("f0", "a", 1.0)]
    assert rows(out["rules"], "id") == [("insert_new_one_4",), ("insert_old_2_4",), ("merge_a_4_1",)]
    assert rows(out["evidence"]) == [("a", "e1"), ("new_one", "e2"), ("old-2", "e3")]


COUNTED = NODE + (", task_types array<string>, token_cost long, success_count long, "
                  "failure_count long, n_visit long, coverage long, last_used_step long")


def counted(i, status="deployed", ok=0, bad=0, visits=0, last=-1, body="x", types=()):
    return (i, ord(i[0]), i, "", body, status, list(types), 0, ok, bad, visits, 0, last)


def test_retire_only_the_low_value_record(make):
    sk = make([counted("good", ok=9, bad=1), counted("bad", ok=1, bad=9)], COUNTED)
    assert rows(lc.low_value(sk, 5, 999.0), "id") == [("bad",)]


def test_promote_then_block(make):
    sk = make([counted("s", "validated")], COUNTED)
    up = lc.promote(sk, 1)
    assert rows(up, "status") == [("deployed",)]
    failing = make([counted("s", ok=0, bad=5)], COUNTED)
    assert rows(lc.chronic_failers(failing, make([], "id string"), 2, 0.5), "id") == [("s",)]
    assert rows(lc.block_rules(failing, 7, 0.5), "id", "edge_type") == [
        ("block_s_7", "blocks_routing")]


def test_heat_decays(make):
    from ropewalk.functions import skill_heat
    sk = make([counted("s", visits=3, last=0)], COUNTED)
    hot, cool = sk.select(skill_heat(F.lit(0)), skill_heat(F.lit(1000))).first()
    assert hot > cool and abs(hot - 4.0) < 1e-9


def test_checkpoints_are_minted_once(make):
    sk = make([counted("good", ok=5), counted("bad", ok=1, bad=4)], COUNTED)
    none = make([], "id string")
    minted = lc.mint_checkpoints(sk, none, 2)
    assert rows(minted, "id", "target") == [("checkpoint_bad_2", "bad")]
    assert "(succ 0.20 over 5 trials)" in minted.first()["statement"]
    again = lc.mint_checkpoints(sk, minted.select(F.col("target").alias("id")), 3)
    assert again.count() == 0


def test_rate_of_a_checkpoint_is_rounded_as_it_is_stored(make):
    """23/40 is below 0.575 as a double."""
    sk = make([counted("a", ok=23, bad=17), counted("b", ok=11, bad=9)], COUNTED)
    minted = lc.mint_checkpoints(sk, make([], "id string"), 2)
    assert [s.split("(")[1][:9] for _, s in rows(minted, "id", "statement")] == ["succ 0.57", "succ 0.55"]


def test_should_split(make):
    sk = make([counted("big", body="word " * 3000, types=["a", "b", "c"]),
               counted("small", body="short", types=["a"])], COUNTED)
    assert rows(lc.should_split(sk), "id") == [("big",)]


def test_deploy_cap_demotes_lowest_utility(make):
    sk = make([counted(x, ok=i % 3, bad=1, visits=i % 3) for i, x in enumerate("abcdef")], COUNTED)
    assert len(rows(lc.deploy_cap(sk, 4, 10))) == 2
    assert rows(lc.deploy_cap(sk, 4, 10), "id") == [("a",), ("d",)]
    assert rows(lc.promote(sk, 10, cap=6).filter("status <> 'deployed'")) == []


def test_curate_round_with_all_stages(make):
    body = "long text " * 80
    sk = make([counted("wide", ok=1, bad=4, body=body, types=["a", "b"]),
               counted("thin", ok=1, bad=4, body="thin thing")], COUNTED)
    fr = make([("f0", 500, "wide", "", body, ["c"], ["e0"]),
               ("f1", 501, "Fresh", "d", "entirely new words here", ["a"], ["e1"])],
              "frag string, ord long, name string, description string, body string, "
              "task_types array<string>, evidence array<string>")
    none = make([], "id string")
    edges = make([], "src string, dst string, type string")
    score = make([(0.5, 0.4)], "val double, baseline double")
    out = curate.curate_round(sk, edges, none, fr, score, 3, 2)
    h = out["history"].first().asDict()
    assert h == {"round": 2, "inserted": 1, "merged": 1, "split": 1, "accepted": True, "val": 0.5,
                 "deployed": 3, "retired_total": 0, "checkpoints": 2}
    got = {r["id"]: r["status"] for r in out["skills"].collect()}
    assert got == {"wide": "deployed", "thin": "deployed", "fresh": "deployed",
                   "wide--a": "candidate", "wide--b": "candidate", "wide--c": "candidate"}
    low = make([(0.4, 0.4)], "val double, baseline double")
    lost = curate.curate_round(sk, edges, none, fr, low, 3, 2, do_split=False)
    assert lost["history"].first()["accepted"] is False
    assert rows(lost["skills"].filter("id = 'fresh'"), "status") == [("retired",)]


def test_navlog_note_becomes_a_record(make):
    nav = make([("i1", 0, "locate", "a", "t", ""), ("i1", 1, "go_off_graph", None, None, "regen proto"),
                ("i1", 2, "go_off_graph", None, None, "  ")],
               "instance string, pos long, action string, cursor string, task string, note string")
    sk = make([("a", 0, "a", "", "x", "deployed")], NODE)
    fr = make([("i1", "regen proto", 10, "regen proto", "d", "HOWTO", []),
               ("i1", "  ", 11, "blank", "d", "HOWTO two", [])],
              "instance string, note string, ord long, name string, description string, "
              "body string, task_types array<string>")
    out = curate.navlog_curation(nav, make([("i1", False)], "instance string, success boolean"),
                                 fr, sk, 1)
    assert rows(out["inserted"], "id") == [("regen_proto",)]
    assert tuple(out["summary"].first()) == (1, 1, 1)
    assert rows(out["credit"]) == [("a", 0, 1)]


def test_nearest_ignores_equal_ords_of_different_tables(make):
    from ropewalk.operators.curation import embed, nearest

    q = embed(make([("q", 0, "red fox")], "id string, ord long, text string"))
    n = embed(make([("a", 0, "red fox"), ("b", 1, "blue cat")], "id string, ord long, text string"))
    assert [(r.id, r.node) for r in nearest(q, n, 0.5).collect()] == [("q", "a")]


def test_split_gives_every_child_an_id_of_its_own(make):
    from ropewalk.operators.curation import propose_children, split

    cols = "id string, ord long, name string, description string, body string, task_types array<string>"
    skills = make([(f"s{i}", i, "P", "d", "one\n\ntwo", ["t1", "t2"]) for i in range(3)]
                  + [("p_for_t1_s1", 9, "x", "d", "b", ["t1"])], cols)
    kids = split(skills, propose_children(skills.filter("ord < 3")), 1)["children"].orderBy("ord").collect()
    assert [k.parent for k in kids] == ["s0", "s0", "s1", "s1", "s2", "s2"]
    assert [k.id for k in kids] == ["p_for_t1", "p_for_t2", "p_for_t1_s1-2", "p_for_t2_s1", "p_for_t1_s2", "p_for_t2_s2"]


def test_absorbing_looks_at_first_edits_only(make, monkeypatch):
    """Once a slug has a record its later edits ask for nothing, and only edits that went elsewhere search for a target."""
    monkeypatch.setattr(c, "FRONT", 2)
    asked, ask, similar = [], c.EarlierPartners._ask, c.similar
    monkeypatch.setattr(c.EarlierPartners, "_ask", lambda self, a, t: (asked.append(a.count()), ask(self, a, t))[1])
    searched = []
    monkeypatch.setattr(c, "similar", lambda left, *a, **kw: (searched.append((kw.get("first"), left.count())), similar(left, *a, **kw))[1])
    data = [("alpha", f"a{i} b{i} c{i}") for i in range(12)]
    # the edits of a slug that stays near another record until its fourth one, and copies of the third later on
    data += [("beta", "a0 b0 c0 a0 b0 c0"), ("beta", "a0 b0 c0 a0 b0"), ("beta", "a0 b0 c0 c0"), ("beta", "q r s"), ("beta", "a0 b0 c0 c0")]
    known = [("n0", "a0 b0 c0 a0 b0 c0 a0 b0 c0")]
    nodes = make([(i, n, i, "", t, "deployed") for n, (i, t) in enumerate(known)], NODE)
    out = c.absorb_edits(_edits(make, data), nodes)
    got = {r["seq"] >> 20: r["id"] for r in out["assigned"].collect()}
    assert got == {**{i: "alpha" for i in range(1, 12)}, 0: got[0], 12: "n0", 13: "n0", 14: "n0", 15: "beta", 16: "beta"}
    assert asked == [4, 2] and [n for first, n in searched if first is None] == [3 + (got[0] == "n0"), 0]
