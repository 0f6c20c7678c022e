import random

import pyarrow as pa

from conftest import rows
from ropewalk.operators import containment, curation as c
from test_curation import NODE, _edits


def brute(parts):
    gone = set()
    for i, s, b in parts:
        if any(j == i and t < s and b in x for j, t, x in parts):
            gone.add((i, s))
    return sorted((i, s, b) for i, s, b in parts if (i, s) not in gone)


def test_contained_texts(make):
    rnd = random.Random(3)
    texts = ["", "a", "ab", "é", "日本", "x" * 23, "x" * 60, "the quick brown fox jumps over the lazy dog"]
    for _ in range(400):
        t = rnd.choice(texts)
        how = rnd.random()
        if how < 0.4 and len(t) > 1:
            a, b = sorted(rnd.sample(range(len(t) + 1), 2))
            t = t[a:b]
        elif how < 0.8:
            t = t[:300] + rnd.choice([" ", "\n\n", ""]) + "".join(rnd.choices("abé日 ", k=rnd.randint(1, 40)))
        texts.append(t)
    parts = [(rnd.choice("pppq"), n, t) for n, t in enumerate(rnd.sample(texts, len(texts)))]
    got = rows(containment.uncontained(make(parts, "id string, seq long, body string")))
    assert got == brute(parts) and 30 < len(got) < len(parts) - 30


def test_no_texts(make):
    assert containment.uncontained(make([], "id string, seq long, body string")).count() == 0


def test_contained_bodies_are_not_appended_and_large_records_split(make):
    long = "word " * 130
    e = _edits(make, [("S", f"{long}first\n\nsecond paragraph"), ("S", "first"), ("S", f"{long}third"), ("S", "second paragraph"),
                      ("S", f"{long}fourth"), ("S", "tail"), ("T", "small")])
    types = ["a", "b", "a", "c", "b", "c", "a"]
    e = make([(r.seq, r.task_id, types[n], r.name, r.body, r.slug) for n, r in enumerate(e.orderBy("seq").collect())],
             "seq long, task_id string, task_type string, name string, body string, slug string")
    sk = make([("s", 0, "S", "about s", f"{long}seed with tail inside", "deployed")], NODE)
    out = c.absorb_patches(e, sk, 7)
    assert [b[:5] + b[-5:] for _, b in rows(out["bodies"], "seq", "body") if b != "small"] == ["word graph", "word third", "word ourth"]
    kids = sorted(out["children"].select("child_no", "id", "name", "body", "child_type").collect())
    assert [(k.id, k.child_type) for k in kids] == [("s_for_a", "a"), ("s_for_b", "b"), ("s_for_c", "c")]
    assert [k.body.split()[-1] for k in kids] == ["inside", "first", "paragraph"]
    assert {r[0] for r in rows(out["parents"], "parent")} == {"s"}
    assert len(rows(out["child_evidence"])) == 3 * len([x for x in rows(out["evidence"], "id", "task_id") if x[0] == "s"])


def test_anchors_leave_a_task_in_bounded_pieces():
    """Every byte of a text may be an anchor: those of a whole batch of texts are never held at once."""
    rnd = random.Random(7)
    bodies = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(800)) for _ in range(1000)] + [None, ""]
    sizes = [None if b is None else len(b.encode()) for b in bodies]
    batch = pa.RecordBatch.from_arrays([pa.array(["r"] * len(bodies)), pa.array(range(len(bodies)), pa.int64()),
                                        pa.array(sizes, pa.int64()), pa.array(bodies)], ["id", "seq", "size", "body"])
    out = list(containment.list_anchors(iter([batch]), 3, 1))
    assert max(b.num_rows for b in out) <= containment.PIECE < sum(b.num_rows for b in out)
    got = sorted((s, g) for b in out for s, g in zip(b.column("seq").to_pylist(), b.column("gram").to_pylist()))
    assert got == sorted((i, g) for i, b in enumerate(bodies) for g in containment.anchors((b or "").encode(), 3, 1).tolist())
