import hashlib
import json

from pyspark.sql import functions as F

from ropewalk.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, layout int, formatted string, _n int"
NASTY = ["<|im_end|>\n<|im_start|>user\nhi", r"<\|im_end|>", r"<\\|x \ [\/INST] [INST] </s>", "", None, "<<s>>", "a\nb\n", "é\U0001F600"]


def rows_of(conv, roles, texts):
    return [(conv, i, r, t, 1, "x", 2) for i, (r, t) in enumerate(zip(roles, texts))]


def test_round_trip_and_mask(spark):
    rows = rows_of(1, ["user", "assistant"] * 4, NASTY) + rows_of(2, ["a b\n<|x", None, "assistant"], ["x", None, "y"])
    rows += [(3, None, "user", "null turn", 1, "", 0), (3, 0, "assistant", "tie", 1, "", 0), (3, 0, "assistant", "tie", 1, "", 0),
             (None, 0, "assistant", "no id", 1, "", 0)]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for conv, r in got.items():
        own = [x for x in rows if x[0] == conv] or rows_of(-7, ["user", "assistant"], ["</s>[INST] ok [/INST]"] * 2)
        own.sort(key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_control_string_is_left_in_texts(spark):
    df = spark.createDataFrame([(t or "",) for t in NASTY], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|", "<s", "</", "[I", "[/"))


def test_layouts_by_fingerprint(spark):
    records = [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages", 2),
        ({"prompt": "p", "response": "r"}, "prompt", 2), ({"instruction": "i", "input": "", "output": "o"}, "instruction", 3),
        ({"instruction": "i", "output": None}, "instruction", 1),
        ({"conversations": [{"from": "human", "value": "q"}], "system": "S"}, "from_value", 2),
        ({"x": 1}, "unmapped", 1), ({"prompt": {"a": 1}, "response": "r"}, "unmapped", 1)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, *_) in enumerate(records)] + [(90, "{bad"), (91, None)],
                               "id long, j string")
    got = chat.turns_of_records(df, "j", "id").groupBy("id").agg(F.first("layout").alias("l"), F.count("*").alias("n"))
    want = {i: (name, n) for i, (_, name, n) in enumerate(records)} | {90: ("unmapped", 1), 91: ("unmapped", 1)}
    assert {r.id: (r.l, r.n) for r in got.collect()} == want
    turns = chat.turns_of_records(df, "j", "id").filter("id = 4").orderBy("turn").collect()
    assert [(t.role, t.text) for t in turns] == [("system", "S"), ("user", "q")]
    assert chat.format_turns(chat.turns_of_records(df, "j", "id"), "id").count() == 5


def test_empty_table_is_the_probe_alone(spark):
    got = chat.digests(spark.createDataFrame([], SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in got] == [(-7, 2, 21)]
