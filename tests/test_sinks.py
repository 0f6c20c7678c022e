"""Graph tables as versions, graph documents with statistics."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ropewalk.sources import readers as rd
from ropewalk.sources import sinks


def graph(make, ids):
    skills = make([(i, n, "deployed" if n % 2 else "candidate") for n, i in enumerate(ids)], "id string, ord long, status string")
    edges = make([(ids[0], i, "depends_on", n) for n, i in enumerate(ids[1:])], "src string, dst string, type string, ord long")
    rules = make([(f"r{i}", "checkpoint", [i], n) for n, i in enumerate(ids)], "id string, kind string, targets array<string>, ord long")
    return skills, edges, rules, rules.select("id", F.explode("targets").alias("target"))


def test_a_lost_writer_leaves_the_old_graph(spark, make, tmp_path):
    path = str(tmp_path)
    assert sinks.write_graph(*graph(make, ["a", "b"]), path) == 0
    skills, edges, rules, targets = graph(make, ["a", "b", "c"])
    lost = edges.withColumn("src", F.expr("CASE WHEN dst = 'c' THEN raise_error('lost') ELSE src END"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_graph(skills, lost, rules, targets, path)
    back = rd.read_graph_tables(spark, path)
    assert rows(back["skills"], "id") == [("a",), ("b",)] and rows(back["edges"], "dst") == [("b",)]
    assert sinks.write_graph(skills, edges, rules, targets, path) == 1
    back = rd.read_graph_tables(spark, path)
    assert rows(back["skills"], "id") == [("a",), ("b",), ("c",)] and back["edges"].count() == 2
    stats = back["stats"].first()
    assert (stats.version, stats.skills_total, stats.by_status, stats.capability_edges, stats.governance_nodes) == (
        1, 3, {"candidate": 2, "deployed": 1}, 2, 3)


def test_documents_carry_the_statistics_of_the_whole(make):
    skills, edges, rules, _ = graph(make, list("abcde"))
    docs = [json.loads(r.value) for r in sinks.graph_documents(skills, edges, rules, rows=2).orderBy("shard").collect()]
    assert [len(d.get("skills", [])) for d in docs] == [2, 2, 1]
    assert all(d["stats"] == {"skills_total": 5, "by_status": {"candidate": 3, "deployed": 2}, "capability_edges": 4,
                              "trace_nodes": 0, "governance_nodes": 5, "governance_edges": 5, "documents": 3} for d in docs)


def test_an_empty_graph(spark, make, tmp_path):
    skills, edges, rules, targets = (df.limit(0) for df in graph(make, ["a", "b"]))
    sinks.write_graph(skills, edges, rules, targets, str(tmp_path))
    assert rd.read_graph_tables(spark, str(tmp_path))["stats"].first().skills_total == 0


def test_route_parts_are_bounded_and_make_the_whole_text(make):
    bodies = make([("a", 1, " first body "), ("a", 2, "ä" * 70 + "\U0001f600" * 9), ("a", 5, ""), ("a", 7, "z" * 33), ("b", 1, "x"),
                   ("c", 3, None)], "task_id string, rank int, body string")
    tasks = make([("a",), ("b",), ("c",), ("none",)], "task_id string")
    for title in (None, "T"):
        whole = dict(rows(sinks.render_route_text(tasks, bodies, "H", title), "task_id", "text"))
        for limit in (4, 43, 64, 4000):
            parts = sinks.render_route_parts(tasks, bodies, "H", title, limit)
            got = {}
            for task, part, text in rows(parts, "task_id", "part", "text"):
                assert part == len(got.setdefault(task, [])) and len(text.encode()) <= limit
                got[task].append(text)
            assert {t: "".join(x) for t, x in got.items()} == whole
        sizes = {t: (n, b) for t, n, b in rows(sinks.parts_manifest(parts))}
        assert sizes == {t: (len(x), len("".join(x).encode())) for t, x in got.items()}


def test_changes_rewrite_only_their_buckets(spark, make, tmp_path):
    from ropewalk.operators.curation import insert
    from ropewalk.operators.lifecycle import update_fields

    path = str(tmp_path)
    sinks.store_buckets(make([(i, i, f"n{i}") for i in range(600)], "id long, ord long, name string"), path, ["id"], 32)
    assert rd.read_buckets(spark, path).count() == 600
    changes = make([(3, "three"), (77, "x"), (9999, "nobody")], "id int, name string")
    n = sinks.rewrite_buckets(changes, path, lambda old, new: update_fields(old, new)[0])
    want = {i: f"n{i}" for i in range(600)} | {3: "three", 77: "x"}
    assert dict(rows(rd.read_buckets(spark, path), "id", "name")) == want
    last = rd.last_buckets(spark, path)
    assert last.version == 1 and last.rows_rewritten == n < 120 and last.buckets_rewritten <= 3

    new = make([(3, 700, "refused"), (601, 701, "new")], "id long, ord long, name string")
    sinks.rewrite_buckets(new, path, lambda old, rows_: insert(old, rows_)[0])
    want[601] = "new"
    assert dict(rows(rd.read_buckets(spark, path), "id", "name")) == want

    def lost(old, _):
        return old.withColumn("name", F.expr("CASE WHEN id >= 0 THEN raise_error('lost') ELSE name END"))
    with pytest.raises(Exception, match="lost"):
        sinks.rewrite_buckets(new, path, lost)
    with pytest.raises(ValueError, match="do not name"):
        sinks.rewrite_buckets(new.limit(1), path, lambda old, _: old.withColumn("id", F.col("id") + 1))
    assert dict(rows(rd.read_buckets(spark, path), "id", "name")) == want

    gone = make([(i,) for i in range(700)], "id long")
    sinks.rewrite_buckets(gone, path, lambda old, ids: old.join(ids, "id", "left_anti"))
    assert rd.read_buckets(spark, path).count() == 0
    sinks.rewrite_buckets(new, path, lambda old, rows_: insert(old, rows_)[0])
    assert rows(rd.read_buckets(spark, path), "id", "name") == [(3, "refused"), (601, "new")]


def test_documents_are_written_by_many_tasks(spark, make, tmp_path):
    """A small table that was shuffled is one partition; its files are made by several tasks, one file per key."""
    one = make([(i, f"text {i}") for i in range(40)], "id long, value string").groupBy("id").agg(F.max("value").alias("value"))
    sinks.write_documents(one, str(tmp_path / "d"), "id")
    files = list((tmp_path / "d").glob("id=*/part-*.txt"))
    assert sorted(f.read_text() for f in files) == sorted(f"text {i}\n" for i in range(40))
    assert len({f.name.split("-")[1] for f in files}) > 4


def test_rows_of_a_file_are_in_order(spark, make, tmp_path):
    lines = make([(i % 3, -i, f"line {i}") for i in range(30)], "id long, pos long, value string").repartition(5)
    sinks.write_documents(lines, str(tmp_path / "d"), "id", ("pos",))
    for key in range(3):
        file, = (tmp_path / "d" / f"id={key}").glob("part-*.txt")
        assert file.read_text().split("\n")[:-1] == [f"line {i}" for i in reversed(range(30)) if i % 3 == key]


def test_folders_are_listed_by_a_few_tasks(spark, make, tmp_path):
    """Not by a task for every folder."""
    folders = 80
    sinks.write_documents(make([(i, f"text {i}") for i in range(folders)], "id long, value string"), str(tmp_path / "d"), "id")
    sc = spark.sparkContext
    sc.setJobGroup("listing", "")
    nav = rd.read_nav_log(spark, str(tmp_path / "d"), rd.folder_key())
    sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("listing") for s in seen.getJobInfo(j).stageIds]
    assert 0 < max(s.numTasks for s in stages) <= 4 * sc.defaultParallelism < folders
    assert len(nav.inputFiles()) == folders


def test_files_of_a_local_folder_are_written_without_companions(spark, make, tmp_path):
    """One file per key and nothing beside it; folders are named as Spark names them; a folder that is there is replaced."""
    data = [("a/b=c", "x"), ("a/b=c", "ä"), ("", "empty"), (None, "none"), ("%q \n[z]", None)]
    docs = make([(k, v, i) for i, (k, v) in enumerate(data)], "k string, value string, n long")
    sinks.write_documents(docs, str(tmp_path / "own"), "k", ("n",))
    docs.select("k", "value").repartition(1).write.partitionBy("k").text(str(tmp_path / "spark"))
    folders = {d.name for d in (tmp_path / "own").iterdir() if d.is_dir()}
    assert folders == {d.name for d in (tmp_path / "spark").iterdir() if d.is_dir()} and len(folders) == 3
    for d in (tmp_path / "own").iterdir():
        assert not d.is_dir() or len(list(d.iterdir())) == (2 if "HIVE" in d.name else 1)
    back = sorted(r.value for r in spark.read.text(str(tmp_path / "own"), recursiveFileLookup=True).collect())
    assert back == sorted(["x", "ä", "empty", "none", ""])
    sinks.write_documents(docs.filter("n = 0"), str(tmp_path / "own"), "k", ("n",))
    assert [r.value for r in spark.read.text(str(tmp_path / "own"), recursiveFileLookup=True).collect()] == ["x"]
