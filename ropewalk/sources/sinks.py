"""Writers: graph tables, document shards, rendered texts."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scoring import success_rate
from ..operators.ordered import prefix, row_index
from ..operators.routing import layer_of
from .readers import last_buckets, read_buckets


def graph_stats(skills: DataFrame, edges: DataFrame, rules: DataFrame, targets: DataFrame,
                traces: DataFrame | None = None) -> DataFrame:
    """One row: totals of the graph, records by status as a map."""
    status = skills.groupBy("status").agg(F.count("*").alias("n"))
    out = status.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("skills_total"),
                     F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    for name, df in (("capability_edges", edges), ("trace_nodes", traces), ("governance_nodes", rules),
                     ("governance_edges", targets)):
        n = F.lit(0).cast("long").alias(name)
        out = out.select("*", n) if df is None else out.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))  # one row
    return out


def write_graph(skills: DataFrame, edges: DataFrame, rules: DataFrame, targets: DataFrame,
                path: str) -> int:
    """Lossless Parquet tables as a new version; skills by status and edges by layer, the columns that get
    filtered. Returns the version's number.

    Tables go to a folder of their own, and the row in ``versions`` that names it, with the graph's statistics, is written last.
    Readers take the last row, so a writer that is lost half way leaves the graph as it was, never tables of two versions.
    Older folders stay until their owner removes them.
    """
    spark = skills.sparkSession
    folder = f"graph-{uuid.uuid4().hex}"
    tables = {"skills": (skills, ["status"]), "edges": (edges.withColumn("layer", layer_of("type")), ["layer"]),
              "rules": (rules, []), "rule_targets": (targets, [])}
    for name, (df, parts) in tables.items():
        df.write.partitionBy(*parts).parquet(f"{path}/{folder}/{name}")
    try:
        number = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0] + 1
    except AnalysisException:  # the first version
        number = 0
    # an empty table leaves no file to read a schema from
    schemas = {name: df.schema.json() for name, (df, _) in tables.items()}
    stored = [spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}") for name, (df, _) in tables.items()]
    graph_stats(*stored).select(
        F.lit(number).alias("version"), F.lit(folder).alias("folder"), "*",
        F.create_map(*[F.lit(x) for pair in schemas.items() for x in pair]).alias("schemas")).coalesce(1).write.mode(
        "append").parquet(f"{path}/versions")
    return number


def _shards(df: DataFrame, order: str, name: str, rows: int, value: Column) -> DataFrame:
    """(shard, name): arrays of at most ``rows`` structs each."""
    at = row_index(df, [], order, "_at")
    shard = F.floor(F.col("_at") / F.lit(rows)).cast("long")
    def by_order(a, b):  # values may hold maps, which have no order of their own
        return (a["_o"] - b["_o"]).cast("int")

    return at.groupBy(shard.alias("shard")).agg(F.array_sort(F.collect_list(F.struct(
        (F.col("_at") % F.lit(rows)).alias("_o"), value.alias("_v"))), by_order)
        .alias("_l")).select("shard", F.transform("_l", lambda e: e["_v"]).alias(name))


def graph_documents(skills: DataFrame, edges: DataFrame, rules: DataFrame,
                    rows: int = 1000) -> DataFrame:
    """(shard, value): graph documents of at most ``rows`` records, edges and rules each; together they are the graph.

    Each input has a unique integer ``ord``. Every document carries the statistics of the whole graph and the number of
    documents as ``stats``, so a consumer of one of them knows what it lacks; the reader takes a folder of them. Raise ``rows``
    for a graph that must be a single document.
    """
    def body(df):
        return F.struct(*[c for c in df.columns if c != "ord"])

    s = _shards(skills, "ord", "skills", rows, body(skills))
    e = _shards(edges, "ord", "capability_edges", rows, body(edges))
    r = _shards(rules, "ord", "governance", rows, body(rules))
    both = s.join(e, "shard", "full").join(r, "shard", "full")
    targets = rules.select(F.explode("targets")) if "targets" in rules.columns else rules.limit(0)
    most = F.greatest(*[F.col(c) for c in ("skills_total", "capability_edges", "governance_nodes")])
    stats = graph_stats(skills, edges, rules, targets).select(F.struct(
        "*", F.greatest(F.ceil(most / rows), F.lit(1)).cast("long").alias("documents")).alias("stats"))
    return both.crossJoin(F.broadcast(stats)).select(  # one row
        "shard", F.to_json(F.struct("skills", "capability_edges", "governance", "stats")).alias("value"))


def _local_folder(spark, path: str) -> str | None:
    """The folder ``path`` names in the file system of this machine, None in any other file system or if it is there already."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    elif not path.startswith("/") or not (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:"):
        return None
    return None if os.path.exists(path) else path


def _escaped(name: str | None) -> str:
    """A partition value as Spark writes it in the name of a folder."""
    if not name:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name)


def put_files(batches: Iterator[pa.RecordBatch], folder: str, key: str, task: int) -> Iterator[pa.RecordBatch]:
    """Write the lines of each run of equal keys to a file in the folder of that key; yields the number of files. A file gets its name
    when it is whole, and the same one in a task that is run again."""
    n, now, out, names = 0, None, None, None

    def close() -> None:
        if out is not None:
            out.close()
            os.replace(*names)

    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if out is None or k != now:
                close()
                home = f"{folder}/{_escaped(key)}={_escaped(k)}"
                os.makedirs(home, exist_ok=True)
                names = f"{home}/.part-{uuid.uuid4().hex}", f"{home}/part-{task:05d}-{n:07d}.txt"
                out, now, n = open(names[0], "wb"), k, n + 1
            out.write((v or "").encode() + b"\n")
    close()
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def write_documents(docs: DataFrame, path: str, key: str = "shard", order: tuple[str, ...] = ()) -> None:
    """One text file per key, in a folder of its own; its rows are in the order of the columns ``order``.

    Files are small and many: making them takes the time, not their bytes, by which a small table would go to one task. Tasks
    also put their files in place themselves, so that the driver does not move one after the other; the folder is whole once
    the call has returned. In a local or mounted file system they are written by the tasks' Python: Hadoop's local file system
    makes a checksum file beside each and starts a process for the mode of each of them. Any other file system, and a folder that is
    there already, get Spark's writer.
    """
    spark = docs.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = docs.select(key, "value", *order).repartition(tasks, key).sortWithinPartitions(key, *order)
    folder = _local_folder(spark, path)
    if folder is None:
        (rows.select(key, "value").write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy(key).text(path))
        return
    named = rows.select(F.col(key).cast("string").alias("_k"), "value")
    os.makedirs(folder)
    named.mapInArrow(lambda batches: put_files(batches, folder, key, TaskContext.get().partitionId()), "n long").agg(F.sum("n")).first()
    with open(f"{folder}/_SUCCESS", "wb"):
        pass


def chain_documents(nodes: DataFrame, edges: DataFrame, rows: int = 1000) -> DataFrame:
    """Chain-graph documents in the node-map format, in bounded shards."""
    n = _shards(nodes, "ord", "_n", rows, F.struct(*[c for c in nodes.columns if c != "ord"]))
    n = n.select("shard", F.map_from_entries(F.transform(
        "_n", lambda v: F.struct(v["id"], v))).alias("nodes"))
    e = _shards(edges, "ord", "edges", rows, F.struct(*[c for c in edges.columns if c != "ord"]))
    return n.join(e, "shard", "full").select(
        "shard", F.to_json(F.struct("nodes", "edges")).alias("value"))


def render_skill_docs(routes: DataFrame, skills: DataFrame) -> DataFrame:
    """(id, path, value): a skill document for every record some route uses."""
    used = skills.join(routes.select("id").distinct(), "id", "left_semi")
    sid = F.col("id").cast("string")
    bare = F.regexp_replace("body", r"(?U)^\s+|\s+$", "")
    # The frontmatter format of skill documents.
    return used.select("id", F.concat(sid, F.lit("/SKILL.md")).alias("path"), F.concat(
        F.lit("---\nname: "), sid, F.lit("\ndescription: "), F.col("description"),
        F.lit("\n---\n\n"), bare, F.lit("\n")).alias("value"))


def render_route_text(tasks: DataFrame, bodies: DataFrame,
                      header: str = "RELEVANT SKILL MODULES (routed for this task)",
                      title: str | None = None) -> DataFrame:
    """(task_id, text): one block per task from ``bodies(task_id, rank, body)``; "" if empty.

    A route is short by construction, so its bodies fit one value.
    """
    bare = F.regexp_replace("body", r"(?U)^\s+|\s+$", "")
    blocks = bodies.groupBy("task_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", bare.alias("b")))), lambda e: e["b"]),
        "\n\n").alias("_t"))
    text = F.concat(F.lit(f"## {header}\n\n"), F.col("_t"))
    if title is not None:
        text = F.concat(F.lit(f"# {title}\n\n"), text, F.lit("\n"))
    return tasks.select("task_id").join(blocks, "task_id", "left").select(
        "task_id", F.coalesce(text, F.lit("")).alias("text"))


def render_route_parts(tasks: DataFrame, bodies: DataFrame,
                       header: str = "RELEVANT SKILL MODULES (routed for this task)",
                       title: str | None = None, limit: int = 1 << 20) -> DataFrame:
    """(task_id, part, text): the text of ``render_route_text`` in parts of at most ``limit`` bytes, from 0 upwards.

    A part holds ``limit / 4`` code points, which is within the bound whatever the letters, so no character is cut and parts
    joined in order are the whole text. Where a body begins follows from a running sum of lengths; bodies that cross
    a border are sliced there, so neither a task nor the one body has to fit a value. An empty route is one empty part.
    """
    if limit < 4:
        raise ValueError("a part must hold one code point")
    width = limit // 4
    head = ("" if title is None else f"# {title}\n\n") + f"## {header}\n\n"
    bare = bodies.select("task_id", "rank", F.regexp_replace("body", r"(?U)^\s+|\s+$", "").alias("_b"))
    sizes = bare.filter(F.col("_b").isNotNull()).select("task_id", "rank", F.length("_b").cast("long").alias("_n"))
    before = prefix(sizes, ["task_id"], "rank", {"_c": ("sum", F.lit(1).cast("long")), "_l": ("sum", "_n")})
    gap = F.when(F.col("_c") == 0, "").otherwise("\n\n")
    blocks = bare.join(before, ["task_id", "rank"]).select(
        "task_id", (F.lit(len(head)) + F.col("_l") + 2 * F.greatest(F.col("_c") - 1, F.lit(0))).alias("_at"),
        F.concat(gap, "_b").alias("_t"))
    whole = bodies.select("task_id").distinct().join(sizes.groupBy("task_id").agg(
        F.sum("_n").alias("_l"), F.count("*").alias("_c")), "task_id", "left")
    ends = [whole.select("task_id", F.lit(0).cast("long").alias("_at"), F.lit(head).alias("_t"))]
    if title is not None:
        ends.append(whole.select("task_id", (F.lit(len(head)) + F.coalesce("_l", F.lit(0)) + 2 * F.greatest(
            F.coalesce("_c", F.lit(0)) - 1, F.lit(0))).alias("_at"), F.lit("\n").alias("_t")))
    texts = reduce(DataFrame.unionByName, ends, blocks).filter(F.col("_t") != "")
    end = F.col("_at") + F.length("_t")
    cut = texts.select("*", F.explode(F.sequence(F.floor(F.col("_at") / width), F.floor((end - 1) / width))).alias("part"))
    lo = F.greatest(F.col("_at"), F.col("part") * width)
    hi = F.least(end, (F.col("part") + 1) * width)
    slices = cut.select("task_id", "part", lo.alias("_at"), F.substring(
        "_t", (lo - F.col("_at") + 1).cast("int"), (hi - lo).cast("int")).alias("_t"))
    parts = slices.groupBy("task_id", "part").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "_t"))), lambda e: e["_t"]), "").alias("text"))
    return tasks.select("task_id").join(parts, "task_id", "left").select(
        "task_id", F.coalesce("part", F.lit(0)).cast("long").alias("part"), F.coalesce("text", F.lit("")).alias("text"))


def parts_manifest(parts: DataFrame) -> DataFrame:
    """(task_id, n_parts, n_bytes): what a reader of the parts has to find."""
    return parts.groupBy("task_id").agg(F.count("*").alias("n_parts"), F.sum(F.octet_length("text")).alias("n_bytes"))


def render_chain_procedure(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(task_id, text): numbered steps with success share and run count, in path order."""
    n = nodes.select("id", "desc", "n_visit", F.round(F.lit(100) * success_rate(
        "n_success", F.col("n_visit") - F.col("n_success"))).cast("long").alias("_sr"))
    rows = paths.join(n, "id").groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.struct("avg_pos", "id", "desc", "_sr", "n_visit")))
        .alias("_l"))
    # The layout of a procedure line.
    lines = F.transform("_l", lambda e, i: F.concat(
        (i + 1).cast("string"), F.lit(". **"), F.translate(e["id"], "_", " "), F.lit("** — "),
        e["desc"], F.lit("  _("), e["_sr"].cast("string"), F.lit("% succ over "),
        e["n_visit"].cast("string"), F.lit(" runs)_")))
    return rows.select("task_id", F.concat(F.lit("## Procedure\n"), F.array_join(lines, "\n"))
                       .alias("text"))


# ---------------------------------------------------------------------------------- tables that change in part
def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _add_version(spark, path: str, number: int, folders: dict[int, str], keys: list[str], buckets: int,
                 schema: str, rewritten: int, touched: int) -> None:
    row = (number, folders, keys, buckets, schema, rewritten, touched)
    spark.createDataFrame([row], "version long, folders map<int,string>, keys array<string>, buckets int, schema string, "
                          "rows_rewritten long, buckets_rewritten long").coalesce(1).write.mode("append").parquet(f"{path}/versions")


def _write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int) -> tuple[str, dict[int, int]]:
    """Write ``df`` to a folder of its own; the folder and the rows per bucket (at most ``buckets`` numbers)."""
    folder = uuid.uuid4().hex
    df.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(
        f"{path}/folder={folder}")
    back = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("_bucket", IntegerType())])).parquet(
        f"{path}/folder={folder}")
    return folder, {r[0]: r[1] for r in back.groupBy("_bucket").count().collect()}


def store_buckets(df: DataFrame, path: str, keys: list[str], buckets: int = 256) -> None:
    """Store ``df`` as version 0 of a table in ``buckets`` parts by a hash of ``keys``, for ``rewrite_buckets``."""
    folder, sizes = _write_buckets(df, path, keys, buckets)
    _add_version(df.sparkSession, path, 0, {b: folder for b in sizes}, keys, buckets, df.schema.json(),
                 sum(sizes.values()), len(sizes))


def rewrite_buckets(changes: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Apply ``changes`` to a stored table and write only the buckets whose keys they name. Returns the number of rows written.

    ``merge(stored, changes)`` gets the stored rows of those buckets and returns what stands there afterwards; it may add, change and
    remove rows of the changes' keys (updates, ``insert``, ``link``). Untouched buckets stay in the folders of earlier versions.
    The new version counts once its row in ``versions`` is written, which comes last, so a lost writer changes nothing.
    """
    spark = changes.sparkSession
    now = last_buckets(spark, path)
    types = {f.name: f.dataType for f in read_buckets(spark, path).schema.fields}
    typed = changes.withColumns({k: F.col(k).cast(types[k]) for k in now.keys})  # the hash depends on the type
    touched = {r[0] for r in typed.select(_bucket(now.keys, now.buckets)).distinct().collect()}  # at most ``buckets``
    merged = merge(read_buckets(spark, path, touched), typed).select(*types)
    folder, sizes = _write_buckets(merged, path, now.keys, now.buckets)
    if not sizes.keys() <= touched:
        raise ValueError("merge returned rows of keys that the changes do not name")
    folders = {b: f for b, f in now.folders.items() if b not in touched} | {b: folder for b in sizes}
    _add_version(spark, path, now.version + 1, folders, now.keys, now.buckets, now.schema, sum(sizes.values()), len(touched))
    return sum(sizes.values())
