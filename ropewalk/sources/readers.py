"""Readers for the files that runs, evaluations and graph exports leave behind.

Every reader takes a path, a list of paths or a folder, fixes its schema, and returns DataFrames.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from ..functions.parsing import is_hard
from ..functions.text import strip
from ..schema import (CHAIN_DOCUMENT, EVAL_DOCUMENT, GRAPH_DOCUMENT, HISTORY, NAV_RECORD,
                      ROUTE_DUMP)
from ..session import listed_by_cores

_COUNTERS = ("success_count", "failure_count", "n_visit", "coverage", "token_cost")


def _json(spark: SparkSession, path, schema, multi: bool = True) -> DataFrame:
    with listed_by_cores(spark):
        return (spark.read.schema(schema).option("multiLine", multi)
                .option("recursiveFileLookup", True).json(path))


def _text(spark: SparkSession, path, **options) -> DataFrame:
    """Text files of a folder and the folders in it."""
    with listed_by_cores(spark):
        return spark.read.text(path, recursiveFileLookup=True, **options)


def read_graph(spark: SparkSession, path, compat: bool = False) -> dict[str, DataFrame]:
    """skills, edges and rules of graph documents. Edges keep only known ends.

    ``compat`` repeats what reading such a document loses: usage counters, evidence, and the type
    of blocking edges (every rule that is no checkpoint applies_to_skill).
    """
    doc = _json(spark, path, GRAPH_DOCUMENT)
    s = doc.select(F.inline("skills"))
    counters = [F.coalesce(F.col(f"heat.{c}"), F.lit(0)).alias(c) for c in _COUNTERS]
    used = F.coalesce(F.col("heat.last_used_step"), F.lit(-1))
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c)
             for c in ("parents", "dependencies", "conflicts", "task_types", "evidence_traces")]
    skills = s.select(
        "id", "name", F.coalesce("granularity", F.lit("atomic")).alias("granularity"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("status", F.lit("candidate")).alias("status"), *lists, *counters,
        used.alias("last_used_step"))
    if compat:
        skills = skills.select(
            *[c for c in skills.columns
              if c not in (*_COUNTERS, "last_used_step", "evidence_traces")],
            F.array().cast("array<string>").alias("evidence_traces"),
            *[F.lit(0).cast("long").alias(c) for c in _COUNTERS],
            F.lit(-1).cast("long").alias("last_used_step"))
    ids = skills.select("id")
    edges = (doc.select(F.inline("capability_edges"))
             .withColumn("weight", F.coalesce("weight", F.lit(1.0)))
             .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
             .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
             .select("src", "dst", "type", "weight"))
    rules = doc.select(F.inline("governance")).select(
        "id", "kind", "statement", F.coalesce("targets", F.array().cast("array<string>"))
        .alias("targets"), F.coalesce("postcondition", F.lit("")).alias("postcondition"),
        F.coalesce("max_retries", F.lit(2)).alias("max_retries"),
        F.coalesce("repair_hint", F.lit("")).alias("repair_hint"))
    kind = F.when(F.col("kind") == "checkpoint", "guards_skill")
    if not compat:
        kind = kind.when(F.col("kind") == "block_signal", "blocks_routing")
    targets = rules.select(F.col("id").alias("src"), F.explode("targets").alias("dst"),
                           kind.otherwise("applies_to_skill").alias("type"))
    return {"skills": skills, "edges": edges, "rules": rules, "rule_targets": targets}


def read_graph_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The last complete version that ``sinks.write_graph`` made, and its one-row ``stats``."""
    last = spark.read.parquet(f"{path}/versions").orderBy(F.desc("version")).limit(1)
    row = last.first()
    tables = {t: spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{path}/{row['folder']}/{t}")
              for t, schema in row["schemas"].items()}
    return {**tables, "stats": last.drop("folder", "schemas")}


def last_buckets(spark: SparkSession, path: str) -> Row:
    """The row of the last complete version of a table that ``sinks.store_buckets`` made."""
    return spark.read.parquet(f"{path}/versions").orderBy(F.desc("version")).first()


def read_buckets(spark: SparkSession, path: str, buckets: set[int] | None = None) -> DataFrame:
    """The last version of a table in buckets, or the rows of some of its buckets; each is read from the version that wrote it."""
    row = last_buckets(spark, path)
    schema = T.StructType.fromJson(json.loads(row.schema))
    parts = [f"{path}/folder={f}/_bucket={b}" for b, f in sorted(row.folders.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def read_chain_graph(spark: SparkSession, path) -> dict[str, DataFrame]:
    doc = _json(spark, path, CHAIN_DOCUMENT)
    nodes = doc.select(F.explode("nodes").alias("key", "v")).select(
        F.col("key").alias("id"), *[f"v.{c}" for c in (
            "desc", "n_visit", "n_success", "pos_sum", "pos_n", "task_types", "examples")])
    edges = doc.select(F.inline("edges")).select(
        "src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"),
        F.coalesce("count", F.lit(1)).alias("count"), F.coalesce("succ", F.lit(0)).alias("succ"))
    return {"nodes": nodes, "edges": edges}


def _file_stem(path: F.col):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def nav_records(lines: DataFrame) -> DataFrame:
    """Parse JSONL ``lines(value, instance)``; blank and malformed lines drop out."""
    rec = F.from_json(strip("value"), NAV_RECORD)
    return (lines.filter(F.length(strip("value")) > 0).select("instance", "line", rec.alias("r"))
            .filter(F.col("r.action").isNotNull())
            .select("instance", F.col("line").alias("pos"), "r.action", "r.cursor", "r.task",
                    F.coalesce("r.note", F.lit("")).alias("note")))


def folder_key(path=None):
    """Value of the last ``name=value`` folder, or its plain name, of the current input file."""
    folder = F.element_at(F.split(F.input_file_name() if path is None else path, "/"), -2)
    return F.regexp_replace(folder, "^[^=]*=", "")


def read_nav_log(spark: SparkSession, path, instance=None) -> DataFrame:
    """(instance, pos, action, cursor, task, note); the instance is the file name, or the given
    Column, such as ``folder_key()``.

    Text files are read in order within a split, and the increasing id orders splits of one file.
    """
    name = _file_stem(F.input_file_name()) if instance is None else instance
    lines = _text(spark, path).select("value", name.alias("instance"), F.monotonically_increasing_id().alias("line"))
    return nav_records(lines)


def nav_tasks(nav: DataFrame) -> DataFrame:
    """First non-empty task text of each run's locate records."""
    named = nav.filter((F.col("action") == "locate") & (F.length("task") > 0))
    return named.groupBy("instance").agg(F.min_by("task", "pos").alias("task"))


def _conversation_text(messages: F.col) -> F.col:
    """ "[role] content" lines; list content is joined by spaces, text parts by their text."""
    def content(raw):
        parts = F.from_json(raw, "array<string>")
        joined = F.array_join(F.transform(parts, lambda p: F.coalesce(
            F.get_json_object(p, "$.text"), p)), " ")
        return F.when(F.startswith(raw, F.lit("[")) & parts.isNotNull(), joined).otherwise(raw)

    return F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit("["), F.coalesce(m["role"], F.lit("None")), F.lit("] "),
        F.coalesce(content(m["content"]), F.lit("None")))), "\n")


def read_trajectories(spark: SparkSession, path) -> DataFrame:
    """(run, trace) from one conversation.json per run folder."""
    raw = _text(spark, path, wholetext=True).select("value", F.input_file_name().alias("_f"))
    run = folder_key(F.col("_f"))
    msgs = F.from_json("value", "array<struct<role:string,content:string>>")
    return raw.select(run.alias("run"), msgs.alias("m")).filter(F.col("m").isNotNull()).select(
        "run", _conversation_text(F.col("m")).alias("trace"))


def read_step_logs(spark: SparkSession, path) -> DataFrame:
    """(run, trace) from step logs: one line per step with thought, action and feedback."""
    raw = _text(spark, path, wholetext=True).select("value", F.input_file_name().alias("_f"))
    steps = F.from_json("value", "array<struct<step:string,action:string,reasoning:string,"
                                 "env_feedback:string,done:boolean>>")

    def line(s):
        return F.concat(
            F.lit("[step "), F.coalesce(s["step"], F.lit("None")), F.lit("] think="),
            F.coalesce(s["reasoning"], F.lit("")), F.lit(" | action="),
            F.coalesce(s["action"], F.lit("None")), F.lit(" | feedback="),
            strip(F.coalesce(s["env_feedback"], F.lit(""))),
            F.when(s["done"], "  <<DONE>>").otherwise(""))

    return raw.select(folder_key(F.col("_f")).alias("run"), steps.alias("s")).filter(
        F.col("s").isNotNull()).select(
        "run", F.array_join(F.transform("s", line), "\n").alias("trace"))


def read_eval(spark: SparkSession, path, run=None) -> dict[str, DataFrame]:
    """results and summary of evaluation documents, with the run (file name) they came from."""
    doc = _json(spark, path, EVAL_DOCUMENT).withColumn(
        "run", _file_stem(F.input_file_name()) if run is None else run)
    return {"results": doc.select("run", F.inline("results")).withColumn(
                "success", F.coalesce("success", F.lit(False))),
            "summary": doc.filter(F.col("summary").isNotNull()).select("run", "summary.*")}


def read_result_lines(spark: SparkSession, path) -> DataFrame:
    """Result lines whose ``hard`` may be a string, a number or a boolean."""
    raw = _json(spark, path, "id string, question string, task_type string, hard string", False)
    return raw.select("id", "question", F.coalesce("task_type", F.lit("")).alias("task_type"),
                      is_hard("hard").alias("hard"))


def read_routes(spark: SparkSession, path, multi: bool = True) -> DataFrame:
    """(task_id, pos, id, guarded) from route dumps, one per file or, with ``multi=False``, one
    per line; unreadable dumps are skipped."""
    with listed_by_cores(spark):
        raw = (spark.read.schema(ROUTE_DUMP).option("mode", "DROPMALFORMED")
               .option("multiLine", multi).option("recursiveFileLookup", True).json(path))
    return raw.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("task_id"), F.coalesce("guarded", F.lit(False)).alias("guarded"),
        F.posexplode("nodes").alias("pos", "id"))


def read_split(spark: SparkSession, path, name: str) -> DataFrame:
    return spark.read.text(path).select(strip("value").alias("id")).filter(
        F.length("id") > 0).withColumn("split", F.lit(name))


# The frontmatter format of skill documents.
_FRONT = r"(?s)^---\s*\n(.*?)\n---"
_NAME = r"(?m)^name:\s*[\"']?([^\"'\n]+)[\"']?\s*$"
_DESCRIPTION = r"(?m)^description:\s*[\"']?([^\"'\n]+)[\"']?\s*$"


def parse_skill_docs(docs: DataFrame) -> DataFrame:
    """(path, name, description, body) from ``docs(path, value)``; no name, no row."""
    front = F.regexp_extract("value", _FRONT, 1)
    after = F.regexp_replace("value", r"(?s)^---.*?---\n*", "")
    return docs.select(
        "path", strip(F.regexp_extract(front, _NAME, 1)).alias("name"),
        strip(F.regexp_extract(front, _DESCRIPTION, 1)).alias("description"),
        after.alias("body")).filter(F.length("name") > 0)


def read_skill_docs(spark: SparkSession, path: str, files: str = "SKILL.md") -> DataFrame:
    """Skill documents of a folder, named by the folders that they lie in. Plain files are read as bytes: the text reader sets up its
    codecs anew for every file, which takes longer than reading a small one."""
    if files.endswith((".md", ".txt")):  # no compressed file has such a name
        with listed_by_cores(spark):
            raw = spark.read.format("binaryFile").load(path, recursiveFileLookup=True, pathGlobFilter=files)
        raw = raw.select(F.col("content").cast("string").alias("value"), folder_key(F.col("path")).alias("path"))
    else:
        raw = _text(spark, path, wholetext=True, pathGlobFilter=files).select("value", folder_key().alias("path"))
    return parse_skill_docs(raw)


def read_capability_manifest(rows: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """Deployed skills and dependency edges from a manifest.

    ``rows(id, name, description, task_types, deps, src, body)``; an inline body wins, else the
    document ``docs(src, value)`` the row names.
    """
    text = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    joined = rows.join(docs.select("src", text.alias("_doc")), "src", "left")
    own = F.when(F.length("body") > 0, F.col("body"))
    skills = joined.select(
        "id", "name", "description", F.coalesce(own, F.col("_doc")).alias("body"),
        F.lit("atomic").alias("granularity"), F.lit("deployed").alias("status"), "task_types",
        F.col("deps").alias("dependencies"))
    edges = rows.select(F.col("id").alias("src"), F.explode("deps").alias("dst"),
                        F.lit("depends_on").alias("type"))
    return {"skills": skills, "edges": edges}


def read_history(spark: SparkSession, path, run=None) -> DataFrame:
    raw = _text(spark, path, wholetext=True)
    name = _file_stem(F.input_file_name()) if run is None else run
    return raw.select(name.alias("run"), "value").select("run", F.inline(F.from_json("value", HISTORY)))
