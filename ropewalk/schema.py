"""Table schemas and the fixed vocabularies of the experience graph."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: these must equal the public data model for stored graphs to be readable ---
GRANULARITIES = ("atomic", "functional", "plan")
STATUSES = ("candidate", "validated", "deployed", "retired")
TRACE_EDGES = ("temporal_order", "co_occurrence", "caused_failure", "fixed_by")
GOVERNANCE_EDGES = (
    "supported_by_trace", "applies_to_skill", "blocks_routing", "promotes_skill",
    "guards_skill", "evidence_for",
)
CAPABILITY_EDGES = (
    "depends_on", "composes_with", "alternative_to", "conflicts_with", "parent_child",
)
EXEC_EDGES = ("depends_on", "composes_with", "parent_child")
# --- end of fixed values ---

_strings = T.ArrayType(T.StringType())

SKILL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("granularity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("parents", _strings),
    T.StructField("dependencies", _strings),
    T.StructField("conflicts", _strings),
    T.StructField("task_types", _strings),
    T.StructField("evidence_traces", _strings),
    T.StructField("heat", T.StructType([
        T.StructField("success_count", T.LongType()),
        T.StructField("failure_count", T.LongType()),
        T.StructField("n_visit", T.LongType()),
        T.StructField("coverage", T.LongType()),
        T.StructField("token_cost", T.LongType()),
        T.StructField("last_used_step", T.LongType()),
    ])),
])

EDGE = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])

RULE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("statement", T.StringType()),
    T.StructField("targets", _strings),
    T.StructField("postcondition", T.StringType()),
    T.StructField("max_retries", T.LongType()),
    T.StructField("repair_hint", T.StringType()),
])

GRAPH_DOCUMENT = T.StructType([
    T.StructField("skills", T.ArrayType(SKILL)),
    T.StructField("capability_edges", T.ArrayType(EDGE)),
    T.StructField("governance", T.ArrayType(RULE)),
])

EVAL_DOCUMENT = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("instruction_type", T.StringType()),
        T.StructField("passed_count", T.LongType()),
        T.StructField("total_count", T.LongType()),
    ]))),
    T.StructField("summary", T.StructType([
        T.StructField("total_instances", T.LongType()),
        T.StructField("fully_correct_instances", T.LongType()),
        T.StructField("instance_accuracy", T.DoubleType()),
        T.StructField("avg_hard_score", T.DoubleType()),
        T.StructField("avg_soft_score", T.DoubleType()),
    ])),
])

HISTORY = T.ArrayType(T.StructType([
    T.StructField("round", T.LongType()),
    T.StructField("inserted", T.LongType()),
    T.StructField("merged", T.LongType()),
    T.StructField("split", T.LongType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("val", T.DoubleType()),
    T.StructField("deployed", T.LongType()),
    T.StructField("retired_total", T.LongType()),
    T.StructField("checkpoints", T.LongType()),
]))

NAV_RECORD = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("cursor", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("note", T.StringType()),
])

ROUTE_DUMP = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("nodes", _strings),
    T.StructField("guarded", T.BooleanType()),
])

FRAGMENTS = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("task_types", _strings),
    T.StructField("kind", T.StringType()),
]))

CHAIN_STEPS = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("desc", T.StringType()),
]))

CHAIN_DOCUMENT = T.StructType([
    T.StructField("nodes", T.MapType(T.StringType(), T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("desc", T.StringType()),
        T.StructField("n_visit", T.LongType()),
        T.StructField("n_success", T.LongType()),
        T.StructField("pos_sum", T.DoubleType()),
        T.StructField("pos_n", T.LongType()),
        T.StructField("task_types", T.MapType(T.StringType(), T.LongType())),
        T.StructField("examples", _strings),
    ]))),
    T.StructField("edges", T.ArrayType(T.StructType([
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("succ", T.LongType()),
    ]))),
])
