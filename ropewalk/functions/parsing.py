"""Parsers for text that runs and models leave behind, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import CHAIN_STEPS, FRAGMENTS
from .text import _col, strip

# Patterns of rule ids, rule statements and reply formats.
_STEP_SUFFIX = r"_(\d+)(?:_\d+)?$"
_RATE_AND_TRIALS = r"succ ([\d.]+) over (\d+) trials"
_OUTER_ARRAY = r"(?s)\[.*\]"
_FLAT_ARRAY = r"\[[^\[\]]*\]"
_TRUE_WORDS = ("1", "1.0", "True", "true")


def rule_step(rule_id: Column | str) -> Column:
    """Logical step at the end of a rule id, or null."""
    return F.regexp_extract(_col(rule_id), _STEP_SUFFIX, 1).try_cast("long")


def rule_stats(statement: Column | str) -> Column:
    """struct(succ, trials) found in a checkpoint statement, nulls when absent."""
    rate = F.regexp_extract(_col(statement), _RATE_AND_TRIALS, 1)
    n = F.regexp_extract(_col(statement), _RATE_AND_TRIALS, 2)
    return F.struct(rate.try_cast("double").alias("succ"), n.try_cast("long").alias("trials"))


def is_hard(value: Column | str) -> Column:
    """1 for the spellings of true that result files use, else 0."""
    return F.coalesce(_col(value).cast("string").isin(*_TRUE_WORDS), F.lit(False)).cast("int")


def type_key(instruction_type: Column | str) -> Column:
    first = F.get(F.filter(F.split(F.coalesce(_col(instruction_type), F.lit("")), r"\s+"),
                           lambda w: F.length(w) > 0), F.lit(0))
    return F.coalesce(first, F.lit("?"))


def parse_fragments(reply: Column | str) -> Column:
    """Lesson objects between the first and the last bracket; lessons without a body drop out."""
    found = F.from_json(F.regexp_extract(_col(reply), _OUTER_ARRAY, 0), FRAGMENTS)
    kept = F.filter(found, lambda f: F.length(f["body"]) > 0)
    return F.transform(kept, lambda f: F.struct(
        F.substring(F.coalesce(f["name"], F.lit("lesson")), 1, 80).alias("name"),
        F.coalesce(f["description"], F.lit("")).alias("description"),
        f["body"].alias("body"),
        F.coalesce(f["task_types"], F.array().cast("array<string>")).alias("task_types"),
        F.coalesce(f["kind"], F.lit("skill")).alias("kind"),
    ))


def parse_chain(reply: Column | str) -> Column:
    """Step objects of a chain reply; id falls back to desc, objects with neither drop out."""
    found = F.from_json(F.regexp_extract(_col(reply), _OUTER_ARRAY, 0), CHAIN_STEPS)

    def given(c):
        return F.when(F.length(c) > 0, c)

    kept = F.filter(found, lambda s: F.coalesce(given(s["id"]), given(s["desc"])).isNotNull())
    return F.transform(kept, lambda s: F.struct(
        F.coalesce(given(s["id"]), given(s["desc"])).alias("id"),
        F.coalesce(s["desc"], F.lit("")).alias("desc"),
    ))


def parse_id_list(reply: Column | str) -> Column:
    """All flat JSON arrays of a reply, last one first, as arrays of trimmed strings.

    Which of them counts depends on the pool, so the caller explodes and joins (see
    ``operators.routing.seeds_from_replies``).
    """
    groups = F.reverse(F.regexp_extract_all(_col(reply), F.lit(_FLAT_ARRAY), F.lit(0)))
    parsed = F.transform(groups, lambda g: F.from_json(g, "array<string>"))
    return F.transform(F.filter(parsed, lambda a: a.isNotNull()),
                       lambda a: F.transform(a, lambda v: strip(v)))
