"""Registry of checks: a Spark query and, where SQL can say it, the same in ANSI SQL."""

from __future__ import annotations

import re
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def sql(text: str) -> str:
    """Complete a query with the stand-in views it names. ``ctes --- select`` splits own CTEs."""
    own, _, select = text.rpartition("---")
    need: list[str] = []

    def visit(body: str, inside: tuple[str, ...] = ()) -> None:
        for name in re.findall(r"\bv_\w+", body):
            if name in views.SQL and name not in need and name not in inside:
                visit(views.SQL[name], (*inside, name))
                need.append(name)

    visit(text)
    parts = [f"{n} AS ({views.SQL[n]})" for n in need]
    if own.strip():
        parts.append(own.strip().rstrip(","))
    return (f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select).strip()


def check(key: str, text: str | None = None):
    def wrap(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(views.Views(spark, sf_dir))
        if text is not None:
            SQL[key] = sql(text)
        return fn
    return wrap
