"""Columns that pass through an operator untouched, whatever their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def sheltered(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but the needed ones under names no operator uses, and the way back to its own names
    (further columns may be asked for behind them)."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in needed}

    def back(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns], *more)

    return docs.withColumnsRenamed(names), back
