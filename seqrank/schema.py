"""Checks of a stage's input columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str], stage: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{stage}: missing columns {missing}; there are {df.columns}")
    return df


def col_or_lit(df: DataFrame, name: str, default: object = 0.0) -> Column:
    """An optional column, or its default."""
    return F.col(name) if name in df.columns else F.lit(default)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")]


def trimmed_key(name: str) -> Column:
    """A join key as a trimmed string; null stays null."""
    return F.trim(F.col(name).cast("string"))


def number(name: str) -> Column:
    """A double, or null where the text isn't one."""
    return F.expr(f"try_cast(trim(`{name}`) AS double)")
