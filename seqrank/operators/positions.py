"""Rows by their place in the files that they come from, and tables without keys put side by side.

A row's place is that of its file (by path), of its block in the file, and of itself in the block. Each block's rows are counted; a row's position is the
count before its block and its place in it. What is ordered is a table with a row for each block; no window runs over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def positioned(df: DataFrame, to: str = "position") -> DataFrame:
    """The rows of a table that is read from files, as it was read (no join or shuffle since), with their position from 0."""
    place = (F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    # a task reads a block's rows in their order, one block after another
    rows = stored(df.select(*(F.col(f"`{c}`") for c in df.columns), *place, F.monotonically_increasing_id().alias("__at")), "placed")
    blocks = rows.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = stored(blocks.select("__file", "__start", "__first", before.alias("__before")), "blocks")  # a row per block of a file
    out = rows.join(begins, ["__file", "__start"])
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__before") + F.col("__at") - F.col("__first")).alias(to))


def side_by_side(left: DataFrame, right: DataFrame, suffix: str = "_right", to: str = "position") -> DataFrame:
    """position and the columns of both tables, row by row; the shorter one's are null behind its end. Columns of one name get the suffix on the right."""
    named = {c: c + suffix if c in left.columns else c for c in right.columns}
    one = positioned(left, to)
    two = positioned(right, to).select(F.col(to).alias("__to"), *(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    met = one.join(two, F.col(to) == F.col("__to"), "full")
    return met.select(F.coalesce(to, "__to").alias(to), *(F.col(f"`{c}`") for c in left.columns), *(F.col(f"`{n}`") for n in named.values()))
