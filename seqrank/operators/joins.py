"""Joins by key, with the fallbacks for keys that find nothing. Right sides are made unique first, so rows never fan out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import first_by_key


def left_unique(df: DataFrame, other: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Left join to the first row per key (by ``order``; without it the right side must be unique already)."""
    right = first_by_key(other, keys, order).drop(*([order] if order not in keys else [])) if order else other
    return df.join(right, keys, "left")


def inner_nonempty(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join; an empty result is an error, raised when the query runs."""
    joined = df.join(other, keys, "inner")
    if joined.isEmpty():
        raise ValueError(f"no rows are left after the join on {keys}")
    return joined


def missing_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of ``df`` that ``other`` lacks."""
    return df.select(*keys).distinct().join(other.select(*keys).distinct(), keys, "left_anti")


def require_mapped(df: DataFrame, other: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Left join that fails, naming up to ``most`` keys, if ``other`` lacks any."""
    found = [tuple(r) for r in missing_keys(df, other, keys).limit(most).collect()]
    if found:
        raise ValueError(f"unmapped keys: {found}")
    return df.join(other, keys, "left")


def lookup_last(df: DataFrame, pairs: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Dictionary lookup: of a repeated key the last entry counts."""
    last = pairs.groupBy(key).agg(F.max_by(value, order).alias(value))
    return df.join(last, key, "left")


def exact_length_or_first(df: DataFrame, references: DataFrame, sequence: str = "sequence", ref: str = "ref_sequence", ref_id: str = "ref_id") -> DataFrame:
    """The first reference of the same length, else the first of all."""
    rows = df.withColumn("__len", F.length(sequence))
    by_length = references.groupBy(F.length(ref).alias("__len")).agg(F.min_by(ref, ref_id).alias("__ref"))
    first = references.agg(F.min_by(ref, ref_id).alias("__first"))
    joined = rows.join(by_length, "__len", "left").crossJoin(F.broadcast(first))
    return joined.withColumn(ref, F.coalesce("__ref", "__first")).drop("__len", "__ref", "__first")


def nearest_length(df: DataFrame, references: DataFrame, sequence: str = "sequence", ref: str = "ref_sequence", ref_id: str = "ref_id") -> DataFrame:
    """The reference whose length is nearest, the shorter at a tie, of equal ones the first.

    The references' distinct lengths go into one sorted array of (length, first reference's id), found for every distinct length of
    the rows; the rows then join by length. Nothing is paired row by row.
    """
    firsts = references.groupBy(F.length(ref).alias("l")).agg(F.min(ref_id).alias("i"))
    table = firsts.agg(F.sort_array(F.collect_list(F.struct("l", "i"))).alias("__all"))
    lengths = df.select(F.length(sequence).alias("__len")).distinct().crossJoin(F.broadcast(table))
    gap = F.transform("__all", lambda r: F.struct(F.abs(r["l"] - F.col("__len")).alias("gap"), r["l"].alias("l"), r["i"].alias("i")))
    best = lengths.select("__len", F.array_min(gap)["i"].alias(ref_id))
    named = best.join(references.select(ref_id, ref), ref_id, "left")
    return df.withColumn("__len", F.length(sequence)).join(named, "__len", "left").drop("__len")


def or_itself(df: DataFrame, ref: str, sequence: str = "sequence") -> DataFrame:
    """The row's own sequence where no reference was found."""
    return df.withColumn(ref, F.coalesce(ref, sequence))
