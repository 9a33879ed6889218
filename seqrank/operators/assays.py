"""Paired assays: long to wide by condition, labels and deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import exact_quantiles


def have_all(df: DataFrame, key: str, condition: str, values: Sequence[object]) -> DataFrame:
    """Keys measured under every one of the conditions."""
    seen = df.filter(F.col(condition).isin(list(values))).groupBy(key).agg(F.countDistinct(condition).alias("__n"))
    return seen.filter(F.col("__n") == len(values)).select(key)


def pivot_first(df: DataFrame, key: str, condition: str, value: str, order: str, values: Sequence[object], prefix: str, only: Sequence[object] | None = None) -> DataFrame:
    """A row per key and a column per condition with the first non-null value; keys that lack any are dropped.

    only: the conditions that a key may not lack (all by default).
    """
    columns = {v: f"{prefix}{v}".replace(".", "_") for v in values}
    wide = df.groupBy(F.trim(F.col(key).cast("string")).alias(key)).agg(
        *(F.min_by(value, F.when((F.col(condition) == v) & F.col(value).isNotNull(), F.col(order))).alias(name) for v, name in columns.items())
    )
    return wide.dropna("any", subset=[columns[v] for v in (only or values)])


def paired(wide: DataFrame, a: str, b: str) -> DataFrame:
    """label: whether b exceeds a; delta: b - a."""
    return wide.withColumns({"label": (F.col(b) > F.col(a)).cast("int"), "delta": F.col(b) - F.col(a)})


def summary(pairs: DataFrame) -> DataFrame:
    """Pairs, share of positive labels, mean and sd of the delta and its exact quantiles: one row."""
    at = (0.1, 0.25, 0.5, 0.75, 0.9)
    found = exact_quantiles(pairs, {"delta": F.col("delta")}, at)["delta"]
    row = pairs.agg(F.count("*").alias("n_pairs"), F.avg("label").alias("rate"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd_delta"))
    return row.withColumns({f"q{int(100 * q)}": F.lit(v).cast("double") for q, v in zip(at, found, strict=True)})
