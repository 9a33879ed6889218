"""Ranking and regression metrics, per group or over a table, all as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import rank_average, running_within, safe_corr


def ndcg_top_fraction(df: DataFrame, predicted: str, truth: str, row_id: str, fraction: float = 0.1, group: list[str] | None = None) -> DataFrame:
    """group, n, k, ndcg over the first max(1, floor(n * fraction)) rows of each order.

    Gains are the truth scaled to [0, 1]; a constant truth gives 0. Ties go to the later row id. Null rows are left out.
    """
    keys = group or []
    rows = df.filter(F.col(predicted).isNotNull() & F.col(truth).isNotNull()).select(*keys, F.col(predicted).alias("p"), F.col(truth).alias("t"), F.col(row_id).alias("r"))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    stats = stats.withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * fraction)).cast("long"))
    joined = rows.join(stats, keys) if keys else rows.crossJoin(F.broadcast(stats))  # one row without groups
    gain = F.when(F.col("hi") > F.col("lo"), (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))

    def sums(by: str, to: str) -> DataFrame:
        placed = running_within(joined, keys, [F.desc(by), F.desc("r")], F.lit(1), "place").withColumn("place", F.col("place") + 1)
        top = placed.select(*keys, "k", gain.alias("g"), "place").filter("place <= k")
        return top.groupBy(*keys).agg(F.sum(F.col("g") / F.log2(F.col("place") + 1.0)).alias(to))

    dcg, ideal = sums("p", "dcg"), sums("t", "idcg")
    both = stats.join(dcg, keys).join(ideal, keys) if keys else stats.crossJoin(dcg).crossJoin(ideal)
    return both.select(*keys, "n", "k", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def spearman(df: DataFrame, a: str, b: str, group: list[str] | None = None) -> DataFrame:
    """group, rho: correlation of average ranks; 0 where it isn't defined."""
    keys = group or []
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = rank_average(rank_average(rows, a, "__ra", keys), b, "__rb", keys)
    return ranked.groupBy(*keys).agg(F.coalesce(safe_corr(F.col("__ra"), F.col("__rb")), F.lit(0.0)).alias("rho"))


def auc(df: DataFrame, score: str, label: str, group: list[str] | None = None) -> DataFrame:
    """group, auc by Mann-Whitney with average ranks; null where one class is missing."""
    keys = group or []
    ranked = rank_average(df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*keys, score, label), score, "__r", keys)
    pos = (F.col(label) == 1).cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("__r") * pos).alias("rank_sum"), F.sum(pos).alias("p"), F.sum(1 - pos).alias("q"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def errors(df: DataFrame, predicted: str, truth: str, group: list[str] | None = None) -> DataFrame:
    gap = F.col(predicted) - F.col(truth)
    return df.groupBy(*(group or [])).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def accuracy(df: DataFrame, predicted: str, label: str, group: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(group or [])).agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))


def over_folds(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population sd of each metric over the folds."""
    return df.agg(*(f(m).alias(f"{m}_{name}") for m in metrics for name, f in (("mean", F.avg), ("sd", F.stddev_pop))))
