"""Linear models on standardised features, by closed form or Newton steps over aggregated sums.

A fit needs the second moments alone: they come from one aggregate of (columns + 1) squared numbers, which is what the driver
solves. Folds are fitted together: the sums are kept per fold, and a fold's training sums are the total less its own; in logistic
regression all folds' models take each step in one aggregate.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import col_or_lit


@dataclass
class Linear:
    """weights over the raw columns, and an intercept. kind: ridge or logistic."""

    columns: list[str]
    weights: list[float]
    intercept: float
    kind: str = "ridge"

    def score(self, df: DataFrame) -> Column:
        """Linear score of a row; columns that it lacks, or that are null, count 0."""
        out = F.lit(self.intercept)
        for c, w in zip(self.columns, self.weights, strict=True):
            out = out + F.lit(w) * F.coalesce(col_or_lit(df, c).cast("double"), F.lit(0.0))
        return out if self.kind == "ridge" else 1.0 / (1.0 + F.exp(-out))

    def predict(self, df: DataFrame, to: str = "prediction", floor: float | None = None) -> DataFrame:
        value = self.score(df)
        return df.withColumn(to, F.greatest(value, F.lit(floor)) if floor is not None else value)

    def save(self, spark: SparkSession, path: str) -> None:
        """The model and its columns in order, as one JSON row."""
        spark.createDataFrame([(json.dumps(self.__dict__),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Linear:
        return Linear(**json.loads(spark.read.text(path).first()[0]))


def save_metrics(spark: SparkSession, found: dict[str, float | None], path: str) -> None:
    """A model's figures as one JSON object, in place of what the path held; null where a figure is undefined."""
    spark.createDataFrame([(json.dumps(found, default=float),)], "metrics string").coalesce(1).write.mode("overwrite").text(path)


def load_metrics(spark: SparkSession, path: str) -> dict[str, float | None]:
    """What ``save_metrics`` wrote."""
    return json.loads(spark.read.text(path).first()[0])


def _x(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]


def moments(df: DataFrame, columns: list[str], target: str, fold: str | None = None) -> tuple[np.ndarray, dict[object, np.ndarray]]:
    """Means of (columns, target) over the table, and the matrix of sums of products of (1, columns, target) less those means, per fold (key None without one).

    Centred before they are multiplied, so a large mean beside a small spread doesn't cancel.
    """
    rows = df.filter(F.col(target).isNotNull())
    raw = [*_x(columns), F.col(target).cast("double")]
    first = rows.agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(raw))).first()
    mean = np.array([x or 0.0 for x in first])
    v = [F.lit(1.0), *(x - F.lit(float(m)) for x, m in zip(raw, mean, strict=True))]
    n = len(v)
    sums = [F.sum(v[i] * v[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(i, n)]
    out = {}
    for r in rows.groupBy(*([fold] if fold else [])).agg(*sums).collect():  # one row per fold
        m = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                m[i, j] = m[j, i] = r[f"m{i}_{j}"] or 0.0
        out[r[fold] if fold else None] = m
    return mean, out


def _spread(mean: np.ndarray, cov: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Standard deviations, 1 where one is 0 but for rounding."""
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd <= 1e-12 * (1 + np.abs(mean + base))] = 1.0
    return sd


def ridge_of(base: np.ndarray, m: np.ndarray, columns: list[str], alpha: float = 1.0) -> Linear:
    """Ridge on features standardised by their population sd (1 where it is 0), target centred. base, m: of moments()."""
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = _spread(mean, cov, base[:-1])
    y = m[0, -1] / n
    xy = (m[1:-1, -1] / n - mean * y) / sd
    w = np.linalg.solve(cov / np.outer(sd, sd) * n + alpha * np.eye(len(sd)), xy * n) / sd
    return Linear(columns, w.tolist(), float(y + base[-1] - w @ (mean + base[:-1])))


def ridge(df: DataFrame, columns: list[str], target: str, alpha: float = 1.0) -> Linear:
    base, per = moments(df, columns, target)
    return ridge_of(base, per[None], columns, alpha)


def ridge_folds(df: DataFrame, columns: list[str], target: str, fold: str, alpha: float = 1.0) -> dict[object, Linear]:
    """For each fold the model fitted on the others, from one aggregate."""
    base, per = moments(df, columns, target, fold)
    total = sum(per.values())
    return {f: ridge_of(base, total - m, columns, alpha) for f, m in per.items()}


def predict_folds(df: DataFrame, models: dict[object, Linear], fold: str, to: str = "prediction") -> DataFrame:
    """Each row by its own fold's model."""
    out = F.lit(None).cast("double")
    for f, m in models.items():
        out = F.when(F.col(fold) == f, m.score(df)).otherwise(out)
    return df.withColumn(to, out)


def logistic(df: DataFrame, columns: list[str], label: str, c: float = 1.0, steps: int = 25, tolerance: float = 1e-9) -> Linear:
    """L2 logistic regression on standardised features with balanced class weights, by Newton steps."""
    return logistic_folds(df, columns, label, None, c, steps, tolerance)[None]


def logistic_folds(df: DataFrame, columns: list[str], label: str, fold: str | None, c: float = 1.0, steps: int = 25, tolerance: float = 1e-9) -> dict[object, Linear]:
    """For each fold the model fitted on the others (key None: on all rows, without a fold). All models take a Newton step together.

    Each step is one aggregate: gradients and Hessians of every model from one pass over the rows.
    """
    rows = df.filter(F.col(label).isNotNull())
    base, per = moments(rows, columns, label, fold)
    total, d = sum(per.values()), len(columns) + 1
    fits = {f: total - m if fold else m for f, m in per.items()}
    # sums are made over (1, columns less their means); a model's standardised features are a linear map of those
    maps, weights, beta, open_ = {}, {}, {}, list(fits)
    for f, m in fits.items():
        n = m[0, 0]
        mean = m[0, 1:-1] / n
        sd = _spread(mean, m[1:-1, 1:-1] / n - np.outer(mean, mean), base[:-1])
        positive = m[0, -1] + n * base[-1]
        if not 0.5 < positive < n - 0.5:
            raise ValueError("both classes are needed")
        maps[f] = np.block([[np.ones((1, 1)), np.zeros((1, d - 1))], [-(mean / sd)[:, None], np.diag(1 / sd)]])
        weights[f], beta[f] = (float(n / (2 * positive)), float(n / (2 * (n - positive)))), np.zeros(d)
    penalty = np.diag([0.0] + [1.0 / c] * (d - 1))
    own = [] if fold is None else [F.col(fold).alias("__fold")]
    centred = rows.select(F.col(label).alias("__y"), *own, F.lit(1.0).alias("u0"), *((v - F.lit(float(m))).alias(f"u{i}") for i, (v, m) in enumerate(zip(_x(columns), base[:-1], strict=True), 1)))
    for _ in range(steps):
        per_model = []
        for k, f in enumerate(open_):
            z = reduce(add, (F.lit(float(b)) * F.col(f"u{i}") for i, b in enumerate(maps[f].T @ beta[f])))
            weight = F.when(F.col("__y") == 1, F.lit(weights[f][0])).otherwise(F.lit(weights[f][1]))
            per_model += [(1.0 / (1.0 + F.exp(-z))).alias(f"p{k}"), (weight if fold is None else F.when(F.col("__fold") != F.lit(f), weight).otherwise(F.lit(0.0))).alias(f"w{k}")]
        slim = centred.select("__y", *(f"u{i}" for i in range(d)), *per_model)
        slim = slim.select(*(f"u{i}" for i in range(d)), *((F.col(f"w{k}") * (F.col(f"p{k}") - F.col("__y"))).alias(f"g{k}") for k in range(len(open_))), *((F.col(f"w{k}") * F.col(f"p{k}") * (1 - F.col(f"p{k}"))).alias(f"h{k}") for k in range(len(open_))))
        sums = [F.sum(F.col(f"g{k}") * F.col(f"u{i}")).alias(f"g{k}_{i}") for k in range(len(open_)) for i in range(d)]
        sums += [F.sum(F.col(f"h{k}") * F.col(f"u{i}") * F.col(f"u{j}")).alias(f"h{k}_{i}_{j}") for k in range(len(open_)) for i in range(d) for j in range(i, d)]
        r, still = slim.agg(*sums).first(), []
        for k, f in enumerate(open_):
            hess = maps[f] @ np.array([[r[f"h{k}_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) @ maps[f].T
            move = np.linalg.solve(hess + penalty, maps[f] @ np.array([r[f"g{k}_{i}"] for i in range(d)]) + penalty @ beta[f])
            beta[f] = beta[f] - move
            if np.abs(move).max() >= tolerance:
                still.append(f)
        open_ = still
        if not open_:
            break
    out = {}
    for f, b in beta.items():
        raw = maps[f].T @ b
        out[f] = Linear(columns, raw[1:].tolist(), float(raw[0] - raw[1:] @ base[:-1]), "logistic")
    return out


def predict_at(df: DataFrame, model: Linear, column: str, value: float, to: str, floor: float = 0.0) -> DataFrame:
    """Prediction with one column held at a value, not below ``floor``."""
    held = model.predict(df.withColumn(column, F.lit(value)), to, floor)
    return held if column in df.columns else held.drop(column)
