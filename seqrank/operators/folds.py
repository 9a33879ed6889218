"""Fold assignment for cross-validation, without any random number generator's state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import running_within


def _hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold by a hash of the key: the first 8 hex digits of its MD5, modulo k."""
    return df.withColumn("fold", (F.conv(F.substring(_hash(key, seed), 1, 8), 16, 10).cast("long") % k).cast("int"))


def stratified(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold so that each label is spread evenly: its rows in hashed order, dealt in turn. A label with half of all rows spreads over ranges."""
    placed = running_within(df.withColumn("__h", _hash(key, seed)), [label], [F.col("__h"), F.col(key)], F.lit(1), "__place")
    return placed.withColumn("fold", (F.col("__place") % k).cast("int")).drop("__h", "__place")


@dataclass
class _Deal:
    """Which fold the r-th of the groups of one size goes to: from rank ``begins[i]`` on, in turn over ``folds[i]``."""

    size: int
    begins: list[int]
    folds: list[list[int]]


def _deals(classes: list[tuple[int, int]], k: int) -> list[_Deal]:
    """Greedy dealing of (size, groups) classes, largest first: each group to the fold that is lightest, the first one at a tie.

    The groups of a class raise the light folds to the level of the heavier ones and then go round; so a class of any number
    of groups takes k steps.
    """
    weight, out = [0] * k, []
    for size, groups in sorted(classes, reverse=True):
        deal = _Deal(size, [], [])
        # the j-th group that fold f takes comes at the key (weight + j * size, f): layer by layer of a size's height
        layers = sorted({w // size for w in weight})
        dealt, taken = 0, [0] * k
        for i, layer in enumerate(layers):
            active = sorted((f for f in range(k) if weight[f] // size <= layer), key=lambda f: (weight[f] % size, f))
            rounds = layers[i + 1] - layer if i + 1 < len(layers) else None
            deal.begins.append(dealt)
            deal.folds.append(active)
            many = groups - dealt if rounds is None else min(rounds * len(active), groups - dealt)
            for place, f in enumerate(active):
                taken[f] += max(0, -(-(many - place) // len(active)))
            dealt += many
            if dealt >= groups:
                break
        weight = [w + size * t for w, t in zip(weight, taken, strict=True)]
        out.append(deal)
    return out


def grouped(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """fold so that a group is in one fold only: the largest group left goes to the lightest fold. Folds are at most as many as groups.

    Groups of one size differ by their place in the order of the group alone, so what goes to the driver is how many groups have each
    size: as many rows as there are different sizes, at most the square root of twice the rows. Groups are ranked by ranges.
    """
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    classes = [(r["__n"], r["c"]) for r in sizes.groupBy("__n").agg(F.count("*").alias("c")).collect()]
    groups = sum(c for _, c in classes)
    if groups < 2:
        raise ValueError("grouped folds need two groups at least")
    deals = [(d.size, list(zip(d.begins, d.folds, strict=True))) for d in _deals(classes, min(k, groups))]
    table = df.sparkSession.createDataFrame(deals, "__s long, __deal array<struct<begin: long, folds: array<int>>>")
    ranked = running_within(sizes, ["__n"], [F.col("__g").cast("string")], F.lit(1), "__r").join(table, F.col("__n") == F.col("__s"))
    turn = F.element_at(F.filter("__deal", lambda x: x["begin"] <= F.col("__r")), -1)
    fold = F.element_at(turn["folds"], (F.col("__r") - turn["begin"]).cast("int") % F.size(turn["folds"]) + 1)
    named = ranked.select("__g", fold.alias("fold"))
    return df.join(named, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
