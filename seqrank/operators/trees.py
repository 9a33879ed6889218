"""Predictions of tree ensembles whose trees are a table of nodes.

A node has a feature, a threshold, two children and where a missing value goes; a leaf has a value instead. Trees are sent in blocks, each once for some
hundred rows, so neither the rows nor the ensemble need fit beside the other. In an Arrow batch all rows go down all trees of a block level by level.

Trees only tell rows apart by the thresholds that their values lie between. Where the ensemble has few different thresholds, rows between the same ones make
a cell: each cell goes down the trees once, and its prediction is sent to its rows, which aren't shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored
from .meeting import behind, groups, numbered
from .stats import running_before

#: Trees in a block, and rows that go down together.
BLOCK, TOGETHER = 64, 2048
#: Different thresholds up to which rows are told apart by them alone, and cells up to which their predictions are broadcast.
CUTS, SENT = 256, 1 << 16


def tree_blocks(nodes: DataFrame) -> DataFrame:
    """block, tree, and a tree's nodes as arrays in the order of their numbers. nodes: tree, node (0 is the root), feature (from 0; null in a leaf), threshold, left, right, missing_left, value."""
    kinds = {"node": "int", "feature": "int", "threshold": "double", "left": "int", "right": "int", "missing_left": "boolean", "value": "double"}
    entry = F.struct(*(F.col(c).cast(k).alias(c) for c, k in kinds.items()))
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(entry)).alias("n"))  # a tree's nodes, which a caller's model bounds
    parts = [F.col(f"n.{c}").alias(c) for c in kinds]
    placed = running_before(trees, [F.col("tree")], F.lit(1), "place")
    return stored(placed.select(F.floor(F.col("place") / BLOCK).alias("block"), "tree", *parts), "trees")


class Forest:
    """A block's trees as arrays over all their nodes; children are places in them, and a leaf is its own child."""

    def __init__(self, trees: list[dict]):
        sizes = [len(t["node"]) for t in trees]
        begins = np.cumsum([0, *sizes[:-1]])
        at = [{n: int(b) + k for k, n in enumerate(t["node"])} for t, b in zip(trees, begins, strict=True)]
        flat = lambda c: [x for t in trees for x in t[c]]
        own = np.arange(sum(sizes))
        leaf = np.array([f is None for f in flat("feature")], bool)
        child = lambda c: np.array([own if k is None else where[k] for t, where in zip(trees, at, strict=True) for k, own in zip(t[c], map(where.get, t["node"]), strict=True)], np.int64)
        self.left, self.right = np.where(leaf, own, child("left")), np.where(leaf, own, child("right"))
        self.leaf, self.feature = leaf, np.array([f or 0 for f in flat("feature")], np.int64)
        self.threshold = np.array([np.nan if x is None else x for x in flat("threshold")])
        self.missing_left = np.array([bool(x) for x in flat("missing_left")])
        self.value = np.array([np.nan if x is None else x for x in flat("value")])
        self.roots = np.array([where[0] for where in at], np.int64)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row (a matrix with NaN where a value is missing) in every tree."""
        now = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(len(self.leaf)):
            if self.leaf[now].all():
                return now
            v = x[rows, self.feature[now]]
            left = np.where(np.isnan(v), self.missing_left[now], v <= self.threshold[now])
            now = np.where(left, self.left[now], self.right[now])
        raise ValueError("the nodes of a tree go in a circle")


def _between(x: Column, cuts: list[float], first: int = 0) -> Column:
    """How many of the ascending cuts a value is above, by halves."""
    if not cuts:
        return F.lit(first)
    k = len(cuts) // 2
    return F.when(x <= F.lit(cuts[k]), _between(x, cuts[:k], first)).otherwise(_between(x, cuts[k + 1 :], first + k + 1))


def _key(values: list[Column], nodes: DataFrame) -> Column:
    """What all rows share that go the same ways: a number of the thresholds that their values lie between, or a digest of the values where there are too many."""
    splits = nodes.filter("feature is not null").select(F.col("feature").cast("int"), F.col("threshold").cast("double")).distinct()
    found = splits.limit(CUTS + 1).collect()
    cuts: dict[int, set[float]] = {f: set() for f, _ in found}
    for f, t in found:
        if t is not None and not math.isnan(t):  # no value is at or below those
            cuts[f].add(t)
    if len(found) > CUTS or math.prod(len(c) + 2 for c in cuts.values()) >= 1 << 62:
        return F.md5(F.concat_ws("|", *(F.coalesce(v.cast("string"), F.lit("NaN")) for v in values)))
    key = F.lit(0).cast("long")
    for f, c in sorted(cuts.items()):
        place = F.when(values[f].isNull() | F.isnan(values[f]), F.lit(len(c) + 1)).otherwise(_between(values[f], sorted(c)))
        key = key * F.lit(len(c) + 2).cast("long") + place
    return key


def ensemble_predictions(df: DataFrame, features: list[str], nodes: DataFrame, to: str = "prediction") -> DataFrame:
    """The rows with the mean of all trees' leaves. A feature that is null or NaN is missing. Without trees the prediction is null.

    Predictions are made once for all rows between the same thresholds, or with the same features if there are many.
    """
    ship(df.sparkSession)
    nodes = stored(nodes, "nodes")
    blocks = tree_blocks(nodes)
    values = [F.col(f"`{c}`").cast("double") for c in features]
    key = _key(values, nodes)
    # any of a cell's values goes its way
    cells = df.select(key.alias("__key"), *(v.alias(f"__x{k}") for k, v in enumerate(values))).groupBy("__key").agg(*(F.min(f"__x{k}").alias(f"__x{k}") for k in range(len(values))))
    rows = stored(cells.select("__key", F.array(*(f"__x{k}" for k in range(len(values)))).cast("array<double>").alias("x")), "cells")
    met = behind(numbered(rows, blocks.agg(F.max("block")), "block"), blocks, "block", "__key", [F.col("tree")], TOGETHER)
    kind = rows.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = forest = None
        for heads, held in groups(batches, TOGETHER):
            if heads is not at:
                at, forest = heads, Forest(heads)
            values = np.array([[np.nan if v is None else v for v in r["x"]] for r in held], np.float64).reshape(len(held), -1)
            total = forest.value[forest.leaves(values)].sum(1)
            yield pa.RecordBatch.from_arrays([pa.array([r["__key"] for r in held]), pa.array(total), pa.array([len(heads)] * len(held), pa.int64())], ["__key", "total", "trees"])

    parts = met.mapInArrow(run, f"__key {kind}, total double, trees long")
    found = parts.groupBy("__key").agg((F.sum("total") / F.sum("trees")).alias(to))
    if rows.count() <= SENT:
        found = F.broadcast(found)
    keep = [F.col(f"`{c}`") for c in df.columns if c != to]
    return df.select(*keep, key.alias("__key")).join(found, "__key", "left").drop("__key")
