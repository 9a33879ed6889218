import math
import random

import pytest
from pyspark.sql import functions as F

from seqrank.operators import meeting, trees
from seqrank.operators.positions import positioned, side_by_side
from seqrank.operators.trees import ensemble_predictions

NODES = "tree int, node int, feature int, threshold double, left int, right int, missing_left boolean, value double"


def grown(draw, tree, depth=4):
    """A random tree with nodes in no order."""
    out, count = [], [0]

    def grow(level):
        node = count[0]
        count[0] += 1
        if level == 0 or draw.random() < 0.2:
            out.append((tree, node, None, None, None, None, None, draw.uniform(-5, 5)))
        else:
            left, right = grow(level - 1), grow(level - 1)
            out.append((tree, node, draw.randrange(3), draw.uniform(-1, 1), left, right, draw.random() < 0.5, None))
        return node

    grow(depth)
    draw.shuffle(out)
    return out


def walked(nodes, x):
    by = {n[1]: n for n in nodes}
    at = by[0]
    while at[2] is not None:
        v = x[at[2]]
        missing = v is None or math.isnan(v)
        at = by[at[4] if (at[6] if missing else v <= at[3]) else at[5]]
    return at[7]


def test_predictions_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 3)
    draw = random.Random(2)
    forest = [grown(draw, t) for t in range(8)] + [[(8, 0, None, None, None, None, None, 1.5)]]
    value = lambda: draw.choice([None, float("nan"), draw.uniform(-1, 1), 0.0])
    rows = [(k, value(), value(), value()) for k in range(60)] + [(0, 0.0, 0.0, 0.0)] * 2
    df = spark.createDataFrame(rows, "tree long, node double, x double, value double")  # names that the nodes have too
    got = sorted((r["tree"], r["node"], r["x"], r["value"], r["prediction"]) for r in ensemble_predictions(df.fillna(-9.0), ["node", "x", "value"], spark.createDataFrame(sum(forest, []), NODES)).collect())
    want = sorted((k, *(-9.0 if v is None or math.isnan(v) else v for v in x)) for k, *x in rows)
    assert [r[:4] for r in got] == want
    assert [r[4] for r in got] == pytest.approx([sum(walked(t, r[1:4]) for t in forest) / 9 for r in want])
    raw = {r["tree"]: r["prediction"] for r in ensemble_predictions(df, ["node", "x", "value"], spark.createDataFrame(sum(forest, []), NODES)).collect() if r["tree"] > 0}
    assert raw == {k: pytest.approx(sum(walked(t, x) for t in forest) / 9) for k, *x in rows if k > 0}


def test_rows_between_the_same_thresholds_go_down_once(spark, monkeypatch):
    draw, met = random.Random(4), []
    forest = [[(t, 0, t % 2, c, 1, 2, t == 1, None), (t, 1, None, None, None, None, None, 1.0 + t), (t, 2, None, None, None, None, None, 10.0 * t)] for t, c in enumerate((0.0, 0.5, -0.5, float("inf")))]
    forest.append([(4, 0, 2, None, 1, 2, True, None), (4, 1, None, None, None, None, None, 7.0), (4, 2, None, None, None, None, None, 9.0)])  # no value is at or below null
    values = [[draw.choice([None, float("nan"), -0.5, -0.0, 0.0, 0.5, float("inf"), draw.uniform(-1, 1)]) for _ in range(3)] for _ in range(400)]
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "k long, a double, b double, c double")
    numbered = trees.numbered
    monkeypatch.setattr(trees, "numbered", lambda rows, *rest: met.append(rows.count()) or numbered(rows, *rest))
    nodes = spark.createDataFrame(sum(forest, []), NODES)
    walk = lambda t, x: t[1 if (t[0][6] if x[t[0][2]] is None or math.isnan(x[t[0][2]]) else t[0][3] is not None and x[t[0][2]] <= t[0][3]) else 2][7]
    want = {k: pytest.approx(sum(walk(t, x) for t in forest) / 5) for k, x in enumerate(values)}
    found = ensemble_predictions(df, ["a", "b", "c"], nodes)
    assert {r["k"]: r["prediction"] for r in found.collect()} == want
    assert met[0] <= 4 * 4 * 2
    assert "hashpartitioning(__key" not in found._jdf.queryExecution().sparkPlan().toString() and "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(trees, "CUTS", 2)  # too many thresholds: told apart by their values
    assert {r["k"]: r["prediction"] for r in ensemble_predictions(df, ["a", "b", "c"], nodes).collect()} == want
    assert met[1] > 100


def test_no_trees_no_rows_and_circles(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    none = spark.createDataFrame([], NODES)
    leaf = spark.createDataFrame([(0, 0, None, None, None, None, None, 2.0)], NODES)
    assert [r["prediction"] for r in ensemble_predictions(df, ["x"], none).collect()] == [None]
    assert ensemble_predictions(df.limit(0), ["x"], leaf).collect() == []
    assert [r["prediction"] for r in ensemble_predictions(df, ["x"], leaf).collect()] == [2.0]
    circle = spark.createDataFrame([(0, 0, 0, 0.0, 0, 0, True, None)], NODES)
    with pytest.raises(Exception, match="circle"):
        ensemble_predictions(df, ["x"], circle).collect()


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_positions_follow_files_blocks_and_rows(spark, tmp_path, monkeypatch, kind):
    rows = [(f"{k:05d}", "x" * (k % 50)) for k in range(5000)]
    path = str(tmp_path / kind)
    for n, (a, b) in enumerate([(0, 1200), (1200, 1201), (1201, 5000)]):
        part = spark.createDataFrame(rows[a:b], "k string, v string").coalesce(1)
        part.write.mode("append").format(kind).save(f"{path}/{n}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = spark.read.format(kind).schema("k string, v string").load([f"{path}/{n}" for n in range(3)])
        assert df.rdd.getNumPartitions() > (3 if kind == "csv" else 2)
        # files are in the order of their paths
        assert [(r["k"], r["position"]) for r in positioned(df).orderBy("position").collect()] == [(k, i) for i, (k, _) in enumerate(rows)]
        short = spark.read.format(kind).schema("k string, v string").load(f"{path}/0")
        met = side_by_side(df, short).orderBy("position").collect()
        assert [(r["k"], r["k_right"]) for r in met] == [(k, rows[i][0] if i < 1200 else None) for i, (k, _) in enumerate(rows)]
        assert met[0].asDict().keys() == {"position", "k", "v", "k_right", "v_right"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rows_that_meet_a_block_are_not_gathered_by_it(spark):
    """A join by shuffle on the block would send all rows of one to a task, and here all rows are of one."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(5000).select(F.lit(0).cast("long").alias("block"), F.col("id").alias("x"))
        heads = spark.createDataFrame([(0, 1.0), (0, 2.0)], "block long, h double")
        met = meeting.behind(rows, heads, "block", "x", together=100)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert met.filter("not head").agg(F.countDistinct("x"), F.countDistinct("salt")).first() == (5000, 50)
        assert met.filter("head").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
