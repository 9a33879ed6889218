import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrank.operators import clusters, minibatch
from seqrank.operators.minibatch import minibatch_clusters


def families(n, sizes=(12,)):
    draw = random.Random(3)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    heads = {k: ["".join(draw.choice(letters) for _ in range(k)) for _ in range(4)] for k in sizes}
    return ["".join(draw.choice(letters) if draw.random() < 0.08 else c for c in draw.choice(heads[draw.choice(sizes)])) for _ in range(n)]


def inertia(found):
    return found.agg(F.sum(1 - F.col("similarity"))).first()[0]


@pytest.fixture(scope="module")
def words(spark):
    rows = [(w, "x", "y") for w in [*families(240), "AC", "AC", "", None, "ACDE", "zz" * 3]]
    return spark.createDataFrame(rows, "sequence string, c string, slot string")


def test_invariants_and_inertia(spark, words):
    found = minibatch_clusters(words, rounds=6).cache()
    distinct = {r[0] for r in words.filter("sequence <> ''").select("sequence").distinct().collect()}
    assert {r["sequence"] for r in found.collect()} == distinct and found.count() == len(distinct)
    assert found.groupBy("cluster_id").agg(F.countDistinct("seq_len").alias("n")).filter("n > 1").isEmpty()
    ids = sorted({r["cluster_id"] for r in found.collect()})
    assert ids == list(range(len(ids)))
    sizes = {r["seq_len"]: r["k"] for r in clusters.group_policy(words.distinct()).collect()}
    for r in found.groupBy("seq_len").agg(F.countDistinct("cluster_id").alias("n")).collect():
        assert r["n"] <= sizes[r["seq_len"]]
    assert found.filter("similarity < -1e-9 or similarity > 1 + 1e-9").isEmpty()
    # every row is with its nearest centre's members: the plain rounds from hashed seeds aren't better
    assert inertia(found) <= inertia(clusters.clusters(words)) + 1e-9
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, minibatch_clusters(words.repartition(7), rounds=6).collect()))


def test_rounds_end_by_themselves(spark, words, monkeypatch):
    made = []
    real = minibatch.nearest
    monkeypatch.setattr(minibatch, "nearest", lambda v, c: made.append(1) or real(v, c))
    monkeypatch.setattr(minibatch, "SMOOTH", 0.0)
    minibatch_clusters(words, seeding="hashed", rounds=30, patience=1, batch=240).count()
    assert 3 <= len(made) < 25


def test_empty_and_small_tables(spark, words):
    assert minibatch_clusters(words.limit(0)).collect() == []
    small = minibatch_clusters(words.filter("length(sequence) < 5"))
    assert sorted((r["sequence"], r["cluster_id"], r["similarity"]) for r in small.collect()) == [("AC", 0, 1.0), ("ACDE", 1, 1.0)]


def test_a_learning_rate_is_one_over_the_rows_had(spark):
    """One cluster, batches of one row each: the centre is the mean of the rows so far."""
    vectors = spark.createDataFrame([("a", 3, 1, 1.0), ("b", 3, 2, 1.0), ("c", 3, 3, 1.0)], "key string, seq_len int, bucket int, w double")
    policy = spark.createDataFrame([(3, 3)], "seq_len int, n long")
    seeds = spark.createDataFrame([(3, "a", 1)], "seq_len int, key string, c long")
    slots = {k: int(__import__("hashlib").md5(k.encode()).hexdigest()[:8], 16) % 3 for k in "abc"}
    centre = {r["bucket"]: r["w"] for r in minibatch.minibatch_centres(vectors, policy, seeds, batch=1, rounds=3, patience=None).collect()}
    had = [k for r in range(3) for k in "abc" if slots[k] == r]
    assert centre == {{"a": 1, "b": 2, "c": 3}[k]: pytest.approx(1 / len(had)) for k in had}


def test_nearest_of_many_centres_makes_no_row_for_each(spark):
    """More centres than lie side by side, against brute force; no shuffle has the centre as its key."""
    rng = np.random.default_rng(3)
    x, y = rng.random((40, 6)).round(3), rng.random((30, 6)).round(3)
    x[:, 4:] = 0
    x[0], y[:7, :4], y[20] = [0, 0, 0, 0, 0, 1], 0, y[10]
    x /= np.linalg.norm(x, axis=1)[:, None]
    flat = lambda m: [(str(i), 3, b, float(v)) for i, row in enumerate(m) for b, v in enumerate(row) if v]
    vectors = spark.createDataFrame(flat(x), "key string, seq_len int, bucket int, w double")
    centres = spark.createDataFrame([(n, int(i) * 7, b, w) for i, n, b, w in flat(y)], "seq_len int, c long, bucket int, w double")
    found = minibatch.nearest(vectors, centres)
    assert not re.search(r"hashpartitioning\(key#\d+, seq_len#\d+, c#", found._jdf.queryExecution().executedPlan().toString())
    d = 1 + (y * y).sum(1)[None, :] - 2 * x @ y.T
    want = {str(i): (int(np.argmin(row.round(9))) * 7, row.min()) for i, row in enumerate(d)}
    got = {r["key"]: (r["c"], r["d"]) for r in found.collect()}
    assert {k: c for k, (c, _) in got.items()} == {k: c for k, (c, _) in want.items()}
    assert [got[k][1] for k in sorted(want)] == pytest.approx([max(0, want[k][1]) for k in sorted(want)])
