import hashlib

import numpy as np
import pytest

from seqrank.llm.lloyd import assigned, cluster_table

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, q string, distance string, n string"


def brute(rows, clusters, rounds, dims):
    """Python integers, one vector at a time."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in start[:clusters]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    found = [(i, *nearest(q)[::-1]) for i, q in kept]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, k, d in found), key=str)


def run(spark, rows, **parameters):
    df = spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], VECTORS)
    return sorted((tuple(r) for r in cluster_table(df, **parameters).collect()), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) + 3 * (i % 3)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # copies of one vector: ties and a hot cluster
    assert run(spark, rows, clusters=7, rounds=5, dims=6) == brute(rows, 7, 5, 6)


def test_cases(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0, 3.0]), (7, [3e38, 0.0])]
    assert run(spark, bad, dims=2) == []
    assert run(spark, [], dims=2) == []
    good = [(10, [0.5, -0.5]), (10, [0.5, -0.5]), (None, [9.0, 9.0]), (11, [-0.001, 0.0]), (12, [9.0, 9.25])]
    for clusters in (1, 2, 40):
        assert run(spark, bad + good, clusters=clusters, rounds=3, dims=2) == brute(bad[:6] + good, clusters, 3, 2)


def test_lowest_centroid_of_equals_and_large_components():
    q = np.array([[0, 0], [1 << 28, -(1 << 28)]], np.int64)
    nearest, distance = assigned(q, np.array([[1, 0], [0, 1], [-1, 0]], np.int64))
    assert nearest.tolist() == [0, 0] and distance.tolist() == [1, (1 << 28) ** 2 + ((1 << 28) - 1) ** 2]


@pytest.mark.parametrize("parts", [1, 7])
def test_any_split_gives_the_same(spark, parts):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(120)]
    df = spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], VECTORS).repartition(parts)
    assert sorted((tuple(r) for r in cluster_table(df, clusters=5, dims=4).collect()), key=str) == brute(rows, 5, 5, 4)
