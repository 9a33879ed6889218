import numpy as np
import pytest

from seqrank.llm import top_k as module
from seqrank.llm.top_k import LEVELS, _of_block, statistics, survivors, top_k

VECTORS = "vec_id long, embedding array<float>, label int, key string, q string, ids string, id string, score string"


def brute(rows, every, k):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)
            if sum(x * x for x in q) < 1 << 62:
                kept[(i, q)] = None
    out = []
    for i, q in kept:
        if i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, p, strict=True)), j) for j, p in kept if j != i and len(p) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, every=20, k=20):
    df = spark.createDataFrame([(i, v, 1, *"xxxxx") for i, v in rows], VECTORS)
    return sorted(tuple(r) for r in top_k(df, k=k).collect())


@pytest.fixture()
def small_blocks(monkeypatch):
    for name, value in (("BLOCK", 48), ("QUERY_BLOCK", 5), ("FIRST", 1)):
        monkeypatch.setattr(module, name, value)


def test_against_brute_force_over_many_blocks(spark, small_blocks):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 24))
    rows = [(i, (centres[i % 8] + 0.2 * rng.standard_normal(24)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # copies, more than a list holds
    rows += [(2000 + i, rng.integers(-1, 2, 24).astype(float).tolist()) for i in range(100)]  # ties
    assert run(spark, rows) == brute(rows, 20, 20)


def test_cases(spark):
    bad = [(0, None), (20, [1.0, None]), (40, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (80, [3e38, 0.0]), (None, [1.0, 1.0])]
    assert run(spark, bad) == []
    assert run(spark, []) == []
    rows = bad + [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (120, [1.0, 2.0]), (1, [0.5, -0.5]), (140, [1.0, 2.0, 3.0]), (160, []), (2, []), (120, [0.0, 1.0]), (3, [3e6, -3e6]), (180, [3e7, 1e7])]
    assert run(spark, rows) == brute(rows, 20, 20)
    assert run(spark, rows, k=1) == brute(rows, 20, 1)


@pytest.mark.parametrize("dims", [0, 1, 3, 5, 16, 64, 70])
def test_statistics_bound_scores_and_refine(dims):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-50, 50, (20, dims)), rng.integers(-50, 50, (300, dims))
    real = a @ b.T
    before = np.full(real.shape, np.inf)
    for s in LEVELS:
        bound = statistics(a, s) @ statistics(b, s).T if dims else np.zeros(real.shape)
        assert (bound >= real - 1e-6).all() and (bound <= before + 1e-6).all()
        before = bound if dims >= s else before
    end = np.sort(real, axis=1)[:, -5].astype(float)
    levels = [statistics(a, s) for s in LEVELS], [statistics(b, s) for s in LEVELS]
    rows, cols, left = survivors(a, b, end, *levels, np.full(20, 1e-6))
    assert {tuple(p) for p in np.argwhere(real >= end[:, None])} <= set(zip(rows.tolist(), cols.tolist(), strict=True))
    assert left == sorted(left, reverse=True)


def test_clusters_are_pruned_and_wide_integers_exact():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (40, 4)).repeat(16, axis=1)
    a, b = centres[:20] + rng.integers(-3, 4, (20, 64)), centres.repeat(50, axis=0) + rng.integers(-3, 4, (2000, 64))
    real = a @ b.T
    end = np.sort(real, axis=1)[:, -20].astype(float)
    _, _, left = survivors(a, b, end, [statistics(a, s) for s in LEVELS], [statistics(b, s) for s in LEVELS], np.full(20, 1e-6))
    assert left[-1] < 0.1 * real.size
    wide = rng.integers(-(1 << 27), 1 << 27, (30, 64))
    rows, ids, score = _of_block(wide[:3], wide, np.full(3, -np.inf), np.arange(30), np.ones(30, np.int64), 4)
    for r in range(3):
        want = sorted(((-sum(int(x) * int(y) for x, y in zip(wide[r], w, strict=True)), j) for j, w in enumerate(wide)))[:4]
        assert sorted(zip((-score[rows == r]).tolist(), ids[rows == r].tolist(), strict=True)) == want
