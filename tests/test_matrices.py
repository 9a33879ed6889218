import random

import pytest

from seqrank.operators import matrices
from seqrank.operators.matrices import Matrix, matrix_scores, matrix_with_all

SCALE = {"A": 1, "C": 4, "D": 9, "E": 10}
MATRIX = [(a, b, float(5 - abs(x - y))) for a, x in SCALE.items() for b, y in SCALE.items()]


def gotoh(a, b, opened, extended, score):
    """The textbook's three tables."""
    low = -1e9
    h = [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    e, f = [r[:] for r in h], [r[:] for r in h]
    h[0][0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                e[i][j] = max(h[i - 1][j] - opened, e[i - 1][j] - extended)
            if j:
                f[i][j] = max(h[i][j - 1] - opened, f[i][j - 1] - extended)
            if i and j:
                h[i][j] = h[i - 1][j - 1] + score(a[i - 1], b[j - 1])
            h[i][j] = max(h[i][j], e[i][j], f[i][j])
    return h[-1][-1]


def pair_score(x, y):
    known = {(a, b): s for a, b, s in MATRIX}
    return known.get((x.upper(), y.upper()), -1.0)


@pytest.mark.parametrize("opened,extended", [(3, 1), (2, 2), (11, 1), (0.5, 0.25)])
def test_against_the_textbook(opened, extended):
    draw = random.Random(opened)
    pairs = [("".join(draw.choice("ACDEX") for _ in range(draw.randrange(0, 25))), "".join(draw.choice("acde-") for _ in range(draw.randrange(0, 25)))) for _ in range(200)]
    got = Matrix(MATRIX, -1.0).pairs([a for a, _ in pairs], [b for _, b in pairs], opened, extended)
    assert got == pytest.approx([gotoh(a, b, opened, extended, pair_score) for a, b in pairs])


def test_a_matrix_need_not_be_symmetric():
    rows = [("A", "C", 7.0), ("C", "A", -5.0), ("A", "A", 1.0), ("C", "C", 1.0)]
    known = {(a, b): s for a, b, s in rows}
    for a, b in (("AAC", "CCCCA"), ("CCCCA", "AAC")):
        assert Matrix(rows, 0.0).pairs([a], [b], 2, 1) == [gotoh(a, b, 2, 1, lambda x, y: known[x, y])]


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(matrices, "BLOCK", 3)
    matrix = spark.createDataFrame(MATRIX, "a string, b string, score double")
    rows = [(1, "ACDE", "ACE"), (2, None, "A"), (3, "A", None), (4, "", "ACD"), (5, "", ""), (1, "ACDE", "ACE")]
    df = spark.createDataFrame(rows, "id long, sequence string, ref_sequence string").selectExpr("*", "'x' AS score", "'y' AS block")
    got = sorted(((r["id"], r["matrix_score"]) for r in matrix_scores(df, matrix).collect()), key=lambda r: r[0])
    assert got == [(1, 4.0), (1, 4.0), (2, None), (3, None), (4, -13.0), (5, 0.0)]
    refs = spark.createDataFrame([(k, "ACDE"[k % 4 :] * (k + 1)) for k in range(8)] + [(9, None)], "ref_id long, ref_sequence string")
    every = {(r["sequence"], r["ref_id"]): r["matrix_score"] for r in matrix_with_all(df, refs, matrix).collect()}
    assert every == {(a, k): pytest.approx(gotoh(a, "ACDE"[k % 4 :] * (k + 1), 11, 1, pair_score)) for a in ("ACDE", "A", "") for k in range(8)}
    assert matrix_with_all(df.limit(0), refs, matrix).collect() == [] and matrix_with_all(df, refs.limit(0), matrix).collect() == []


def test_a_long_pair_and_bad_matrices(spark):
    a = "ACDE" * 700
    assert Matrix(MATRIX, -1.0).pairs([a], [a[:1400] + a[1404:]], 11, 1) == [5.0 * (len(a) - 4) - 14]
    df = spark.createDataFrame([("A", "A")], "sequence string, ref_sequence string")
    with pytest.raises(ValueError):
        matrix_scores(df, spark.createDataFrame([("AB", "C", 1.0)], "a string, b string, score double"))
    with pytest.raises(ValueError):
        matrix_scores(df, spark.createDataFrame(MATRIX, "a string, b string, score double"), opened=1, extended=2)
