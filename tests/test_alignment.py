import hashlib
import random

import pytest

from seqrank.operators import alignment
from seqrank.operators.alignment import all_scores, best_match, best_references, block_scores, matched, mismatch_columns, mutations
from seqrank.plans.sequence_queries import lcs_all_scores
from seqrank.session import stored


def table_of(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def textbook(a, b):
    """Pairs by the stated rule: pass over a's place, then b's, while the score stays; else they match."""
    t, i, j, out = table_of(a, b), len(a), len(b), []
    while i and j:
        if t[i - 1][j] == t[i][j]:
            i -= 1
        elif t[i][j - 1] == t[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out


def columns(a, b):
    """The alignment's two rows, gaps put behind what faces each other."""
    a, b = a.lower(), b.lower()
    top, bottom, x, y = [], [], 0, 0
    for i, j in [*textbook(a, b)[::-1], (len(a), len(b))]:
        p, q = a[x:i], b[y:j]
        top.append(p.ljust(len(q), "-") + a[i : i + 1])
        bottom.append(q.ljust(len(p), "-") + b[j : j + 1])
        x, y = i + 1, j + 1
    return "".join(top), "".join(bottom)


def test_traceback_against_a_textbook_table():
    draw = random.Random(1)
    for _ in range(400):
        a, b = ("".join(draw.choice("ACDE"[: draw.randrange(1, 5)]) for _ in range(draw.randrange(0, 40))) for _ in range(2))
        assert matched(a, b) == textbook(a, b), (a, b)
        score, wrong = mismatch_columns(a, b)
        assert score == table_of(a, b)[-1][-1]
        if len(a) == len(b):
            assert wrong == sum(x != y for x, y in zip(a, b))
        else:
            top, bottom = columns(a, b)
            assert len(top) == len(bottom) and top.replace("-", "") == a.lower() and bottom.replace("-", "") == b.lower()
            assert wrong == sum(x != y and x != "-" and y != "-" for x, y in zip(top, bottom))


def test_traceback_of_long_strings_matches_a_subsequence():
    draw = random.Random(2)
    a = "".join(draw.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(6000))
    b = "".join(c for c in a if draw.random() < 0.9)
    pairs = matched(a, b)
    assert len(pairs) == len(b) and all(a[i] == b[j] for i, j in pairs)
    assert all(i > k and j > m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_mutations_of_a_table(spark):
    rows = [(1, "ACDE", "ACDF"), (2, "ACDEF", "ACF"), (3, "acde", "ACDE"), (4, None, "A"), (5, "A", None), (6, "", ""), (7, "AC", ""), (8, "", "AC"), (1, "ACDE", "ACDF"), (9, "AXXC", "AYC")]
    df = spark.createDataFrame(rows, "id long, sequence string, ref_sequence string").selectExpr("*", "'x' AS n", "'y' AS block")
    got = sorted(((r["id"], r["score"], r["mismatches"], r["gaps"], r["mutation_rate"]) for r in mutations(df).collect()), key=lambda r: r[0])
    third = 1 / 3 * 100.0
    assert [r[:4] for r in got] == [(1, 3, 1, 0), (1, 3, 1, 0), (2, 3, 0, 2), (3, 4, 0, 0), (4, None, None, None), (5, None, None, None), (6, 0, 0, 0), (7, 0, 0, 2), (8, 0, 0, 2), (9, 2, 1, 1)]
    assert [r[4] for r in got] == pytest.approx([25.0, 25.0, 0.0, 0.0, None, None, None, None, 0.0, third])


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 20)
    monkeypatch.setattr(alignment, "TOGETHER", 7)


def family(draw, n, sizes):
    """Sequences in families: mutants of a few of very unlike composition."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    heads = ["".join(draw.choice(draw.sample(letters, 6)) for _ in range(draw.choice(sizes))) for _ in range(12)]
    return ["".join(draw.choice(letters) if draw.random() < 0.05 else c for c in draw.choice(heads)) for _ in range(n)]


def test_the_search_finds_what_all_scores_hold(spark, small_blocks):
    draw = random.Random(3)
    texts = family(draw, 150, (30, 60, 90))
    refs = [(k, t) for k, t in enumerate(texts[:70])] + [(100, texts[0]), (-1, texts[5]), (101, None), (102, ""), (103, "ß" * 9)]
    rows = [*texts[40:], None, "", "000", "zzß", texts[0], texts[0]]
    df = spark.createDataFrame([(t,) for t in rows], "sequence string")
    known = spark.createDataFrame(refs, "ref_id long, ref_sequence string")
    want = sorted(tuple(r) for r in best_match(block_scores(df, known)).collect())
    got = sorted(tuple(r) for r in best_references(df, known).collect())
    assert [(s, i, x) for s, i, x, _, _ in got] == [(s, i, x) for s, i, x in want]
    assert all(n == 74 and scored <= n for *_, scored, n in got)
    assert sum(r[3] for r in got) < 0.75 * 74 * len(got)
    assert all_scores(df, known).count() == 74 * len(got)
    assert best_references(df, known.limit(0)).collect() == [] and best_references(df.limit(0), known).collect() == []


def test_more_references_are_left_out(spark):
    """Ten times the references, most of other composition: the share that is scored falls."""
    draw = random.Random(4)
    shares = []
    for times in (1, 10):
        refs = family(random.Random(5), 60, (80, 81)) + [t for _ in range(times - 1) for t in family(draw, 60, (40, 60, 80, 120))]
        df = spark.createDataFrame([(t,) for t in refs[:40]], "sequence string")
        rows = best_references(df, spark.createDataFrame(list(enumerate(refs)), "ref_id long, ref_sequence string")).collect()
        shares.append(sum(r["scored"] for r in rows) / sum(r["references"] for r in rows))
        assert all(refs[r["best_ref_id"]] == r["sequence"] for r in rows)
    assert shares[1] < 0.5 * shares[0]


def test_bounds_of_blocks_meet_sequences_without_a_shuffle_by_block(spark, monkeypatch):
    """Without automatic broadcasts, too: no join of the search has the block as the key of a shuffle."""
    plans = []

    def kept(df, name, keep=False):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name, keep)

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(alignment, "stored", kept)
    try:
        df, refs = spark.createDataFrame([("ACDA",), ("DD",)], "sequence string"), spark.createDataFrame([(1, "ACA"), (2, "D")], "ref_id long, ref_sequence string")
        got = {r["sequence"]: (r["best_ref_id"], r["best_score"]) for r in best_references(df, refs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {"ACDA": (1, 3), "DD": (2, 1)}
    assert "SortMergeJoin" not in dict(plans)["pairs"]


def test_scores_are_a_row_for_each_sequence_and_block(spark):
    """Not one for each pack, each with the sequence beside it."""
    rng = random.Random(8)
    refs = [(i, "".join(rng.choice("ACD") for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    texts = ["".join(rng.choice("ACDe") for _ in range(rng.randrange(0, 15))) for _ in range(30)]
    df, known = spark.createDataFrame([(t,) for t in texts], "sequence string"), spark.createDataFrame(refs, "ref_id long, ref_sequence string")
    rows = block_scores(df, known).collect()
    assert len(rows) == len(set(texts))
    for r in rows:
        assert {f["ref_id"]: (f["ref_length"], f["score"]) for f in r["found"]} == {i: (len(s), len(matched(r["sequence"].lower(), s.lower()))) for i, s in refs}


def test_scores_by_key_and_carries_of_many_steps(spark):
    """Every step carries out of every reference; whole sequences are shuffled twice, and rows meet their scores by a digest."""
    refs = [(40 - i, "A" * i + "C" * (i % 3)) for i in range(40)]
    texts = ["A" * k for k in (0, 1, 7, 8, 9, 16, 17, 100)] + ["AC" * 30, "CA" * 9 + "A" * 50]
    df, known = spark.createDataFrame([(t,) for t in texts], "sequence string"), spark.createDataFrame(refs, "ref_id long, ref_sequence string")
    got = {r["key"]: [tuple(f) for f in r["found"]] for r in block_scores(df, known, by="key").collect()}
    assert got == {hashlib.md5(t.encode()).hexdigest(): [(i, len(s), len(matched(t.lower(), s.lower()))) for i, s in sorted(refs)] for t in texts}
    plan = lcs_all_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "Join [sequence" not in plan and "keys=[sequence" in plan
    assert block_scores(df, known).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # not merged by bytes to a few
