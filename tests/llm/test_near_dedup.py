import random
import re
from collections import Counter

import numpy as np

from seqrank.llm import near_dedup
from seqrank.llm.components import components
from seqrank.llm.near_dedup import near_groups, shingle_set


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i in sorted(sets):
        seen = Counter(j for s in sets[i] for j in by.get(s, ()))
        for j, n in seen.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    passage = [word() for _ in range(60)]
    texts = []
    for size in (30, 120, 300):
        base = [word() for _ in range(size)]
        for _ in range(45):  # a family of near copies, from close to far
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(100)] + passage) for _ in range(40)]  # share a passage only
    texts += [" ".join(word() for _ in range(rng.randrange(1, 50))) for _ in range(100)]
    texts += ["same text over here"] * 30 + ["Same  TEXT\nover here", "", " ", None, "one", "ONE", "two words", "É x y z", "é x y z", "w " * 30_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_against_brute_force(documents):
    rows = corpus()
    for width, percent in ((3, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(documents(rows), width=width, percent=percent).collect()}
        assert got == brute(rows, width, percent)


def test_long_lists_in_small_blocks_give_the_same(documents, monkeypatch):
    for name, value in (("SHORT", 3), ("BLOCK", 16), ("LONG_BLOCK", 16), ("REST_BLOCK", 8), ("CONFIRM", 4)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = corpus(2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(documents(rows), width=3, percent=85).collect()}
    assert got == brute(rows, 3, 85)


def test_blocks_follow_the_lists_real_size(documents, monkeypatch):
    for name, value in (("SHORT", 2), ("BLOCK", 4), ("LONG_BLOCK", 4), ("REST_BLOCK", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    chains = []  # x ~ y ~ z, but not x ~ z
    for c in range(40):
        x = [f"w{c}x{k}" for k in range(60)]
        chains += [x, [*x[4:], *(f"v{c}x{k}" for k in range(4))], [*x[8:], *(f"v{c}x{k}" for k in range(8))]]
    families = []  # eight near copies each, some too far from their base
    rng = random.Random(8)
    for f in range(60):
        base = [f"b{f}x{k}" for k in range(80)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(80)] = f"c{rng.random()}"
            families.append(copy)
    rows = [(k, " ".join(t)) for k, t in enumerate(chains + families)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_groups(documents(rows), width=3, percent=85).collect()}
    want = brute(rows, 3, 85)
    assert got == want and len({c for i, (_, c) in want.items() if i < 120}) == 40


def test_an_id_with_two_texts_keeps_both_sets(documents):
    one, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(3, one), (5, one + " more"), (5, other), (9, other + " more"), (7, None)]
    got = sorted(map(tuple, near_groups(documents(rows)).select("doc_id", "component_id").collect()))
    assert got == [(3, 3), (5, 3), (5, 5), (7, 7), (9, 5)]


def test_keys_of_one_class_alone_are_not_posted(spark):
    keys = [[100 * d + k for k in range(32)] for d in range(3)]
    keys[1][:20], keys[2][:2] = keys[0][:20], keys[0][:2]
    lists = near_dedup.postings(spark.createDataFrame(list(enumerate(keys)), "doc long, keys array<long>"), 0.85).collect()
    prefix = 32 - near_dedup.least_matches(32, 0.85) + 1
    assert Counter(r["doc"] for r in lists) == {0: prefix - 12, 1: prefix - 12}  # two shared keys are not in a prefix behind 30 of one's own
    assert all(r["n"] == (3 if r["key"] < 2 else 2) for r in lists)


def test_rows_without_ids_stand_alone(documents):
    rows = [(2, "a b c d"), (2, "a b c d"), (1, "A b c  d"), (None, "a b c d"), (None, None), (5, None)]
    got = sorted(map(tuple, near_groups(documents(rows), width=3, percent=85).collect()), key=str)
    assert got == sorted([(2, 2, 1, False), (2, 2, 1, False), (1, 2, 1, True), (None, 2, None, True), (None, 0, None, True), (5, 0, 5, True)], key=str)
    assert near_groups(documents([])).collect() == []


def test_shingles():
    assert len(shingle_set("", 3)) == 0 and len(shingle_set("a", 3)) == 1 and len(shingle_set("a b c d", 3)) == 2
    assert np.array_equal(shingle_set("A B\tc", 3), shingle_set("a b c", 3))
    assert not np.array_equal(shingle_set("a b", 3), shingle_set("b a", 3))
    assert not np.array_equal(shingle_set("ab c", 3), shingle_set("a bc", 3))


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    text = " ".join(f"{k * 7919 % 100_003}" for k in range(40_000)) + " " + "x" * 70_000 + " y z"
    whole = shingle_set(text, 3)
    monkeypatch.setattr("seqrank.llm.hashing.CHUNK", 1 << 10)
    assert np.array_equal(shingle_set(text, 3), whole) and len(whole) == 40_001


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_exploded_keys_are_not_broadcast(spark, tmp_path):
    # Spark sizes them by the arrays' file, ten times too low and more, so they look small enough on large tables too
    rows = [(k, [100 * (k % 3) + c for c in range(near_dedup.COORDS)]) for k in range(40)]
    spark.createDataFrame(rows, "doc long, keys array<long>").write.parquet(str(tmp_path / "classes"))
    found = near_dedup.postings(spark.read.parquet(str(tmp_path / "classes")), 0.8)
    assert "Broadcast" not in physical(found) and "SortMergeJoin" in physical(found)
    assert {r["doc"] for r in found.collect()} == set(range(40))
