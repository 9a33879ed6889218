import itertools
import math

import numpy as np
import pytest

from seqrank.operators.profiles import Profile, emissions, paths, profile_scores, profiles, transitions

ALIGNED = [("f", "AC-DE"), ("f", "AC-D-"), ("f", "A-CDE"), ("f", "-C-de"), ("g", "AA"), ("g", "A"), ("g", None), ("g", ""), (None, "AA"), ("h", "X.A")]
ALPHABET = "ACDE"


def tables(spark, rows=ALIGNED):
    return spark.createDataFrame(rows, "family string, aligned string").selectExpr("*", "'x' AS node", "'y' AS size", "'z' AS number")


def test_paths(spark):
    found = {(r["family"], r["size"]): 0 for r in paths(tables(spark)).collect()}
    assert set(found) == {("f", 4), ("g", 2), ("h", 2)}
    got = sorted("".join(s["state"] + (s["residue"] or "") for s in r["path"]) for r in paths(tables(spark)).filter("family = 'f'").collect())
    assert got == sorted(["MMAMCMDMEM", "MMAMCMDDM", "MMADICMDMEM", "MDMCMDMEM"])


def test_probabilities_add_up(spark):
    found = paths(tables(spark))
    for r in emissions(found, ALPHABET).groupBy("family", "node", "state").sum("probability").collect():
        assert r[-1] == pytest.approx(1)
    for r in transitions(found).groupBy("family", "node", "source").sum("probability").collect():
        assert r[-1] == pytest.approx(1)


def enumerated(e, t, size, text):
    """Every path of a text through the states: the best one's and the sum of all logarithmic odds."""
    scores = []

    def go(node, state, i, score):
        for target in "MID":
            step = t.get((node, state, target))
            if step is None:
                continue
            after = node if target == "I" else node + 1
            if target == "M" and after == size + 1:
                if i == len(text):
                    scores.append(score + math.log(step))
            elif target == "D":
                go(after, "D", i, score + math.log(step))
            elif i < len(text):
                odds = math.log(e[after, target, text[i]] * len(ALPHABET)) if text[i] in ALPHABET else 0.0
                go(after, target, i + 1, score + math.log(step) + odds)

    go(0, "M", 0, 0.0)
    return max(scores), math.log(sum(map(math.exp, scores)))


def test_scores_against_every_path(spark):
    df = tables(spark)
    found = paths(df)
    e, t = emissions(found, ALPHABET).collect(), transitions(found).collect()
    texts = ["", "A", "ACDE", "acd", "CCXA", "EDCA", "AACDDE", "Z"]
    rows = spark.createDataFrame([(x,) for x in [*texts, None, "A"]], "sequence string")
    got = {(r["sequence"], r["family"]): (r["viterbi"], r["forward"]) for r in profile_scores(rows, profiles(df, alphabet=ALPHABET), alphabet=ALPHABET).collect()}
    assert len(got) == 3 * len(texts)
    for (text, family), (best, every) in got.items():
        own = {(r["node"], r["state"], r["residue"]): r["probability"] for r in e if r["family"] == family}
        steps = {(r["node"], r["source"], r["target"]): r["probability"] for r in t if r["family"] == family}
        want = enumerated(own, steps, 2 if family != "f" else 4, text.upper())
        assert (best, every) == pytest.approx(want, abs=1e-9), (text, family)


def test_long_sequences_and_odd_batches():
    """Scores of a batch are those of its texts alone, of any length."""
    rng = np.random.default_rng(1)
    size, letters = 6, len(ALPHABET)
    e = np.log(rng.dirichlet(np.ones(letters), 2 * size + 1) * letters).ravel().tolist()
    steps = []
    for source, target in itertools.product("DIM", repeat=2):
        steps += np.log(rng.uniform(0.1, 0.9, (size if target == "D" else size + 1) - (source == "D"))).tolist()
    profile = Profile(size, e, steps, ALPHABET)
    texts = ["".join(rng.choice(list(ALPHABET), n)) for n in (0, 3, 6, 7, 50, 2000)]
    for add in (np.maximum, np.logaddexp):
        together = profile.scores(texts, add)
        assert np.isfinite(together).all()
        assert together == pytest.approx([profile.scores([t], add)[0] for t in texts])


def test_empty_tables(spark):
    none = tables(spark).limit(0)
    assert emissions(paths(none), ALPHABET).collect() == [] and transitions(paths(none)).collect() == []
    rows = spark.createDataFrame([("A",)], "sequence string")
    assert profile_scores(rows, profiles(none, alphabet=ALPHABET), alphabet=ALPHABET).collect() == []
    assert profile_scores(rows.limit(0), profiles(tables(spark), alphabet=ALPHABET), alphabet=ALPHABET).collect() == []
