import itertools
import math
import random
import zlib

import numpy as np

from seqrank.llm.quality import BUCKETS, Model, fit, grams, kth_largest, resampled, selected


def corpus():
    rng = random.Random(1)
    good = ["river", "stone", "walks", "under", "quiet", "light", "over", "green", "hills"]
    bad = ["!!", "%%%", "BUY", "###", "|"]
    rows, labels = [], []
    for k in range(900):
        junk = k % 5 == 0
        rows.append((k, " ".join(rng.choice(bad if junk and rng.random() < 0.6 else good) for _ in range(rng.randrange(20, 80)))))
        if k % 3:
            labels.append((k, 0 if junk else 1, 0))
    return rows, labels


def test_bad_documents_go_and_good_ones_stay(spark, documents):
    rows, labels = corpus()
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    odd = [(9000, None), (9001, ""), (9002, "river stone " * 20_000), (None, "quiet light over green hills")]
    out = {r["doc_id"]: r for r in resampled(documents(rows + odd), lab).collect()}
    held_out = [k for k, _ in rows if k % 3 == 0]
    good = [out[k]["selected"] for k in held_out if k % 5]
    bad = [out[k]["selected"] for k in held_out if k % 5 == 0]
    assert all(good) and sum(bad) <= 0.5 * len(bad)
    scores = [(out[k]["log_weight"], k % 5 != 0) for k in held_out]
    pos, neg = [s for s, y in scores if y], [s for s, y in scores if not y]
    assert np.mean([a > b for a in pos for b in neg]) > 0.99
    assert out[9000]["n_grams"] == 0 and out[9000]["log_weight"] == 0.0
    kept = selected(documents(rows + odd), lab)
    assert kept.columns == documents([]).columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in out.items() if r["selected"]}


def test_weights_are_log_ratios(spark, documents):
    rows, labels = corpus()
    model = fit(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    wanted = {k for k, y, _ in labels if y}
    for k, t in rows:
        seen = np.bincount(grams(t.encode()), minlength=BUCKETS)
        raw += seen
        good += seen * (k in wanted)
    p = (raw + 0.5) / (raw + 0.5).sum()
    assert np.allclose(model.ratio, np.log((0.95 * good / good.sum() + 0.05 * p) / p), atol=1e-4)


M64 = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def buckets(text):
    """The n-grams' buckets by plain arithmetic, a byte at a time."""
    kinds = ["blank" if b == 32 or 9 <= b <= 13 else "word" if b >= 128 or chr(b).isalnum() or b == 95 else "sign" for b in text]
    tokens = [bytes(b for _, b in run) for kind, run in itertools.groupby(zip(kinds, text, strict=True), key=lambda x: x[0]) if kind != "blank"]
    hashes = [mixed((sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(t)) + len(t)) & M64) for t in tokens]
    return [h % BUCKETS for h in hashes] + [mixed((3 * x + 5 * y) & M64) % BUCKETS for x, y in itertools.pairwise(hashes)]


def noise(i, text, seed):
    key = (zlib.crc32(text) + (i or 0) * 0x9E3779B97F4A7C15) & M64
    u = mixed(key ^ mixed(seed)) >> 11
    return -math.log(-math.log((u + 0.5) / (1 << 53)))


def test_keys_and_the_selected_set_against_brute_force(spark, documents):
    rows, labels = corpus()
    rng = random.Random(7)
    rows = [(k, t + rng.choice([" é\U0001f600 x_1!", "", "\n\tend", "..."])) for k, t in rows] + [(9000, None), (9001, ""), (9002, "!"), (None, "quiet light")]
    lab = [*labels, (9001, 1, 0), (None, 1, 0)]
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    wanted = {k for k, y, _ in lab if y and k is not None}
    for k, t in rows:
        for g in buckets((t or "").encode()):
            raw[g] += 1
            good[g] += k in wanted
    total, total_good = sum(raw) + 0.5 * BUCKETS, sum(good)
    ratio = [math.log((0.95 * y / total_good + 0.05 * (x + 0.5) / total) / ((x + 0.5) / total)) for x, y in zip(raw, good, strict=True)]
    known = [y for k, y, _ in lab if k is not None]
    share = sum(known) / len(known)
    share = min(1.0, share + 2 * math.sqrt(share * (1 - share) / len(known)) + 0.002)
    keys = {k: sum(ratio[g] for g in buckets((t or "").encode())) + noise(k, (t or "").encode(), 11) for k, t in rows}
    cut = sorted(keys.values(), reverse=True)[math.ceil(len(rows) * share) - 1]
    out = {r["doc_id"]: r for r in resampled(documents(rows), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")).collect()}
    assert all(abs(out[k]["gumbel_key"] - v) < 1e-3 for k, v in keys.items())
    assert {k for k, r in out.items() if r["selected"]} == {k for k, v in keys.items() if v >= cut} and len(out) == len(rows)


def test_empty_texts_compete_with_weight_zero(spark, documents):
    # k = 1 of 4: the empty text is drawn before texts of negative weight, and goes where one has a large weight
    lab = spark.createDataFrame([(1, 1, 0)] + [(k, 0, 0) for k in range(100, 200)], "doc_id long, quality int, toxic int")
    rows = [(1, "quiet light over green hills " * 30), (2, "%% || ## " * 30), (3, "%% ## || " * 30), (4, None)]
    got = {r["doc_id"]: r for r in resampled(documents(rows), lab).collect()}
    assert got[4]["log_weight"] == 0.0 and got[2]["log_weight"] < 0 < got[1]["log_weight"] and {k for k, r in got.items() if r["selected"]} == {1}
    without = fit(documents(rows), lab)
    assert without.keys([4, 2], [None, "%% || ## " * 30])[2].argmax() == 0


def test_noise_is_the_same_when_a_task_runs_again():
    model = Model(np.zeros(BUCKETS), 1.0, 3)
    a, b = model.keys([1, None], ["x", None]), model.keys([1, None], ["x", None])
    assert np.array_equal(a[2], b[2]) and a[2][0] != a[2][1]


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    for values in ([float(k % 7) for k in range(100)], rng.normal(size=500).tolist(), [1.0] * 50, [0.0, 1e-300, -1e300, 1e300]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for k in (1, 2, len(values) // 2, len(values) - 1):
            assert kth_largest(df, k, bins=4, few=5) == sorted(values, reverse=True)[k - 1]
        assert kth_largest(df, len(values)) == -np.inf


def test_without_labels_or_rows_everything_stays(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "a b"), (1, "a b"), (None, None)]
    assert resampled(documents(rows), none).filter("selected").count() == 3 and selected(documents(rows), none).count() == 3
    assert resampled(documents([]), none).collect() == [] and selected(documents([]), none).collect() == []
