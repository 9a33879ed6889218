"""Hand-sized cases of the expressions."""

import math
import random
import threading
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqrank import constants as K
from seqrank.functions import kinetics, kmers, motifs, residues, strings, vectors
from seqrank.operators.alignment import Packed, all_scores, best_match, block_scores


def one(spark, expression, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], names)
    return df.select(expression(*(F.col(c) for c in names)).alias("x")).first()["x"]


def charge(sequence, ph):
    if not sequence:
        return 0.0
    q = 1 / (1 + 10 ** (ph - K.PK_N_TERMINAL.get(sequence[0], K.PK_N_TERMINUS))) - 1 / (1 + 10 ** (K.PK_C_TERMINAL.get(sequence[-1], K.PK_C_TERMINUS) - ph))
    q += sum(1 / (1 + 10 ** (ph - K.PK_POSITIVE[c])) for c in sequence if c in K.PK_POSITIVE)
    return q - sum(1 / (1 + 10 ** (K.PK_NEGATIVE[c] - ph)) for c in sequence if c in K.PK_NEGATIVE)


def test_clean_sequence(spark):
    assert one(spark, residues.clean_sequence, s="ab-zuojx*k1") == "ANQCKLK"


def test_pro_gly_counts_case(spark):
    assert one(spark, residues.pro_gly_fraction, s="PGpgA") == pytest.approx(0.4)
    assert one(spark, residues.pro_gly_fraction, s="") == 0.0


def test_composition(spark):
    df = residues.with_counts(spark.createDataFrame([("DEKRH",), ("",)], "sequence string"))
    out = residues.composition(F.col("n"), F.length("sequence"))
    rows = df.select("sequence", *(v.alias(k) for k, v in out.items())).orderBy(F.desc("sequence")).collect()
    assert (rows[0]["len"], rows[0]["frac_acidic"], rows[0]["frac_basic"], rows[0]["net_charge_proxy"]) == (5, 0.4, 0.6, 0.0)
    assert len(out) == 24 and rows[1]["frac_A"] == 0.0


def test_charge_against_python_and_falls_with_ph(spark):
    rng = random.Random(1)
    cases = ["", "A", "E", *("".join(rng.choice(K.AMINO_ACIDS) for _ in range(rng.randrange(1, 60))) for _ in range(30))]
    df = residues.with_counts(spark.createDataFrame([(s,) for s in cases], "sequence string"))
    out = df.select("sequence", *(residues.net_charge(F.col("sequence"), F.col("n"), F.lit(ph)).alias(str(i)) for i, ph in enumerate((3.0, 5.5, 7.4, 9.0)))).collect()
    for r in out:
        got = [r[str(i)] for i in range(4)]
        assert got == pytest.approx([charge(r["sequence"], ph) for ph in (3.0, 5.5, 7.4, 9.0)])
        assert not r["sequence"] or got == sorted(got, reverse=True)


def test_isoelectric_point_has_no_charge(spark):
    df = residues.with_counts(spark.createDataFrame([("MKRDEHHCY",), ("AAAA",)], "sequence string"))
    for r in df.select("sequence", residues.isoelectric_point(F.col("sequence"), F.col("n")).alias("p")).collect():
        assert abs(charge(r["sequence"], r["p"])) < 1e-3


def test_instability_uses_the_callers_table(spark):
    df = spark.createDataFrame([(1, "AAC"), (2, "A"), (3, "")], "k long, sequence string")
    w = spark.createDataFrame([("AA", 2.0), ("AC", -1.0)], "pair string, weight double")
    assert {r["k"]: r["instability"] for r in residues.instability_index(df, w, "k").collect()} == {1: pytest.approx(10 / 3), 2: 0.0, 3: 0.0}


def brute_motif(s, pattern):
    hits = [i + 2 for i in range(len(s) - 4) if (s[i], s[i + 2], s[i + 4]) == pattern and 10 <= i + 2 <= len(s) - 11]
    return min(hits, key=lambda c: (abs(c - math.floor(len(s) * 0.4)), c)) if hits else -1


def test_motif_against_brute_force(spark):
    rng = random.Random(2)
    cases = ["", "GAS", "AAAAAAAGASAGAAAAAAAAAAA", "A" * 8 + "GASAGA" + "A" * 20, *("".join(rng.choice("GSA") for _ in range(rng.randrange(1, 90))) for _ in range(60))]
    df = spark.createDataFrame([(s,) for s in cases], "s string").select("s", motifs.motif_center(F.col("s")).alias("c"))
    assert all(r["c"] == brute_motif(r["s"], ("G", "S", "G")) for r in df.collect())


def test_motif_at_nine_is_absent(spark):
    assert one(spark, motifs.motif_center, s="A" * 7 + "GASAG" + "A" * 30) == -1
    assert one(spark, motifs.motif_center, s="A" * 8 + "GASAG" + "A" * 30) == 10


def test_windows_and_runs_against_brute_force(spark):
    rng = random.Random(3)
    cases = ["", "AAAG", "GAILGVV", *("".join(rng.choice("AGDV") for _ in range(rng.randrange(1, 40))) for _ in range(40))]
    df = spark.createDataFrame([(s,) for s in cases], "s string").select("s", motifs.max_hydrophobic_window(F.col("s")).alias("w"), motifs.max_hydrophobic_run(F.col("s")).alias("r"))
    for r in df.collect():
        h = [int(c in K.HYDROPHOBIC) for c in r["s"]]
        want = 0.0 if not h else sum(h) / len(h) if len(h) < 9 else max(sum(h[i : i + 9]) for i in range(len(h) - 8)) / 9
        assert r["w"] == pytest.approx(want)
        assert r["r"] == max(map(len, "".join(map(str, h)).split("0")), default=0)
    assert one(spark, motifs.max_hydrophobic_run, s="GAILGVV") == 3


def test_fnv(spark):
    assert one(spark, lambda s: kmers.fnv1a(s, 3, 4096), s="GES") == 2494


def test_centrality_by_sums_is_the_mean_of_pairs(spark):
    df = spark.createDataFrame([(1, "a", "ACDEFG"), (2, "a", "ACDEYY"), (3, "a", "WWWACD"), (4, "b", "ACD")], "id long, g string, sequence string")
    v = kmers.unit_vectors(kmers.kmer_buckets(df, ["id", "g"]), ["id", "g"])
    got = {r["id"]: r["centrality"] for r in kmers.centrality(v, "id", "g").collect()}
    dense = {}
    for r in v.collect():
        dense.setdefault(r["id"], {})[r["bucket"]] = r["w"]
    cos = lambda a, b: sum(w * dense[b].get(k, 0) for k, w in dense[a].items())
    for i in (1, 2, 3):
        assert got[i] == pytest.approx(sum(cos(i, j) for j in (1, 2, 3) if j != i) / 2)
    assert got[4] == 1.0


def textbook_lcs(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, t[j + 1] = t[j + 1], old + 1 if x == y else max(t[j + 1], t[j])
    return t[-1]


def test_lcs():
    rng = random.Random(4)
    assert Packed(["GXTXAYB"]).lcs("AGGTAB") == [4]
    made = lambda: "".join(rng.choice("ACDG") for _ in range(rng.randrange(0, 40)))
    for _ in range(20):
        refs = [made() for _ in range(rng.randrange(1, 30))]
        packed = Packed(refs)
        for _ in range(5):
            a = made()
            assert packed.lcs(a) == [textbook_lcs(a, b) for b in refs]


def test_best_match_rules(spark):
    refs = spark.createDataFrame([(1, "CCC"), (2, "ACD"), (3, "ACD")], "ref_id long, ref_sequence string")
    rows = spark.createDataFrame([("aaa",), ("WWW",), ("ACDE",)], "sequence string")
    got = {r["sequence"]: (r["best_ref_id"], r["best_score"]) for r in best_match(block_scores(rows, refs)).collect()}
    assert all_scores(rows, refs).count() == 9
    assert got == {"aaa": (2, 1), "WWW": (None, 0), "ACDE": (2, 3)}


def test_strings(spark):
    assert one(spark, strings.hamming_rate, a="ACDE", b="ACDF") == 25.0
    assert one(spark, strings.hamming_rate, a="ACDE", b="ACD") is None
    assert one(spark, lambda n: strings.length_penalty(n, F.lit(250)), n=200) == pytest.approx(-0.2)
    assert one(spark, lambda n: strings.length_penalty(n, F.lit(250), 1.5), n=200) == pytest.approx(-0.0894427, abs=1e-7)
    assert one(spark, strings.both_ends, s="A" * 600 + "C" * 600) == "A" * 500 + "C" * 500
    assert one(spark, strings.spaced, s="ABU") == "A X X"
    assert strings.csv_out_name("x.csv", "_pH_opt") == "x_pH_opt.csv"
    ids = one(spark, lambda s: strings.token_ids(F.split(s, ""), F.create_map(F.lit("C"), F.lit(7)), 4), s="CxC")
    assert ids == [3, 7, 1, 7, 2, 0]


def test_kinetics(spark):
    v0 = lambda k, m, s: kinetics.michaelis_menten(k * 60, m, s, kinetics.mgml_to_molar(F.lit(1.0), F.lit(30.0)))
    assert one(spark, v0, k=10.0, m=1.0, s=1.0) == pytest.approx(0.01)
    assert one(spark, v0, k=10.0, m=-1.0, s=1.0) is None
    assert one(spark, v0, k=10.0, m=1.0, s=0.0) == 0.0
    assert one(spark, lambda r: kinetics.specific_activity(r, F.lit(1.0), F.lit(1.0)), r=0.01) == pytest.approx(0.01)
    assert one(spark, lambda r: kinetics.specific_activity(r, F.lit(1.0), F.lit(1.0), "uM"), r=0.01) == pytest.approx(0.00001)
    assert one(spark, lambda r: kinetics.specific_activity(r, F.lit(0.0), F.lit(1.0)), r=0.01) is None
    with pytest.raises(ValueError):
        kinetics.specific_activity(F.lit(1.0), F.lit(1.0), F.lit(1.0), "M")


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0, 1.0])], "a array<double>, z array<double>, b array<double>")
    r = df.select(vectors.cosine_or_zero(F.col("a"), F.col("z")).alias("zero"), vectors.cosine_safe(F.col("a"), F.col("b")).alias("c"), vectors.l2_normalised(F.col("b")).alias("u")).first()
    assert (r["zero"], r["c"]) == (0.0, pytest.approx(math.sqrt(0.5))) and r["u"] == pytest.approx([math.sqrt(0.5)] * 2)


def test_instability_makes_no_row_per_dipeptide(spark):
    """The rows of a sequence never pass an exchange, and what isn't in the table counts nothing."""
    rng = random.Random(5)
    pairs = {a + b: round(rng.uniform(-2, 2), 3) for a in "ACDE" for b in "ACDF"}
    w = spark.createDataFrame(list(pairs.items()), "pair string, weight double")
    cases = [*("".join(rng.choice("ACDEFGé\U0001f600") for _ in range(rng.randrange(0, 40))) for _ in range(300)), None]
    out = residues.instability_index(spark.createDataFrame(list(enumerate(cases)), "k long, sequence string"), w, "k")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {k: 10 / len(s) * sum(pairs.get(s[i : i + 2], 0) for i in range(len(s) - 1)) if s else 0.0 for k, s in enumerate(cases)}
    assert {r["k"]: r["instability"] for r in out.collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_slices_bound_what_a_worker_holds(spark, monkeypatch):
    """Windows and motifs of 2,000 texts of 2,000 residues: a slice of the batch at a time, with the same results."""
    rng = random.Random(6)
    some = ["".join(rng.choice("GSAVLK") for _ in range(rng.randrange(0, 60))) for _ in range(50)]
    texts = pd.Series([*some, *(x * 2000 for x in "VG" * 975)])
    held = []

    def peak(f):
        tracemalloc.start()
        out = f(texts)
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return out.tolist()

    made = []
    monkeypatch.setattr(F, "pandas_udf", lambda f, kind: (made.append(f), lambda c: c)[1])
    spark.range(1)  # an active session
    motifs.max_hydrophobic_window(F.lit("A"))
    motifs.motif_center(F.lit("A"))
    windows, centers = (peak(f) for f in made)
    assert max(held) < 40e6
    assert windows[:50] == [max((sum(x in K.HYDROPHOBIC for x in s[i : i + 9]) for i in range(max(1, len(s) - 8))), default=0) / min(9, len(s)) if s else 0.0 for s in some]
    assert centers[:50] == [brute_motif(s, ("G", "S", "G")) for s in some] and windows[50:52] == [1.0, 0.0]


@pytest.mark.parametrize("valid_only", [False, True])
def test_vectors_are_a_row_for_each_key(spark, valid_only):
    """Counted without a shuffle of k-mers; rows of one key are added up."""
    rng = random.Random(7)
    rows = [(i % 37, "".join(rng.choice("ACBDé") for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    want: dict = {}
    for i, s in rows:
        for word in (s[j : j + 3] for j in range(len(s) - 2)):
            if not valid_only or set(word) <= set(K.AMINO_ACIDS):
                h = K.FNV_OFFSET
                for x in word:
                    h = (h ^ ord(x)) * K.FNV_PRIME & K.FNV_MASK
                own = want.setdefault(i, {})
                own[h % K.KMER_DIM] = own.get(h % K.KMER_DIM, 0) + 1
    v = kmers.kmer_vectors(spark.createDataFrame(rows, "k long, sequence string"), ["k"], valid_only=valid_only)
    got = {r["k"]: r for r in v.collect()}
    assert {k: dict(zip(r["buckets"], r["counts"], strict=True)) for k, r in got.items()} == want
    for k, r in got.items():
        assert list(r["buckets"]) == sorted(r["buckets"])
        assert r["weights"] == pytest.approx([c / math.sqrt(sum(x * x for x in want[k].values())) for c in r["counts"]])


def test_batches_of_texts_are_bounded(spark, monkeypatch):
    """Long texts and many short ones: what a worker is sent at once is bounded, by bytes and by rows, unless the session's owner has other bounds."""
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {x: spark.conf.get(x) for x in names}
    seen = lambda texts, found, kind: pd.Series([float(max(texts.str.len().sum() / 1e7, len(texts) / 2000))] * len(texts))
    monkeypatch.setattr(motifs, "in_slices", seen)
    largest = lambda df: df.select(motifs.max_hydrophobic_window(F.col("s")).alias("x")).agg(F.max("x")).first()[0]
    long, short = (spark.range(0, n, 1, 1).select(F.repeat(F.lit("V"), size).alias("s")) for n, size in ((100, 300_000), (9000, 3)))
    try:
        for x in names:
            spark.conf.unset(x)
        assert largest(long) <= 1 and largest(short) <= 1
        spark.conf.set(names[0], 5000)
        assert largest(short) == 2.5
    finally:
        for x, value in before.items():
            spark.conf.set(x, value)


def test_batches_are_bounded_in_threads_and_by_any_form_of_bound(spark):
    """A thread without an active session uses the application's; an owner's bound may have a unit."""
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {x: spark.conf.get(x) for x in names}
    found = []

    def asked():
        motifs.max_hydrophobic_window(F.lit("A"))
        found.append([spark.conf.get(x) for x in names])

    def in_thread():
        thread = threading.Thread(target=asked)
        thread.start()
        thread.join()

    try:
        for x in names:
            spark.conf.unset(x)
        in_thread()
        spark.conf.set(names[1], "4m")
        in_thread()
        asked()
        assert found == [["2000", str(8 << 20)], ["2000", "4m"], ["2000", "4m"]]
    finally:
        for x, value in before.items():
            spark.conf.set(x, value)
