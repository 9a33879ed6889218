"""Rules of the table operators, the models and the plans."""

import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqrank.functions import kmers
from seqrank.operators import assays, cache, clusters, embeddings, folds, joins, metrics, models, stats, wild_types
from seqrank.plans import pipelines, scores
from seqrank.schema import col_or_lit, require_columns
from seqrank.session import stored
from seqrank.sources import tables
from seqrank.streaming.features import featurised


def column(df, name):
    return [r[name] for r in df.collect()]


def numbers(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")


def test_schema(spark):
    df = numbers(spark, [1.0])
    assert require_columns(df, ["x"], "s") is df
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(df, ["y"], "s")
    assert df.select(col_or_lit(df, "y", 3.0).alias("y")).first()["y"] == 3.0


def test_scaling(spark):
    assert column(stats.zscore(numbers(spark, [1.0, 2.0, 3.0]), ["x"]).orderBy("i"), "z_x") == pytest.approx([-1, 0, 1])
    assert column(stats.zscore(numbers(spark, [5.0, 5.0]), ["x"]), "z_x") == [0.0, 0.0]
    got = column(stats.robust_z(numbers(spark, [1.0, 2.0, 3.0, 4.0, 100.0]), ["x"]).orderBy("i"), "g_x")
    assert got == pytest.approx([(v - 3) / (1.4826 * (1 + 1e-8)) for v in (1, 2, 3, 4, 100)])
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, x double")
    assert sorted(column(stats.centered(rows, ["x"], "g"), "c_x")) == [-1.0, 0.0, 1.0]


def test_guards_and_imputation(spark):
    values = [float("nan"), float("inf"), float("-inf"), 2.0, None]
    assert column(numbers(spark, values).select("i", stats.finite_or(F.col("x")).alias("y")).orderBy("i"), "y") == [-10.0, 10.0, -10.0, 2.0, -10.0]
    assert column(stats.impute_median(numbers(spark, [1.0, None, 5.0]), ["x"]).orderBy("i"), "x") == [1.0, 3.0, 5.0]
    assert stats.checked_finite(numbers(spark, [1.0]), ["x"]).count() == 1
    with pytest.raises(Exception, match="isn't finite"):
        stats.checked_finite(numbers(spark, [float("inf")]), ["x"]).collect()


def test_exact_quantiles_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 20)
    monkeypatch.setattr(stats, "ACCURACY", 50)
    rng = random.Random(3)
    columns = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)],
        "ties": [float(rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(3000)],
        "half": [0.0] * 1500 + [rng.random() + 1 for _ in range(1500)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(3000)],
        "one": [7.0] * 3000,
        "gaps": [None if k % 3 else rng.random() for k in range(3000)],
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(3)
    at = (0.0, 0.1, 0.25, 0.5, 0.501, 0.9, 1.0)
    got = stats.exact_quantiles(df, {c: F.col(c) for c in columns}, at)
    for c, v in columns.items():
        want = np.quantile([x for x in v if x is not None], at)
        assert got[c] == pytest.approx(want.tolist(), rel=1e-12), c
    odd = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "a double, b double")
    assert stats.exact_quantiles(odd, {"a": F.col("a"), "b": F.col("b")}, (0.5,)) == {"a": [None], "b": [1.0]}


def test_modes_and_firsts(spark):
    rows = numbers(spark, [5.0, 3.0, 3.0, 5.0])
    assert stats.mode_smallest(rows, "x").first()["mode"] == 3.0
    assert stats.mode_first_seen(rows, "x", "i").first()["mode"] == 5.0
    assert sorted(column(stats.first_by_key(rows, ["x"], "i"), "i")) == [0, 1]
    assert [tuple(r) for r in stats.top_frequencies(rows, "x", 1).collect()] == [(3.0, 2)]


def test_joins(spark):
    refs = spark.createDataFrame([(1, "A" * 240), (2, "C" * 260)], "ref_id long, ref_sequence string")
    rows = spark.createDataFrame([("D" * 250,), ("E" * 260,)], "sequence string")
    assert {len(r["sequence"]): r["ref_id"] for r in joins.nearest_length(rows, refs).collect()} == {250: 1, 260: 2}
    assert {len(r["sequence"]): r["ref_sequence"][0] for r in joins.exact_length_or_first(rows, refs).collect()} == {250: "A", 260: "C"}
    pairs = spark.createDataFrame([("k", 1, 0), ("k", 2, 1)], "k string, v int, o int")
    assert joins.lookup_last(spark.createDataFrame([("k",), ("z",)], "k string"), pairs, "k", "v", "o").orderBy("k").select("v").collect()[0][0] == 2
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.missing_keys(left, right, ["k"]).collect()[0]["k"] == 2
    with pytest.raises(ValueError, match="unmapped"):
        joins.require_mapped(left, right, ["k"])
    with pytest.raises(ValueError, match="no rows"):
        joins.inner_nonempty(left.filter("k = 2"), right, ["k"])
    assert column(joins.or_itself(left.withColumn("r", F.lit(None).cast("int")), "r", "k").orderBy("k"), "r") == [1, 2]


def test_pivot_drops_keys_that_lack_any(spark):
    rows = [("a ", 5.5, 1.0, 0), ("a", 5.5, 9.0, 1), ("a", 7.0, 2.0, 2), ("a", 8.5, 3.0, 3), ("b", 5.5, 1.0, 4), ("b", 8.5, 2.0, 5)]
    df = spark.createDataFrame(rows, "id string, ph double, v double, o int")
    wide = assays.pivot_first(df, "id", "ph", "v", "o", (5.5, 7.0, 8.5), "ph_")
    assert [(r["id"], r["ph_5_5"]) for r in wide.collect()] == [("a", 1.0)]
    two = assays.pivot_first(df, "id", "ph", "v", "o", (5.5, 7.0, 8.5), "ph_", (5.5, 8.5))
    assert sorted(column(two, "id")) == ["a", "b"]


def brute_ndcg(pred, truth, fraction=0.1):
    n = len(pred)
    k = max(1, int(n * fraction))
    lo, hi = min(truth), max(truth)
    if hi == lo:
        return 0.0
    gain = [(t - lo) / (hi - lo) for t in truth]
    top = lambda key: sorted(range(n), key=lambda i: (key[i], i), reverse=True)[:k]
    dcg = lambda order: sum(gain[i] / math.log2(p + 2) for p, i in enumerate(order))
    return dcg(top(pred)) / dcg(top(truth))


def test_metrics(spark):
    rng = np.random.default_rng(0)
    pred, truth = rng.integers(0, 9, 40).astype(float).tolist(), rng.integers(0, 9, 40).astype(float).tolist()
    df = spark.createDataFrame([(i, p, t, int(t > 4)) for i, (p, t) in enumerate(zip(pred, truth, strict=True))], "i long, p double, t double, y int")
    assert metrics.ndcg_top_fraction(df, "p", "t", "i").first()["ndcg"] == pytest.approx(brute_ndcg(pred, truth))
    assert metrics.ndcg_top_fraction(df, "t", "t", "i").first()["ndcg"] == 1.0
    assert metrics.ndcg_top_fraction(df.withColumn("t", F.lit(1.0)), "p", "t", "i").first()["ndcg"] == 0.0
    assert metrics.ndcg_top_fraction(df.limit(5), "p", "t", "i").first()["k"] == 1
    rank = lambda v: [sum(x < a for x in v) + (sum(x == a for x in v) + 1) / 2 for a in v]
    assert metrics.spearman(df, "p", "t").first()["rho"] == pytest.approx(np.corrcoef(rank(pred), rank(truth))[0, 1])
    assert metrics.spearman(df.withColumn("t", F.lit(1.0)), "p", "t").first()["rho"] == 0.0
    pos, neg = [p for p, t in zip(pred, truth, strict=True) if t > 4], [p for p, t in zip(pred, truth, strict=True) if t <= 4]
    assert metrics.auc(df, "p", "y").first()["auc"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    assert metrics.auc(df.filter("y = 1"), "p", "y").first()["auc"] is None


def test_folds(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 13).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    grouped = folds.grouped(df, "g")
    assert grouped.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert grouped.select("fold").distinct().count() == 5
    assert {r["count"] for r in folds.stratified(df, "id", "y").filter("y = 1").groupBy("fold").count().collect()} <= {13, 14}
    assert folds.kfold(df, "id").select("fold").distinct().count() == 5
    with pytest.raises(ValueError):
        folds.grouped(df.filter("g = 1"), "g")


def test_grouped_folds_are_dealt_greedily(spark):
    rng = random.Random(2)
    for sizes in ([1] * 23, [9, 9, 9, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], [50] + [3] * 40 + [2] * 17, [rng.randrange(1, 12) for _ in range(60)], [5, 4]):
        rows = [(f"g{g:02}", k) for g, n in enumerate(sizes) for k in range(n)]
        got = {r["g"]: r["fold"] for r in folds.grouped(spark.createDataFrame(rows, "g string, k int"), "g").select("g", "fold").distinct().collect()}
        weight, want = [0] * min(5, len(sizes)), {}
        for n, g in sorted(((n, f"g{g:02}") for g, n in enumerate(sizes)), key=lambda x: (-x[0], x[1])):
            f = weight.index(min(weight))
            weight[f], want[g] = weight[f] + n, f
        assert got == want


def test_ridge_and_logistic_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.1] + [0, 2, 7]
    y = x @ [1.0, -0.5, 3.0] + rng.normal(size=80)
    label = (y > np.median(y) + 0.5).astype(int)
    df = spark.createDataFrame([(*map(float, a), float(b), int(c), i % 4) for i, (a, b, c) in enumerate(zip(x, y, label, strict=True))], "a double, b double, c double, y double, l int, fold int")
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    m = models.ridge(df, ["a", "b", "c"], "y")
    assert column(m.predict(df), "prediction") == pytest.approx((z @ w + y.mean()).tolist())
    held = models.ridge_folds(df, ["a", "b", "c"], "y", "fold")
    direct = models.ridge(df.filter("fold <> 2"), ["a", "b", "c"], "y")
    assert held[2].weights == pytest.approx(direct.weights)
    g = models.logistic(df, ["a", "b", "c"], "l")
    p = np.array(column(g.predict(df), "prediction"))
    weight = np.where(label == 1, 80 / (2 * label.sum()), 80 / (2 * (80 - label.sum())))
    gradient = z.T @ (weight * (p - label)) + np.array(g.weights) * x.std(0)
    assert np.abs(gradient).max() < 1e-6
    m.save(spark, str(tmp_path / "model"))
    assert models.Linear.load(spark, str(tmp_path / "model")) == m
    for found in ({"mae": 1.0}, {"mae": 0.25, "rmse": None, "n": np.int64(3)}):  # written anew over the first
        models.save_metrics(spark, found, str(tmp_path / "metrics"))
    assert models.load_metrics(spark, str(tmp_path / "metrics")) == {"mae": 0.25, "rmse": None, "n": 3}
    assert min(column(models.predict_at(df, m, "a", -100.0, "low"), "low")) == 0.0


def test_clusters_hold_their_invariants(spark):
    words = [f"{a}{b}CDE" for a in "ACDEFGHIKL" for b in "ACDEFGHIKLMN"] + ["AC", "ACDEFG", "ACDEFG", ""]
    out = clusters.clusters(spark.createDataFrame([(w,) for w in words], "sequence string")).cache()
    assert out.count() == 122 and out.select("sequence").distinct().count() == 122
    assert out.groupBy("cluster_id").agg(F.countDistinct("seq_len").alias("n")).filter("n > 1").isEmpty()
    ids = sorted({r["cluster_id"] for r in out.collect()})
    assert ids == list(range(len(ids)))
    assert out.filter("seq_len = 5").select("cluster_id").distinct().count() <= 3
    reps = clusters.representatives(out)
    assert reps.agg(F.sum("cluster_size")).first()[0] == 122
    k = spark.createDataFrame([(49,), (50,), (200,), (600,), (1500,), (1,)], "n long").select(clusters.choose_k(F.col("n")).alias("k"))
    assert column(k, "k") == [2, 3, 5, 8, 12, 1]


def test_wild_types(spark):
    rows = spark.createDataFrame([("c0", "ACDEF"), ("c0", "ACDEY"), ("c0", "WWWWW"), ("c0", "ACDEFGHI"), ("c1", " KLMN"), ("c2", "PPPP")], "cluster_id string, sequence string")
    wild = spark.createDataFrame([(0, "ACDEF"), (1, "ACDEY"), (2, "WWWWW"), (3, "ACDEFGHI"), (4, "KLMN "), (5, "KLMN")], "wt_id long, wt_sequence string")
    found = wild_types.candidates(rows, wild)
    got = {r["cluster_id"]: (r["wt_id"], round(r["wt_centrality"], 6)) for r in wild_types.choose(found, rows).collect()}
    assert got == {"c0": (0, round((2 / 3) / 2, 6)), "c1": (5, 1.0), "c2": (-1, 0.0)}
    assert wild_types.sequence_map(rows, wild_types.choose(found, rows)).count() == 6


def test_embedding_cache(spark, tmp_path):
    rows = spark.createDataFrame([("AA",), ("CC",)], "sequence string")
    asked = []

    def provide(missing):
        asked.append(sorted(r["sequence"] for r in missing.collect()))
        return missing.select("key", F.array(F.length("sequence").cast("double")).alias("embedding"))

    path = str(tmp_path / "cache")
    assert cache.filled(spark, rows, path, "m", provide).count() == 2
    more = rows.union(spark.createDataFrame([("DD",)], "sequence string"))
    assert cache.filled(spark, more, path, "m", provide).count() == 3
    assert asked == [["AA", "CC"], ["DD"]]
    bad = spark.createDataFrame([("AA", None), ("CC", [float("nan")])], "sequence string, embedding array<double>")
    bad.select(F.sha1(F.concat_ws("|", F.lit("m"), "sequence")).alias("key"), "embedding").write.parquet(str(tmp_path / "bad"))
    (tmp_path / "bad" / "part-broken.parquet").write_bytes(b"PAR1 cut off")
    out = cache.filled(spark, rows, str(tmp_path / "bad"), "m", provide).collect()
    assert asked[2] == ["AA", "CC"] and [list(r["embedding"]) for r in out] == [[2.0], [2.0]]
    given = spark.createDataFrame([(1, None, 0.25), (2, 0.5, 0.0)], "i int, delta_emb double, wt_cosine_sim double")
    assert column(embeddings.delta_given(given).orderBy("i"), "delta_emb") == [0.75, 0.5]
    vec = spark.createDataFrame([("AA", [1.0, 0.0]), ("CC", [0.0, 1.0])], "sequence string, embedding array<double>")
    out = embeddings.with_delta(rows.withColumn("wt_sequence", F.lit("AA")), vec).orderBy("sequence").collect()
    assert [round(r["delta_emb"], 6) for r in out] == [0.0, 1.0]


def test_profile_composite(spark):
    raw = [(0.37646138598163154, 343.6, 128.8, 239.3, -6113.0), (0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(raw, "supervised double, family_hmm double, site_hmm double, homologs_hmm double, blosum double")
    a, b = scores.profile_composite(df).collect()
    assert a["unsupervised"] == pytest.approx(3.3878890809450217) and a["composite"] == pytest.approx(1.0046267272635454)
    assert b["composite"] is None


def test_recipes_run_and_clip(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i == 3) * 1e9) for i in range(50)], "i long, align double, phopt double, instability double")
    out = scores.final_parameters(df, "aggressive").collect()
    assert min(r["activity_1"] for r in out) == -25.0 and all(abs(r["expression"]) <= 25 for r in out)
    rows = spark.createDataFrame([(f"{'ACDEFGHIKL' * 3}{'GASAG' if i % 2 else 'AAAAA'}{'MNPQRSTVWY' * (2 + i % 3)}", i % 3, -float(i % 4), -1.0) for i in range(30)], "sequence string, cluster_id int, ll double, rep_ll double")
    got = scores.cluster_aware(rows)
    assert got.count() == 30 and got.filter("activity_1 is null or isnan(activity_1)").isEmpty()


def test_recipes_take_one_worker_for_each_task(spark, monkeypatch):
    """Motif and window, and in R6 the other features of Python, are evaluated together: beside each other they'd take a worker each."""
    held = []
    monkeypatch.setattr(scores, "stored", lambda df, name, keep=False: (held.append(df), stored(df, name, keep))[1])
    rows = spark.createDataFrame([("ACDEFGHIKLGASAG" * 4, 0, -1.0, -2.0), ("WWAV", 1, -3.0, -1.0)], "sequence string, cluster_id int, ll double, rep_ll double")
    weights = spark.createDataFrame([("AC", 1.0)], "pair string, weight double")
    scores.cluster_aware(rows)
    scores.properties(rows, weights=weights)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (held[0], held[-1])]
    assert [plan.count("ArrowEvalPython") for plan in plans] == [1, 1]
    assert sorted(column(held[0], "agg_window")) == sorted(column(held[-1], "agg_window")) == [pytest.approx(5 / 9), 1.0]


@pytest.mark.parametrize("recipe", [scores.cluster_aware, lambda df: scores.properties(df, scale=False)])
def test_recipes_bound_batches_in_the_session_of_their_rows(spark, recipe):
    """The rows' session may be another than the active one: its batches are those that go to the workers."""
    own = spark.newSession()
    rows = own.range(1).selectExpr("'ACDEFGHIKLGASAG' AS sequence", "0 AS cluster_id", "-1D AS ll", "-2D AS rep_ll")
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    for x in names:
        own.conf.unset(x)
    recipe(rows)
    assert [own.conf.get(x) for x in names] == ["2000", str(8 << 20)]


def test_pipelines(spark):
    rows = spark.createDataFrame([(f"{'ACDEFGHIKL' * 4}{'MNPQRSTVWY'[: i % 5 + 1]}",) for i in range(10)], "sequence string").distinct()
    refs = spark.createDataFrame([(0, "ACDEFGHIKL" * 4 + "M"), (1, "WWWWWW")], "wt_id long, wt_sequence string")
    table = pipelines.property_table(rows, refs)
    assert table.count() == 5 and table.filter("wt_sequence is null or best_score is null").isEmpty()
    found = clusters.clusters(rows)
    reps = clusters.representatives(found)
    ll = rows.select("sequence", (-F.length("sequence") / 10).alias("ll"))
    out = pipelines.zero_shot(rows, found, reps, ll, rows.select("sequence", F.lit(0.1).alias("delta_emb")))
    assert out.columns == ["sequence", *pipelines.OFFICIAL.values()] and out.count() == 5
    assay = spark.createDataFrame([(f"s{i % 8}", float(i % 5), float(i)) for i in range(40)], "sample_id string, ph double, activity double")
    features = spark.createDataFrame([(f"s{i}", float(i * i)) for i in range(8)], "sample_id string, f double")
    model, score = pipelines.supervised(assay, features, ["f", "ph"], "activity")
    assert len(model.weights) == 2 and -1 <= score.first()["rho_mean"] <= 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿,Unnamed: 3,v\n x1 ,9,1.5\nx2,8,bad\n", encoding="utf-8")
    df = tables.without_unnamed(tables.named_index(tables.read_csv(spark, str(tmp_path / "a.csv"))))
    assert df.columns == ["sample_id", "v"] and sorted(column(df, "sample_id")) == ["x1", "x2"]
    (tmp_path / "b.fasta").write_text(">one some words\nACD\nEFG\n>two\nKLM\n")
    assert [tuple(r) for r in tables.read_fasta(spark, str(tmp_path / "b.fasta")).orderBy("id").collect()] == [("one", "ACDEFG"), ("two", "KLM")]
    (tmp_path / "arrow.fasta").write_text(">a mutant A->B\r\nAC\r\nD\r\n>b\nKL>M\n")
    assert [tuple(r) for r in tables.read_fasta(spark, str(tmp_path / "arrow.fasta")).orderBy("id").collect()] == [("a", "ACD"), ("b", "KL>M")]
    table = "FEATURES             Location/Qualifiers\n     source          1..12\n                     /organism=\"a long\n                     name\"\n                     /circular\n     CDS             complement(join(1..3,\n                     5..9))\n                     /gene=\"x/y\"\n"
    (tmp_path / "c.gb").write_text(f"LOCUS       pX 12 bp DNA circular\n{table}ORIGIN\n        1 acgtac gtacgt\n//\n")
    found = [(r["feature"], r["location"], [tuple(q) for q in r["qualifiers"]]) for r in tables.read_genbank_features(spark, str(tmp_path / "c.gb")).orderBy("nth").collect()]
    assert found == [("source", "1..12", [("organism", "a long name"), ("circular", None)]), ("CDS", "complement(join(1..3,5..9))", [("gene", "x/y")])]
    assert tuple(tables.read_genbank(spark, str(tmp_path / "c.gb")).first()) == ("pX", 12, "ACGTACGTACGT")
    rows = spark.createDataFrame([("a", "AD"), ("a", "AC"), ("b", None)], "sample_id string, sequence string")
    tables.write_fasta(rows, str(tmp_path / "out"))
    assert [tuple(r) for r in tables.read_fasta(spark, str(tmp_path / "out")).collect()] == [("a", "AD")]  # the first, not the least
    tables.write_csv(spark.createDataFrame([(1, [1.0, 2.0])], "i int, v array<double>"), str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).first()["v"] == "[1.0,2.0]"
    ids = tables.synthetic_ids(spark.range(1000, 0, -7).toDF("k"), "k").orderBy("k")
    assert column(ids, "sample_id") == [f"test_{i:05d}" for i in range(ids.count())]


def test_workbooks(spark, tmp_path):
    space, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>ph</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5.5</v></c></row><row r="3"/><row r="4"><c r="C4"><v>7</v></c></row>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="{link}"><sheets><sheet name="Rounds" r:id="r1"/><sheet name="Activity" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{space}"><si><t>id</t></si><si><r><t>x</t></r><r><t>1</t></r></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{space}"><sheetData>{cells}</sheetData></worksheet>')
        book.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{space}"><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>')
    df = tables.read_xlsx(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["id", "_c1", "ph"] and [tuple(r) for r in df.collect()] == [("x1", None, "5.5"), (None, None, "7")]
    assert tables.read_xlsx(spark, str(tmp_path / "a.xlsx"), "Activity").columns == ["9"]
    with pytest.raises(Exception, match="there is no sheet"):
        tables.read_xlsx(spark, str(tmp_path / "a.xlsx"), "None").collect()


def test_features_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("acdef",), ("",)], "text string").write.parquet(source)
    stream = featurised(spark.readStream.schema("text string").parquet(source))
    query = stream.writeStream.format("memory").queryName("featurised").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["seq_len"] for r in spark.table("featurised").collect()) == [0, 5]


def test_centrality_makes_and_shuffles_no_row_per_kmer(spark, monkeypatch):
    """The vectors that are written come without an exchange of words, and the sums meet them with a known size."""
    made = {}

    def kept(df, name, keep=False):
        made[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name, keep)

    monkeypatch.setattr(wild_types, "stored", kept)
    monkeypatch.setattr(kmers, "stored", kept)
    rows = spark.createDataFrame([("a", "ACDEF"), ("a", "ACDEG"), ("b", "KLMNP")], "cluster_id string, sequence string")
    wild = spark.createDataFrame([(1, "ACDEF"), (2, "ACDEG"), (3, "KLMNP")], "wt_id long, wt_sequence string")
    got = {r["cluster_id"]: (r["wt_id"], round(r["wt_centrality"], 6)) for r in wild_types.choose(wild_types.candidates(rows, wild), rows).collect()}
    assert got == {"a": (1, round(2 / 3, 6)), "b": (3, 1.0)}
    assert "MapInArrow" in made["vectors"] and "regexp_extract_all" not in made["vectors"] and "sums" in made
