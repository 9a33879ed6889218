import re

import corpus_pipeline
from seqrank.llm.secrets import findings

from .test_near_dedup import brute


def test_stages_one_by_one(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    before, after = kept["quality_classifier"]
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert gone and all(labels.get(k, 0) == 0 for k in gone)
    before, after = kept["exact_dedup"]
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    texts = [norm(r["text"]) for r in after.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r["text"]) for r in before.collect()})
    before, after = kept["near_dedup"]
    want = brute([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert {r["doc_id"] for r in after.collect()} == {k for k, (_, c) in want.items() if k == c}
    before, after = kept["secret_scan"]
    assert before.count() == after.count() and findings(after).filter("spans <> ''").isEmpty()
    assert findings(before).filter("spans <> ''").count() == after.filter("text like '%[REDACTED]%'").count()
    before, after = kept["best_fit_packing"]
    assert after.select("doc_id").distinct().count() == before.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, after.select("doc_id", "piece", "ids_crc32").collect()))


def test_null_ids_and_empty_tables_go_through(spark, documents, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b  c d e f"), (None, "q token=123456789"), (None, None), (3, None), (4, "")]
    for start in ([], rows):
        docs = documents(start)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{name}{len(start)}"))
            assert out.columns == docs.columns
            docs = spark.read.parquet(str(tmp_path / f"{name}{len(start)}"))
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
        left = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert (None, "q [REDACTED]") in left and (2, "a b  c d e f") in left and (1, "a b c d e f") not in left


def test_decisions_hold_for_an_id_and_its_text(spark, documents, tmp_path):
    one, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    near = stages["near_dedup"](spark, documents([(3, one), (5, one + " more"), (5, other), (8, other + " x"), (3, one)]), str(tmp_path))
    assert rows(near) == [(3, one), (5, other)]
    exact = stages["exact_dedup"](spark, documents([(1, "x y"), (1, "x y"), (1, "x  y"), (2, "xy"), (2, "z"), (None, None), (None, ""), (4, "alone")]), str(tmp_path))
    assert rows(exact) == [(1, "x  y"), (2, "z"), (4, "alone"), (None, "")]
