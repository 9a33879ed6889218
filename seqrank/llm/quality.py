"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (tokens and pairs of tokens) are fitted: one on the target, labelled good documents,
one on the raw text of all documents. A document's log weight is the log ratio of its likelihoods under the two; it stays
if it is drawn by Gumbel top-k: its weight plus Gumbel noise is among the k largest. k is the share of good documents
among the labelled ones, at its upper confidence limit, of all documents.

The target is fitted on at most ``TARGET_ROWS`` labelled good documents (those of least hash), the one bound here; the
raw model and the weights cover all documents and whole texts. A model is a table of ``BUCKETS`` numbers. The k-th
largest key is found exactly by narrowing histograms, never by a global sort. Noise is drawn from a hash of
id and text, so a task that runs again draws the same.

Defined results: a null or empty text has no n-grams and log weight 0: it competes as a text that is as likely under both models, so it is
drawn before all texts of negative weight, and goes where the cut is above its noise. Rows repeated with id and text have one key; all
rows tied at the k-th key stay. Without good labels, or without rows, every document stays. Labels with null ids or values are not used.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, stored, table, text_or_empty
from .hashing import U, mixed, runs, spans_hash

#: Hashed n-gram buckets; labelled good documents that fit the target; weight of the raw model in the target's smoothing.
BUCKETS, TARGET_ROWS, SMOOTH = 1 << 16, 50_000, 0.05
#: Standard errors above the labelled share of good documents, and what is added to it, for k.
MARGIN, SLACK = 2.0, 0.002


def grams(raw: bytes) -> np.ndarray:
    """Buckets of a text's tokens (runs of letters and digits, runs of other signs) and of pairs of neighbours."""
    b = np.frombuffer(raw, np.uint8)
    begin, end = runs(b)
    if not len(begin):
        return np.zeros(0, np.int64)
    h = spans_hash(b, begin, end)
    pairs = mixed(h[:-1] * U(3) + h[1:] * U(5))
    return (np.concatenate([h, pairs]) % U(BUCKETS)).astype(np.int64)


def _noise(ids: list[int | None], texts: list[bytes], seed: int) -> np.ndarray:
    keys = np.array([zlib.crc32(t) for t in texts], U) + np.array([0 if i is None else i for i in ids], np.int64).astype(U) * U(0x9E3779B97F4A7C15)
    u = (mixed(keys ^ mixed(np.full(len(keys), seed, U))) >> U(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / (1 << 53)))


class Model:
    """Log ratio of each bucket under target and raw text, the share of rows to keep, and the noise's seed."""

    def __init__(self, ratio: np.ndarray, share: float, seed: int):
        self.ratio, self.share, self.seed = ratio.astype(np.float32), share, seed

    def keys(self, ids: list[int | None], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n-grams, log weight and key of each document."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        n, weight = np.zeros(len(raw), np.int64), np.zeros(len(raw))
        for i, t in enumerate(raw):
            g = grams(t)
            n[i], weight[i] = len(g), float(self.ratio[g].sum(dtype=np.float64))
        return n, weight, weight + _noise(ids, raw, self.seed)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", target_rows: int = TARGET_ROWS, seed: int = 11) -> Model:
    """labels: doc_id and label_col (1 good, 0 bad)."""
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).filter("i is not null and y is not null")
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0)).alias("good")).first()
    if not total["good"]:
        return Model(np.zeros(BUCKETS), 1.0, seed)
    share = total["good"] / total["n"]
    share = min(1.0, share + MARGIN * math.sqrt(share * (1 - share) / total["n"]) + SLACK)
    chosen = known.filter("y = 1").select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(target_rows).toArrow()  # target_rows at most
    target = df.sparkSession.sparkContext.broadcast(np.sort(np.asarray(chosen.column("i"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            good = np.isin(np.array([-1 if i is None else i for i in ids], np.int64), target.value) & np.array([i is not None for i in ids], bool)
            for t, is_good in zip(batch.column(1).to_pylist(), good.tolist(), strict=True):
                if len(g := grams(t.encode("utf-8", "replace"))):
                    seen = np.bincount(g, minlength=BUCKETS)
                    counts[0] += seen
                    if is_good:
                        counts[1] += seen
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "good"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sums = map_arrow(rows, run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = np.asarray(sums.column("bucket"))
    raw[at], good[at] = np.asarray(sums.column("raw")), np.asarray(sums.column("good"))
    if not good.sum():
        return Model(np.zeros(BUCKETS), 1.0, seed)
    p = (raw + 0.5) / (raw + 0.5).sum()
    q = (1 - SMOOTH) * good / good.sum() + SMOOTH * p
    return Model(np.log(q / p), share, seed)


def weighed(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight, key = model.keys(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(key)], ["doc_id", "n_grams", "log_weight", "gumbel_key"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, n_grams long, log_weight double, gumbel_key double")


def kth_largest(values: DataFrame, k: int, bins: int = 1000, few: int = 5000) -> float:
    """The k-th largest of a written column ``v`` of finite doubles, exactly; minus infinity if there are no more than k."""
    total = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if total["n"] <= k:
        return -math.inf
    lo, hi, above, inside = total["lo"], total["hi"], 0, total["n"]  # the k-th largest is in [lo, hi]
    while inside > few and lo < hi:
        width = (hi - lo) / bins
        if lo + width <= lo:
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / width)).cast("int")
        found = values.filter(F.col("v").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):  # at most `bins` rows
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi, inside = r["lo"], r["hi"], r["n"]
    # what is left are few values, or many that are equal or next to it: counted by value
    left = values.filter(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("v")).limit(few).collect()
    for r in left:
        above += r["n"]
        if above >= k:
            return r["v"]
    return lo


def kept_rows(n: int, model: Model) -> int:
    return max(1, math.ceil(n * model.share))


def resampled(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, selected of every row."""
    model = fit(df, labels, id_col, text_col, label_col)
    rows = stored(weighed(df, model, id_col, text_col), "weights")
    cut = kth_largest(rows.select(F.col("gumbel_key").alias("v")), kept_rows(rows.count(), model))
    return rows.withColumn("selected", F.col("gumbel_key") >= cut)


def selected(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``df`` that are drawn, all columns as they are; the texts are never shuffled."""
    model = fit(df, labels, id_col, text_col, label_col)
    keys = stored(weighed(df, model, id_col, text_col).select(F.col("gumbel_key").alias("v")), "keys")
    cut = kth_largest(keys, kept_rows(keys.count(), model))
    at = df.columns.index(id_col), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at[0]).cast(pa.int64()).to_pylist()
            yield batch.filter(pa.array(model.keys(ids, batch.column(at[1]).to_pylist())[2] >= cut))

    return map_arrow(df, run, df.schema)


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_importance_resampling": op7_importance_resampling}
ORACLE: dict[str, str] = {}
