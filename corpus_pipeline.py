"""From raw documents to packed training sequences, by five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the one before it kept, whose output is
written as Parquet and read again. All stages but the last return the columns of documents. Null ids and null texts
go through: a row without an id is only dropped by the classifier or as an exact copy. What a stage decides holds for a row's id and
text, so of rows that share an id but not their text each is judged for itself, and of rows repeated with both one
stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrank.llm.common import Stored, scratch, split_by_ids, stored, table
from seqrank.llm.exact_dedup import content_groups, content_key
from seqrank.llm.near_dedup import near_rows
from seqrank.llm.packing import pack
from seqrank.llm.quality import selected
from seqrank.llm.secrets import redacted


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws."""
    return selected(docs, table(spark, sf_dir, "labels"))


def one_of_each(docs: DataFrame, members: DataFrame, key: Column) -> DataFrame:
    """The rows of docs, but of each group of ``members`` (doc_id, key, group, keeps) only one of those that its decision keeps.

    Only texts of rows that may be members are shuffled; of several rows that a decision keeps the longest text stays.
    """
    members = stored(members.distinct(), "members")
    some, rest = split_by_ids(docs, "doc_id", members.select("doc_id"))
    same = F.col("_d.doc_id").eqNullSafe(F.col("_m.doc_id")) & (key == F.col("_m.key"))
    joined = some.alias("_d").join(members.alias("_m"), same, "left")
    row = [F.col(f"_d.`{c}`").alias(c) for c in docs.columns]
    others = joined.filter("_m.group is null").select(row)
    best = F.max_by(F.struct(row), F.struct(F.char_length("_d.text"), F.xxhash64(*row))).alias("_best")
    return rest.union(others).union(joined.filter("_m.keeps").groupBy("_m.group").agg(best).select("_best.*"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that stays."""
    groups = content_groups(docs).filter("group_size > 1")
    members = groups.select("doc_id", F.col("text_sha256").alias("key"), F.col("text_sha256").alias("group"), F.col("kept").alias("keeps"))
    return one_of_each(docs, members, content_key(F.coalesce(F.col("_d.text").cast("string"), F.lit(""))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of least id."""
    rows = near_rows(docs).filter("part is not null").select("doc_id", F.col("h").alias("key"), F.col("part").alias("group"))
    first = rows.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key")).alias("first")).filter("n > 1")
    members = rows.join(first, F.col("group") == F.col("g")).select("doc_id", "key", "group", (F.struct("doc_id", "key") == F.col("first")).alias("keeps"))
    return one_of_each(docs, members, F.xxhash64(F.coalesce(F.col("_d.text").cast("string"), F.lit(""))))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced; n_chars follows a changed text."""
    clean = redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    changed = F.col("text").contains("[REDACTED]")
    return clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    # beside executors that have filled their heaps in the stages before: a small memo and small groups leave room
    return pack(docs, memo_size=30_000, group_size=1 << 20)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Signatures, noise, component and packing plans can't be said in SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            after = Stored(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
