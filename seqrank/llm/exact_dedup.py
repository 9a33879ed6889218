"""Exact duplicates: 128-bit content hash, byte comparison inside groups, the best row stays.

Native: DataFrame functions only. The rows are grouped by the MD5 of the normalised text (128 bits) and by its
bytes, so that two texts that share a hash still make two groups. Spark combines the copies in each map task before
the shuffle: a text that a third of all rows hold reaches the reducer once per map task. What is joined back to
the rows is the hash alone, without texts; AQE splits a hot hash there.

Defined results: a null text counts as empty, and empty texts are one group. Null ids sort after all others. Rows
repeated with the same id are one document: each of them is returned and all carry its decision, and group_size counts
rows. An empty table gives an empty result. Other columns of the input are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, table, text_or_empty


def content_key(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(F.regexp_replace(text, f"{BLANK}+", ""), 256)


def content_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    text = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    normal = text.select("doc_id", F.char_length("text").alias("n"), F.regexp_replace("text", f"{BLANK}+", "").alias("norm"))
    rows = normal.select("doc_id", F.unhex(F.md5("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id")))
    groups = (
        normal.groupBy(F.unhex(F.md5("norm")).alias("h"), "norm")
        .agg(best.alias("best"), F.count("*").alias("size"))
        .filter("size > 1")
        .select("h", F.sha2("norm", 256).alias("text_sha256"), F.col("best.id").alias("best_id"), "size")
    )
    joined = rows.join(groups, ["h", "text_sha256"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
                   FROM documents),
             g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id
                   FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""
}
