"""Rows that meet something large by key: it is sent once for some hundred of them, not beside each."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a head is sent with.
TOGETHER = 512


def numbered(df: DataFrame, last: DataFrame, to: str) -> DataFrame:
    """Each row with every number from 0 to ``last`` (a table of one row and column; no rows if that is null)."""
    met = df.join(F.broadcast(last.toDF("__last"))).filter("__last is not null")
    return met.withColumn(to, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last").cast("long")))).drop("__last")


def behind(rows: DataFrame, heads: DataFrame, key: str, by: str, order: list[Column] | None = None, together: int | None = None, spread: bool = False) -> DataFrame:
    """key, salt, head, the heads' other columns and the rows' other columns: in a partition each key's heads in order, then rows of that key, ``together`` of them on average.

    by: a column of the rows that deals them. Rows whose key has no head are left out. A key's rows spread over as many tasks as it takes.
    spread: over all of the session's shuffle partitions. Spark merges small ones by their bytes, to about a task per core; where a row takes milliseconds, the longest of those is waited for.
    """
    # a row per key that has heads: joined by broadcast, for by a shuffle on the key all rows of one would land in one task
    counts = F.broadcast(rows.groupBy(key).agg(F.ceil(F.count("*") / (together or TOGETHER)).alias("salts")))
    salted = rows.join(counts, key).withColumn("salt", F.pmod(F.xxhash64(by), "salts"))
    dealt = heads.join(counts, key).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    own, others = [c for c in heads.columns if c != key], [c for c in rows.columns if c != key]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    one = dealt.select(key, "salt", F.lit(True).alias("head"), *own, *(none(rows, c) for c in others))
    two = salted.select(key, "salt", F.lit(False).alias("head"), *(none(heads, c) for c in own), *others)
    parts = [int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if spread else []
    return one.union(two).repartition(*parts, key, "salt").sortWithinPartitions(key, "salt", F.desc("head"), *(order or []))


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[dict], list[dict]]]:
    """Of what ``behind`` gives to a task: the heads of each group, and up to ``most`` of its rows at a time (with the same list of heads)."""
    at, heads, held = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(list(row.values())[:2])
            if key != at or (row["head"] and held):
                if held:
                    yield heads, held
                at, heads, held = key, [], []
            if row["head"]:
                heads.append(row)
            elif heads:
                held.append(row)
                if len(held) >= most:
                    yield heads, held
                    held = []
    if held:
        yield heads, held
