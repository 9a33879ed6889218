"""Connected components of a table of links, by alternating large and small stars.

Each half step is an aggregate by node (combined in the map tasks) and a join of it to the links, which AQE may split at
a hot node; no node's neighbours ever meet in one task. Links never grow in number. Each round is cut off from its
lineage by a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored


def _half(links: DataFrame, large: bool) -> DataFrame:
    """links (a > b). Large: each node's larger neighbours go to its least neighbour; small: its smaller ones and itself."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b), in any direction and repeated or not: (id, component) of every linked id, the least id reachable."""
    now = Stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        new = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count("*")
        seen = tuple(now.df.agg(*new).first())
        if seen == state or seen[1] == 0:
            break
        state = seen
        after = Stored(_half(_half(now.df, True), False), "links")
        now.drop()
        now = after
    roots = now.df.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return now.df.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
