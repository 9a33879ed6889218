"""Clusters of sequences within groups of one length, and the cluster's representative.

Groups below a size aren't clustered: every row is its own cluster. In the others spherical k-means runs over sparse k-mer
vectors, for all lengths at once: assigning joins vectors to centres by (length, bucket), and centres are sums by
(length, cluster, bucket). No group is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.kmers import unit_rows
from ..session import stored


def choose_k(n: Column) -> Column:
    """Clusters for a group of n rows, never more than n."""
    out = F.lit(K.CLUSTERS_MOST)
    for below, k in reversed(K.CLUSTERS_BELOW):
        out = F.when(n < below, F.lit(k)).otherwise(out)
    return F.least(out.cast("long"), n.cast("long"))


def group_policy(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """seq_len, n, clustered, k of each length."""
    sizes = df.filter(F.length(sequence) > 0).groupBy(F.length(sequence).alias("seq_len")).agg(F.count("*").alias("n"))
    clustered = F.col("n") >= K.SMALL_GROUP
    return sizes.select("seq_len", "n", clustered.alias("clustered"), F.when(clustered, choose_k(F.col("n"))).otherwise(F.col("n")).alias("k"))


def _unit(sums: DataFrame, keys: list[str]) -> DataFrame:
    norms = sums.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.join(norms, keys).select(*keys, "bucket", (F.col("w") / F.col("norm")).alias("w"))


def _assigned(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """key, seq_len, c, similarity: the nearest centre (to nine digits), the lowest at a tie; c is from 1 to CLUSTERS_MOST.

    The centres of a length lie side by side in a row per bucket, so that a vector's cell makes one row and not one for each centre.
    """
    numbers = range(1, K.CLUSTERS_MOST + 1)
    cells = centres.groupBy("seq_len", "bucket").agg(*(F.sum(F.when(F.col("c") == j, F.col("w"))).alias(f"v{j}") for j in numbers))
    dots = vectors.join(cells, ["seq_len", "bucket"]).groupBy("key", "seq_len").agg(*(F.sum(F.col("w") * F.col(f"v{j}")).alias(f"d{j}") for j in numbers))
    near = [F.when(F.col(f"d{j}").isNotNull(), F.struct(F.round(f"d{j}", 9).alias("near"), F.lit(-j).cast("long").alias("c"), F.col(f"d{j}").alias("similarity"))) for j in numbers]
    best = dots.select("key", "seq_len", F.array_max(F.array(*near)).alias("b"))
    return best.select("key", "seq_len", (-F.col("b.c")).alias("c"), F.col("b.similarity").alias("similarity"))


def clusters(df: DataFrame, sequence: str = "sequence", k: int = K.KMER, dim: int = K.KMER_DIM, rounds: int = 4) -> DataFrame:
    """sequence, seq_len, cluster_id, similarity of each distinct non-empty sequence; ids ascend with length."""
    distinct = stored(df.select(F.col(sequence).alias("key")).filter(F.length("key") > 0).distinct().withColumn("seq_len", F.length("key")), "distinct")
    policy = group_policy(distinct, "key")
    rows = stored(distinct.join(F.broadcast(policy), "seq_len"), "lengths")  # a row per length: a shuffle would gather all rows of one in a task
    single = rows.filter("not clustered").select("key", "seq_len", F.row_number().over(Window.partitionBy("seq_len").orderBy("key")).cast("long").alias("c"), F.lit(1.0).alias("similarity"))
    big = rows.filter("clustered").withColumn("seed", F.md5("key"))
    vectors = stored(unit_rows(big.withColumn("s", F.col("key")), ["key", "seq_len"], "s", k, dim), "vectors")
    rank = F.row_number().over(Window.partitionBy("seq_len").orderBy("seed", "key"))
    # the literal bound lets each task keep the first few of its rows before they are shuffled
    seeds = big.withColumn("c", rank).filter(F.col("c") <= K.CLUSTERS_MOST).filter(F.col("c") <= F.col("k")).select("key", "seq_len", F.col("c").cast("long").alias("c"))
    centres = vectors.join(seeds, ["key", "seq_len"]).select("seq_len", "c", "bucket", "w")
    for _ in range(rounds):
        found = stored(_assigned(vectors, centres), "assigned")
        sums = vectors.join(found.select("key", "seq_len", "c"), ["key", "seq_len"]).groupBy("seq_len", "c", "bucket").agg(F.sum("w").alias("w"))
        centres = stored(_unit(sums, ["seq_len", "c"]), "centres")
    found = _assigned(vectors, centres) if rounds else single.limit(0)
    left = big.select("key", "seq_len").join(found.select("key", "seq_len"), ["key", "seq_len"], "left_anti")  # too short for a k-mer
    every = stored(single.unionByName(found).unionByName(left.withColumns({"c": F.lit(0).cast("long"), "similarity": F.lit(1.0)})), "clustered")
    return numbered_clusters(every)


def numbered_clusters(every: DataFrame) -> DataFrame:
    """sequence, seq_len, cluster_id, similarity of rows (key, seq_len, c, similarity): ids from 0, by length, then by c."""
    ids = every.groupBy("seq_len", "c").agg(F.count("*").alias("size"))
    per_length = ids.groupBy("seq_len").agg(F.count("*").alias("m"))
    # the lengths are few: their running sum is the only unpartitioned window
    offsets = per_length.withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("seq_len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    numbered = ids.withColumn("r", F.row_number().over(Window.partitionBy("seq_len").orderBy("c"))).join(F.broadcast(offsets), "seq_len")
    named = numbered.select("seq_len", "c", (F.col("before") + F.col("r") - 1).cast("long").alias("cluster_id"))
    return every.join(named, ["seq_len", "c"]).select(F.col("key").alias("sequence"), "seq_len", "cluster_id", "similarity")


def representatives(clustered: DataFrame) -> DataFrame:
    """cluster_id, seq_len, cluster_size, rep_sequence, avg_similarity: the member nearest to the centre (to nine digits), the least sequence at a tie."""
    best = F.min_by("sequence", F.struct(-F.round("similarity", 9), "sequence")).alias("rep_sequence")
    return clustered.groupBy("cluster_id", "seq_len").agg(F.count("*").alias("cluster_size"), best, F.avg("similarity").alias("avg_similarity"))
