"""Mini-batch k-means within groups of one length, for all groups at once.

Seeds come by oversampling: from one centre on, a few rounds draw rows with a chance in proportion to their distance from the centres so far, several
times as many as are wanted; each candidate weighs as many rows as are nearest to it, and the wanted number is picked among the few candidates. A round then
takes a batch of each group's rows, dealt by a hash of the sequence, assigns them to the nearest centres (squared Euclidean distance) and moves each centre by its own
learning rate, one over the rows it has had. A group's rounds end when the smoothed inertia of its batches hasn't fallen by a thousandth for a few rounds.

Vectors are sparse rows (length, bucket); assigning and moving are joins and sums over them, and a batch alone is shuffled. What decides (hashes, ties to nine
digits) doesn't depend on how rows are dealt, so repeated runs give the same clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.kmers import unit_rows
from ..session import scratch, ship, stored
from .clusters import group_policy, numbered_clusters

#: Rows of a group in a batch; rounds at most, and without improvement; weight of what came before in the smoothed inertia, and the share by which it must fall.
BATCH, ROUNDS, PATIENCE, SMOOTH, LESS = 256, 20, 3, 0.7, 1e-3
#: Rounds of seeding, and candidates in each, as a multiple of the clusters wanted.
SEED_ROUNDS, OVER = 2, 2
_CLUSTER = ["seq_len", "c"]


def hashed(key: Column) -> Column:
    """A number below 2^32 of a sequence."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def _distances(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """key, seq_len, c, d: squared Euclidean distance of unit vectors to each centre of their length."""
    norms = centres.groupBy(*_CLUSTER).agg(F.sum(F.col("w") * F.col("w")).alias("norm"))
    dots = vectors.join(centres.withColumnRenamed("w", "v"), ["seq_len", "bucket"]).groupBy("key", *_CLUSTER).agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    rows = vectors.select("key", "seq_len").distinct().join(norms, "seq_len")
    return rows.join(dots, ["key", *_CLUSTER], "left").select("key", *_CLUSTER, (1 + F.col("norm") - 2 * F.coalesce("dot", F.lit(0.0))).alias("d"))


#: Centres of a length that lie side by side in a row.
WIDE = 12


def nearest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """key, seq_len, c, d: the nearest centre (to nine digits), the lowest at a tie.

    WIDE centres of a length lie side by side in a row per bucket, so that a vector's cell makes one row for them and not one for each.
    """
    rank = F.row_number().over(Window.partitionBy("seq_len").orderBy("c")) - 1
    names = centres.select(*_CLUSTER).distinct().withColumn("n", rank)  # a row per centre
    numbered = centres.join(F.broadcast(names), _CLUSTER).select("*", F.floor(F.col("n") / WIDE).alias("slot"), (F.col("n") % WIDE).alias("j"))
    of = lambda f, j, x: f(F.when(F.col("j") == j, x))
    cells = numbered.groupBy("seq_len", "slot", "bucket").agg(*(of(F.sum, j, F.col("w")).alias(f"v{j}") for j in range(WIDE)))
    heads = numbered.groupBy("seq_len", "slot").agg(*(of(F.sum, j, F.col("w") * F.col("w")).alias(f"norm{j}") for j in range(WIDE)), *(of(F.max, j, F.col("c")).alias(f"c{j}") for j in range(WIDE)))
    met = vectors.join(F.broadcast(heads.select("seq_len", "slot")), "seq_len").join(cells, ["seq_len", "slot", "bucket"], "left")
    dots = met.groupBy("key", "seq_len", "slot").agg(*(F.coalesce(F.sum(F.col("w") * F.col(f"v{j}")), F.lit(0.0)).alias(f"dot{j}") for j in range(WIDE)))
    d = [1 + F.col(f"norm{j}") - 2 * F.col(f"dot{j}") for j in range(WIDE)]
    near = [F.when(F.col(f"c{j}").isNotNull(), F.struct(F.round(d[j], 9).alias("near"), F.col(f"c{j}").alias("c"), d[j].alias("d"))) for j in range(WIDE)]
    best = dots.join(F.broadcast(heads), ["seq_len", "slot"]).select("key", "seq_len", F.array_min(F.array(*near)).alias("b"))
    return best.groupBy("key", "seq_len").agg(F.min("b").alias("b")).select("key", "seq_len", F.col("b.c").alias("c"), F.greatest(F.lit(0.0), F.col("b.d")).alias("d"))


def _picked(pairs: DataFrame) -> DataFrame:
    """seq_len, key, c of the candidates that become seeds. pairs: seq_len, k, a, b, weight (of a), d; all pairs of a length's candidates, which are few."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(frame["a"].unique())
        at = {n: i for i, n in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        d[frame["a"].map(at), frame["b"].map(at)] = np.maximum(frame["d"], 0)
        weight = frame.groupby("a")["weight"].first().reindex(names).to_numpy()
        chosen = [int(np.argmax(weight))]
        while len(chosen) < min(int(frame["k"].iloc[0]), len(names)):
            gain = np.round(weight * d[:, chosen].min(1), 9)
            gain[chosen] = -1
            chosen.append(int(np.argmax(gain)))
        return pd.DataFrame({"seq_len": frame["seq_len"].iloc[0], "key": [names[i] for i in chosen], "c": range(1, len(chosen) + 1)})

    return pairs.groupBy("seq_len").applyInPandas(pick, "seq_len int, key string, c long")


def oversampled_seeds(vectors: DataFrame, policy: DataFrame, rounds: int = SEED_ROUNDS, over: int = OVER) -> DataFrame:
    """seq_len, key, c: as many seeds as policy (seq_len, k) wants, or as there are rows."""
    rows = vectors.select("key", "seq_len").distinct()
    first = rows.groupBy("seq_len").agg(F.min_by("key", F.struct(hashed(F.col("key")), "key")).alias("key"))
    found = stored(first.select("seq_len", "key"), "candidates")
    for r in range(rounds):
        centres = vectors.join(found, ["seq_len", "key"]).select("seq_len", F.xxhash64("key").alias("c"), "bucket", "w")
        cost = stored(nearest(vectors, centres), "costs")
        total = cost.groupBy("seq_len").agg(F.sum("d").alias("total")).join(policy.select("seq_len", "k"), "seq_len")
        draw = hashed(F.concat(F.col("key"), F.lit(f"#{r}"))) / F.lit(float(1 << 32))
        drawn = cost.join(total, "seq_len").filter(draw < over * F.col("k") * F.col("d") / F.col("total")).select("seq_len", "key")
        found = stored(found.union(drawn).distinct(), "candidates")
    own = vectors.join(found, ["seq_len", "key"])
    centres = own.select("seq_len", F.xxhash64("key").alias("c"), "bucket", "w")
    weights = nearest(vectors, centres).groupBy("seq_len", F.col("c").alias("weighed")).agg(F.count("*").alias("weight"))
    names = found.select("seq_len", F.col("key").alias("b"), F.xxhash64("key").alias("c"))
    pairs = _distances(own.select("key", "seq_len", "bucket", "w"), centres).join(names, _CLUSTER).withColumn("x", F.xxhash64("key"))
    pairs = pairs.join(weights, (pairs["seq_len"] == weights["seq_len"]) & (F.col("x") == F.col("weighed")), "left").drop(weights["seq_len"])
    pairs = pairs.join(policy.select("seq_len", "k"), "seq_len")
    return _picked(pairs.select("seq_len", "k", F.col("key").alias("a"), "b", F.coalesce("weight", F.lit(0)).cast("double").alias("weight"), "d"))


def hashed_seeds(vectors: DataFrame, policy: DataFrame) -> DataFrame:
    """seq_len, key, c: the first few by hash."""
    rank = F.row_number().over(Window.partitionBy("seq_len").orderBy(F.md5("key"), "key"))
    rows = vectors.select("key", "seq_len").distinct().withColumn("c", rank).filter(F.col("c") <= K.CLUSTERS_MOST)
    return rows.join(policy.select("seq_len", "k"), "seq_len").filter(F.col("c") <= F.col("k")).select("seq_len", "key", F.col("c").cast("long").alias("c"))


def minibatch_centres(vectors: DataFrame, policy: DataFrame, seeds: DataFrame, batch: int = BATCH, rounds: int = ROUNDS, patience: int | None = PATIENCE) -> DataFrame:
    """seq_len, c, bucket, w: centres after the rounds. policy: seq_len, n. patience: rounds without improvement that end a group's; none: all rounds are made."""
    slot = F.pmod(hashed(F.col("key")), F.ceil(F.col("n") / batch)).alias("slot")
    rows = stored(vectors.join(policy.select("seq_len", "n"), "seq_len").select("key", "seq_len", "bucket", "w", slot, F.ceil(F.col("n") / batch).alias("slots")), "slots")
    centres = stored(vectors.join(seeds, ["seq_len", "key"]).select(*_CLUSTER, "bucket", "w"), "centres")
    had = stored(centres.select(*_CLUSTER).distinct().withColumn("had", F.lit(0).cast("long")), "had")
    none = F.lit(None).cast("double")
    state = stored(centres.select("seq_len").distinct().select("seq_len", none.alias("smooth"), none.alias("best"), F.lit(0).alias("stale")), "state")
    for r in range(rounds):
        active = state if patience is None else state.filter(F.col("stale") < patience)
        part = rows.filter(F.pmod(F.lit(r), F.col("slots")) == F.col("slot")).join(active.select("seq_len"), "seq_len", "left_semi").drop("slot", "slots")
        found = stored(nearest(part, centres), "assigned")
        sizes = found.groupBy(*_CLUSTER).agg(F.count("*").alias("m"))
        now = had.join(sizes, _CLUSTER, "left").fillna(0, ["m"]).select(*_CLUSTER, "had", (F.col("had") + F.col("m")).alias("after"), "m")
        moved = part.join(found.select("key", *_CLUSTER), ["key", "seq_len"]).groupBy(*_CLUSTER, "bucket").agg(F.sum("w").alias("w"))
        # a centre that has had n rows and gets m more moves by m / (n + m) towards their mean
        kept = centres.join(now, _CLUSTER).select(*_CLUSTER, "bucket", F.when(F.col("m") > 0, F.col("w") * F.col("had") / F.col("after")).otherwise(F.col("w")).alias("w"))
        new = moved.join(now, _CLUSTER).select(*_CLUSTER, "bucket", (F.col("w") / F.col("after")).alias("w"))
        centres = stored(kept.union(new).groupBy(*_CLUSTER, "bucket").agg(F.sum("w").alias("w")).filter("w <> 0"), "centres")
        had = stored(now.select(*_CLUSTER, F.col("after").alias("had")), "had")
        if patience is None:
            continue
        inertia = found.groupBy("seq_len").agg(F.avg("d").alias("d"))
        smooth = F.when(F.col("smooth").isNull(), F.col("d")).otherwise(F.coalesce(F.col("smooth") * SMOOTH + F.col("d") * (1 - SMOOTH), F.col("smooth")))
        after = state.join(inertia, "seq_len", "left").withColumn("smooth", smooth)
        better = F.col("d").isNull() | F.col("best").isNull() | (F.round("smooth", 9) < F.round(F.col("best") * (1 - LESS), 9))
        going = F.when(better, F.lit(0)).otherwise(F.col("stale") + 1)
        stopped = F.col("stale") >= patience
        state = stored(after.select("seq_len", "smooth", F.when(better, F.col("smooth")).otherwise(F.col("best")).alias("best"), F.when(stopped, F.col("stale")).otherwise(going).alias("stale")), "state")
        if state.filter(F.col("stale") < patience).isEmpty():
            break
    return centres


def minibatch_clusters(
    df: DataFrame, sequence: str = "sequence", k: int = K.KMER, dim: int = K.KMER_DIM, batch: int = BATCH, rounds: int = ROUNDS, patience: int | None = PATIENCE, seeding: str = "oversampled"
) -> DataFrame:
    """sequence, seq_len, cluster_id, similarity (with the centre's direction) of each distinct non-empty sequence; ids ascend with length."""
    ship(df.sparkSession)
    with scratch():
        distinct = stored(df.select(F.col(sequence).alias("key")).filter(F.length("key") > 0).distinct().withColumn("seq_len", F.length("key")), "distinct")
        policy = stored(group_policy(distinct, "key"), "policy")
        rows = stored(distinct.join(F.broadcast(policy), "seq_len"), "lengths")  # a row per length: a shuffle would gather all rows of one in a task
        single = rows.filter("not clustered").select("key", "seq_len", F.row_number().over(Window.partitionBy("seq_len").orderBy("key")).cast("long").alias("c"), F.lit(1.0).alias("similarity"))
        big = rows.filter("clustered")
        vectors = stored(unit_rows(big.withColumn("s", F.col("key")), ["key", "seq_len"], "s", k, dim), "vectors")
        seeds = stored((oversampled_seeds if seeding == "oversampled" else hashed_seeds)(vectors, policy), "seeds")
        centres = minibatch_centres(vectors, policy, seeds, batch, rounds, patience)
        found = nearest(vectors, centres)
        unit = centres.groupBy(*_CLUSTER).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        own = found.join(unit, _CLUSTER).select("key", "seq_len", "c", ((1 + F.col("norm") * F.col("norm") - F.col("d")) / 2 / F.col("norm")).alias("similarity"))
        left = big.select("key", "seq_len").join(vectors.select("key", "seq_len").distinct(), ["key", "seq_len"], "left_anti")  # too short for a k-mer
        every = stored(single.unionByName(own).unionByName(left.withColumns({"c": F.lit(0).cast("long"), "similarity": F.lit(1.0)})), "clustered", keep=True)
    return numbered_clusters(every)
