"""Choice of a wild type per cluster, and the map from sequences to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.kmers import centrality, unit_rows
from ..session import stored
from .stats import mode_first_seen


def candidates(sequences: DataFrame, wild_types: DataFrame, cluster: str = "cluster_id", sequence: str = "sequence") -> DataFrame:
    """cluster_id, wt_id, wt_sequence: the wild types that occur among the sequences, by the cluster they occur in.

    wild_types: wt_id, wt_sequence. Both sides are trimmed; of a repeated wild-type sequence the last id counts.
    """
    known = wild_types.select(F.trim("wt_sequence").alias("wt_sequence"), "wt_id").groupBy("wt_sequence").agg(F.max("wt_id").alias("wt_id"))
    rows = sequences.select(F.col(cluster).alias("cluster_id"), F.trim(sequence).alias("wt_sequence")).distinct()
    return rows.join(known, "wt_sequence").select("cluster_id", "wt_id", "wt_sequence")


def choose(found: DataFrame, clusters: DataFrame, k: int = K.KMER, dim: int = K.KMER_DIM) -> DataFrame:
    """cluster_id, wt_id, wt_sequence, wt_centrality of every cluster in ``clusters``.

    Without a candidate: -1, an empty sequence and 0. One alone: 1. Else those of the modal length (that seen first, by
    wt_id, at a tie), of which the one with the highest mean cosine to the others is taken, the lowest id at a tie.
    """
    sized = found.withColumn("length", F.length("wt_sequence"))
    modal = mode_first_seen(sized, "length", "wt_id", ["cluster_id"])
    kept = sized.join(modal, "cluster_id").filter("length = mode").select("cluster_id", "wt_id", "wt_sequence")
    kept = stored(kept, "kept")
    vectors = stored(unit_rows(kept, ["cluster_id", "wt_id"], "wt_sequence", k, dim, valid_only=True), "vectors")
    scored = kept.join(centrality(vectors, "wt_id", "cluster_id"), ["wt_id", "cluster_id"], "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    alone = kept.groupBy("cluster_id").agg((F.count("*") == 1).alias("alone"))
    scored = scored.join(alone, "cluster_id").withColumn("centrality", F.when(F.col("alone"), F.lit(1.0)).otherwise(F.col("centrality")))
    best = scored.groupBy("cluster_id").agg(F.max_by(F.struct("wt_id", "wt_sequence", "centrality"), F.struct(F.round("centrality", 9), -F.col("wt_id"))).alias("b"))
    out = clusters.select("cluster_id").distinct().join(best, "cluster_id", "left")
    return out.select(
        "cluster_id",
        F.coalesce("b.wt_id", F.lit(-1)).cast("long").alias("wt_id"),
        F.coalesce("b.wt_sequence", F.lit("")).alias("wt_sequence"),
        F.coalesce("b.centrality", F.lit(0.0)).alias("wt_centrality"),
    )


def sequence_map(sequences: DataFrame, chosen: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Each sequence row with its cluster's wild type."""
    return sequences.join(chosen.withColumnRenamed("cluster_id", cluster), cluster, "left")
