"""The three end-to-end flows as lazy compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds, joins, metrics, models, wild_types
from ..operators.alignment import best_references
from ..operators.clusters import clusters, representatives
from ..operators.embeddings import delta_given
from ..operators.stats import first_by_key
from ..schema import require_columns
from .scores import cluster_aware, properties

#: Names of the three scores in a submission.
OFFICIAL = {"activity_1": "activity_1 (μmol [TPA]/min·mg [E])", "activity_2": "activity_2 (μmol [TPA]/min·mg [E])", "expression": "expression (mg/mL)"}


def zero_shot(df: DataFrame, clustered: DataFrame, reps: DataFrame, likelihood: DataFrame, delta: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """Sequences to the three official scores.

    clustered: sequence, cluster_id; reps: cluster_id, rep_sequence; likelihood: sequence, ll (a model's log-likelihoods);
    delta: sequence, and delta_emb or wt_cosine_sim. order: a column by which the first row of a repeated sequence counts (positions.positioned gives one); in a table without it the row with the least value counts. Unmapped rows share cluster -1 and are their own representative.
    """
    require_columns(df, ["sequence"], "zero_shot")
    first = lambda t, c: first_by_key(t.select("sequence", c, F.col(order if order in t.columns else c).alias("__o")), ["sequence"], "__o").drop("__o")
    rows = df.select("sequence").join(first(clustered, "cluster_id"), "sequence", "left")
    rows = rows.join(reps.select("cluster_id", "rep_sequence"), "cluster_id", "left")
    rows = rows.withColumns({"cluster_id": F.coalesce("cluster_id", F.lit(-1)), "rep_sequence": F.coalesce("rep_sequence", "sequence")})
    ll = first(likelihood, "ll")
    rows = rows.join(ll, "sequence", "left").join(ll.select(F.col("sequence").alias("rep_sequence"), F.col("ll").alias("rep_ll")), "rep_sequence", "left")
    if delta is not None:
        rows = rows.join(first(delta_given(delta), "delta_emb"), "sequence", "left")
    scored = cluster_aware(rows)
    return scored.select("sequence", *(F.col(c).alias(name) for c, name in OFFICIAL.items()))


def property_table(df: DataFrame, references: DataFrame, sequence: str = "sequence", weights: DataFrame | None = None) -> DataFrame:
    """Clusters, wild types with their fallbacks, properties with z-scores, and the best alignment of each sequence.

    references: wt_id, wt_sequence; weights: those of the instability index, if it is wanted.
    """
    found = clusters(df, sequence)
    reps = representatives(found)
    options = wild_types.candidates(found, references)
    chosen = wild_types.choose(options, reps.select("cluster_id"))
    mapped = wild_types.sequence_map(found.select("sequence", "cluster_id"), chosen.filter("wt_id >= 0"))
    mapped = mapped.select("sequence", "cluster_id", "wt_sequence", "wt_centrality")
    known = references.select(F.col("wt_id").alias("ref_id"), F.col("wt_sequence").alias("ref_sequence"))
    near = joins.nearest_length(mapped, known)
    rows = near.withColumn("wt_sequence", F.coalesce("wt_sequence", "ref_sequence", "sequence")).drop("ref_id", "ref_sequence")
    best = best_references(rows, known).select("sequence", "best_ref_id", "best_score")
    return properties(rows.join(best, "sequence", "left"), weights=weights, also=("best_score",))


def supervised(assay: DataFrame, features: DataFrame, columns: list[str], target: str, key: str = "sample_id", k: int = 5) -> tuple[models.Linear, DataFrame]:
    """A ridge model on assay rows joined to features, and its Spearman over grouped folds (mean and sd)."""
    rows = joins.inner_nonempty(assay, features, [key])
    folded = folds.grouped(rows, key, k)
    predicted = models.predict_folds(folded, models.ridge_folds(folded, columns, target, "fold"), "fold")
    score = metrics.over_folds(metrics.spearman(predicted, "prediction", target, ["fold"]), ["rho"])
    return models.ridge(rows, columns, target), score
