"""The scoring recipes, each one lazy plan."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import kinetics, motifs, residues
from ..functions.strings import length_penalty
from ..operators import matrices, profiles
from ..operators.stats import centered, clipped, finite_or, impute_median, mode_smallest, robust_z, zscore
from ..schema import col_or_lit, require_columns
from ..session import ready, stored


def _sum(weights: dict[str, float]) -> Column:
    return reduce(add, (F.lit(w) * F.col(c) for c, w in weights.items()))


def properties(
    df: DataFrame, sequence: str = "sequence", pattern: tuple[str, str, str] = ("G", "S", "G"), scale: bool = True, weights: DataFrame | None = None, also: tuple[str, ...] = ()
) -> DataFrame:
    """R6: biophysical parameters, motif, aggregation and penalties of each sequence, and their z-scores.

    weights: the dipeptides' weights (pair, weight), for the instability index. also: columns of ``df`` to be scaled with the others, as an alignment's score.
    """
    ready(df.sparkSession)
    rows = residues.with_counts(df, sequence, "__n")
    s, n, length = F.col(sequence), F.col("__n"), F.length(sequence)
    p = residues.all_params(s, n, length)
    # side by side, what Python computes takes one worker for each task
    found = {"__p": p, "motif_center": motifs.motif_center(s, pattern), "__agg": motifs.max_hydrophobic_window(s)}
    if weights is not None:
        found["__instability"] = residues.instability(s, weights)
    rows = rows.withColumns(found)
    mode = mode_smallest(df.select(F.length(sequence).alias("__l")), "__l", "__mode")
    rows = rows.crossJoin(F.broadcast(mode)).withColumn("__w", motifs.window(s, F.col("motif_center")))
    rows = rows.select(
        *df.columns,
        length.alias("seq_len"),
        *(F.col(f"__p.{c}").alias(c) for c in ("iep", "charge7", "charge9", "charge55", "molecular_weight", "hydrophobicity", "pg_fraction")),
        "motif_center",
        (F.col("motif_center") >= 0).cast("int").alias("motif_present"),
        (1 - (F.col("motif_center") >= 0).cast("int")).alias("motif_penalty"),
        motifs.window_charge(F.col("__w"), 5.5).alias("local_charge55"),
        motifs.window_charge(F.col("__w"), 9.0).alias("local_charge90"),
        F.col("__agg").alias("agg_window"),
        motifs.max_hydrophobic_run(s).alias("agg_run"),
        length_penalty(length, F.col("__mode")).alias("length_penalty"),
        *([F.col("__instability").alias("instability_index")] if weights is not None else []),
    )
    scaled = ["iep", "charge7", "charge9", "charge55", "molecular_weight", "hydrophobicity", "pg_fraction", "local_charge55", "local_charge90", "agg_window", "agg_run", "length_penalty", *also]
    if weights is not None:
        scaled.append("instability_index")
    return zscore(stored(rows, "properties"), scaled) if scale else rows  # made once: the scales read it before the rows do


#: What the cluster-aware recipe scales: the column, and whether within clusters and over all rows.
_R1_INPUTS = ("delta_ll", "ll", "hydropathy", "pg", "length", "local55", "local90", "agg_window", "agg_run")


def cluster_aware(df: DataFrame, sequence: str = "sequence", cluster: str = "cluster_id", pattern: tuple[str, str, str] = ("G", "S", "G")) -> DataFrame:
    """R1: activity_1, activity_2, expression from a table with sequence, cluster, ll, rep_ll and optionally delta_emb.

    Columns are centred in their cluster, then scaled by robust z; ll is also scaled over all rows. Rows without a cluster share
    one of their own. A delta that is missing in a row is the median; a table without any drops the term.
    """
    require_columns(df, [sequence, cluster, "ll", "rep_ll"], "cluster_aware")
    ready(df.sparkSession)
    # side by side, motif and window take one worker for each task
    found = {"__c": motifs.motif_center(F.col(sequence), pattern), "__agg": motifs.max_hydrophobic_window(F.col(sequence))}
    rows = residues.with_counts(df, sequence, "__n").withColumns(found)
    mode = mode_smallest(df.select(F.length(sequence).alias("__l")), "__l", "__mode")
    rows = rows.crossJoin(F.broadcast(mode)).withColumn("__w", motifs.window(F.col(sequence), F.col("__c")))
    s, length = F.col(sequence), F.length(sequence)
    delta = "delta_emb" in df.columns
    rows = rows.select(
        *df.columns,
        (F.col("ll") - F.col("rep_ll")).alias("delta_ll"),
        residues.hydropathy(F.col("__n"), length).alias("hydropathy"),
        residues.pro_gly_fraction(s).alias("pg"),
        length_penalty(length, F.col("__mode"), 1.5).alias("length"),
        motifs.window_charge(F.col("__w"), 5.5).alias("local55"),
        motifs.window_charge(F.col("__w"), 9.0).alias("local90"),
        F.col("__agg").alias("agg_window"),
        motifs.max_hydrophobic_run(s).cast("double").alias("agg_run"),
        (F.col("__c") < 0).cast("int").alias("motif_penalty"),
    )
    inputs = list(_R1_INPUTS)
    rows = stored(rows, "features")  # scaling reads them several times; the features are made once
    if delta:
        rows = impute_median(rows, ["delta_emb"])
        inputs.append("delta_emb")
    rows = stored(centered(rows, inputs, cluster, "__k_"), "centred")
    rows = robust_z(rows, [f"__k_{c}" for c in inputs], "__z_")
    rows = rows.withColumns({f"c_{c}": F.col(f"__z___k_{c}") for c in inputs})
    rows = robust_z(rows, ["ll", *(["delta_emb"] if delta else [])], "g_")
    term = _sum(K.R1_DELTA) if delta else F.lit(0.0)
    core = _sum(K.R1_CORE) + K.R1_CORE_LOCAL55 * F.abs("c_local55") + term
    scores = {
        "activity_1": core + K.R1_ACTIVITY_1_MOTIF * F.col("motif_penalty"),
        "activity_2": core + _sum(K.R1_ACTIVITY_2) + K.R1_ACTIVITY_2_LOCAL90 * F.abs("c_local90") + K.R1_ACTIVITY_2_MOTIF * F.col("motif_penalty"),
        "expression": _sum(K.R1_EXPRESSION) + K.R1_EXPRESSION_DELTA * term,
    }
    return rows.select(*df.columns, *(finite_or(v).alias(k) for k, v in scores.items()))


def final_parameters(df: DataFrame, style: str = "safe") -> DataFrame:
    """R2: scores from a table of parameters, all of them optional (0 if absent) and scaled by robust z.

    Columns: align, phopt, instability, weight, delta, charge7, charge9, charge5 (or charge55), iep.
    """
    names = ("align", "phopt", "instability", "weight", "delta", "charge7", "charge9", "iep")
    five = "charge5" if "charge5" in df.columns else "charge55"
    rows = df.withColumns({f"__{c}": col_or_lit(df, c).cast("double") for c in names} | {"__charge5": col_or_lit(df, five).cast("double")})
    inputs = [f"__{c}" for c in (*names, "charge5")]
    rows = stored(rows.select(*df.columns, *inputs), "parameters")  # the statistics read them several times
    rows = impute_median(rows, inputs).fillna(0.0, inputs)
    rows = robust_z(rows, inputs, "z")
    z = lambda weights: _sum({f"z__{c}": w for c, w in weights.items()})
    act = z(K.R2_ACTIVITY[style])
    clip = lambda x: clipped(x, -K.R2_CLIP, K.R2_CLIP)
    return rows.select(
        *df.columns,
        clip(act).alias("activity_1"),
        clip(K.R2_SECOND * act + K.R2_SECOND_PHOPT * F.col("z__phopt")).alias("activity_2"),
        clip(z(K.R2_EXPRESSION[style])).alias("expression"),
    )


def profile_composite(df: DataFrame) -> DataFrame:
    """R3: z by fixed scales, the mean of the unsupervised four, and its mean with the supervised one; null if all raw scores are 0."""
    absent = reduce(lambda a, b: a & b, (F.col(c) == 0 for c in K.R3_SCALES))
    z = {c: F.when(~absent, (F.col(c) - m) / sd) for c, (m, sd) in K.R3_SCALES.items()}
    rows = df.withColumns({f"z_{c}": x for c, x in z.items()})
    rest = [F.col(f"z_{c}") for c in K.R3_SCALES if c != "supervised"]
    rows = rows.withColumn("unsupervised", reduce(add, rest) / len(rest))
    return rows.withColumn("composite", (F.col("z_supervised") + F.col("unsupervised")) / 2)


def profile_raw_scores(
    df: DataFrame, models: DataFrame, references: DataFrame, matrix: DataFrame, roles: dict[str, str], sequence: str = "sequence", supervised: str = "supervised", alphabet: str = K.AMINO_ACIDS, **costs: float
) -> DataFrame:
    """R3's raw scores beside the rows: each role's profile (its forward score), and blosum, the highest matrix score with a reference.

    roles: the family of models that stands for family_hmm, site_hmm and homologs_hmm. The supervised score is a column of the rows; what is missing is 0, as
    the composite expects. A null or empty sequence has no scores: all of them are 0.
    """
    texts = df.select(sequence).filter(F.length(sequence) > 0)
    wanted = models.filter(F.col("family").isin(*roles.values()))
    found = profiles.profile_scores(texts, wanted, sequence, alphabet)
    by_role = [F.max(F.when(F.col("family") == family, F.col("forward"))).alias(role) for role, family in roles.items()]
    hmm = found.groupBy("sequence").agg(*by_role)
    best = matrices.matrix_with_all(texts, references, matrix, sequence, **costs).groupBy("sequence").agg(F.max("matrix_score").alias("blosum"))
    raw = hmm.join(best, "sequence", "full").withColumnRenamed("sequence", "__s")
    names = [*roles, "blosum"]
    keep = [c for c in df.columns if c not in names]
    out = df.select(*keep).join(raw, F.col(sequence) == F.col("__s"), "left").drop("__s")
    real = F.coalesce(F.length(sequence) > 0, F.lit(False))
    value = lambda c: F.when(real, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0)
    return out.withColumns({c: value(c) for c in names} | {"supervised": value(supervised) if supervised in df.columns else F.lit(0.0)})


def kinetics_activity(df: DataFrame, s0: float, enzyme_mgml: float = 1.0, mw_kda: float = 30.0, volume_ml: float = 1.0, unit: str = "mM", per_second: bool = True, expression: str | None = None) -> DataFrame:
    """R5: v0 and specific activity from kcat and km; the enzyme's concentration may come from a column."""
    kcat = kinetics.per_minute(F.col("kcat")) if per_second else F.col("kcat")
    enzyme = F.coalesce(F.col(expression), F.lit(enzyme_mgml)) if expression else F.lit(enzyme_mgml)
    v0 = kinetics.michaelis_menten(kcat, F.col("km"), F.lit(s0), kinetics.mgml_to_molar(enzyme, F.lit(mw_kda)))
    return df.withColumn("v0", v0).withColumn("specific_activity", kinetics.specific_activity(F.col("v0"), F.lit(volume_ml), enzyme * volume_ml, unit))


def ensemble_mean(columns: list[str]) -> Column:
    return reduce(add, (F.col(c) for c in columns)) / len(columns)
