"""Embedding deltas against a wild type, and what a cache of embeddings lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import cache_key
from ..functions.vectors import cosine_safe


def delta(cosine: Column) -> Column:
    return 1.0 - cosine


def delta_given(df: DataFrame, delta_col: str = "delta_emb", cosine_col: str = "wt_cosine_sim") -> DataFrame:
    """The table with delta_emb: where it is absent or null it comes from the cosine to the wild type, if that is given."""
    given = [F.col(delta_col).cast("double")] if delta_col in df.columns else []
    given += [delta(F.col(cosine_col).cast("double"))] if cosine_col in df.columns else []
    return df.withColumn(delta_col, F.coalesce(*given)) if given else df


def with_delta(df: DataFrame, embeddings: DataFrame, sequence: str = "sequence", wt: str = "wt_sequence") -> DataFrame:
    """Adds wt_cosine_sim and delta_emb. embeddings: sequence, embedding; each distinct wild type is looked up once."""
    own = embeddings.select(F.col("sequence").alias(sequence), F.col("embedding").alias("__own"))
    other = embeddings.select(F.col("sequence").alias(wt), F.col("embedding").alias("__wt"))
    joined = df.join(own, sequence, "left").join(other, wt, "left")
    cosine = cosine_safe(F.col("__own"), F.col("__wt"))
    return joined.withColumns({"wt_cosine_sim": cosine, "delta_emb": delta(cosine)}).drop("__own", "__wt")


def usable(embedding: Column) -> Column:
    """Whether a cached vector can be used: it isn't null or empty, and holds finite numbers only."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & whole


def cache_missing(df: DataFrame, cache: DataFrame, model: str, sequence: str = "sequence") -> DataFrame:
    """key, sequence of the distinct sequences whose key the cache lacks."""
    keyed = df.select(cache_key(F.lit(model), F.col(sequence)).alias("key"), F.col(sequence).alias("sequence")).distinct()
    return keyed.join(cache.select("key"), "key", "left_anti")
