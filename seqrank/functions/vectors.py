"""Dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_safe(a: Column, b: Column, floor: float = 1e-8) -> Column:
    """Cosine with a small number added to each norm."""
    return dot(a, b) / ((norm(a) + floor) * (norm(b) + floor))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l2_normalised(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(norm(a) > 0, x.cast("double") / norm(a)).otherwise(x.cast("double")))


def mean_pool(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """key, pooled: the mean of each component over a key's vectors. Components are averaged as rows, combined in the map tasks."""
    parts = df.select(*key, F.posexplode(vector).alias("i", "x")).groupBy(*key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    pooled = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("p"))
    return pooled.select(*key, F.transform("p", lambda s: s["m"]).alias("pooled"))


def token_log_likelihood(logits: Column, tokens: Column, special: tuple[int, ...] = ()) -> Column:
    """Mean log-probability of a sequence's own tokens under a model's logits; special tokens (begin, end, padding) don't count.

    logits: an array of scores over the vocabulary for each position; tokens: the token id at each. Null if no position counts.
    """
    pairs = F.arrays_zip(logits.alias("scores"), tokens.alias("token"))
    kept = F.filter(pairs, lambda p: ~p["token"].isin(list(special))) if special else pairs

    def log_probability(p: Column) -> Column:
        scores = F.transform(p["scores"], lambda x: x.cast("double"))
        top = F.array_max(scores)
        total = F.aggregate(scores, F.lit(0.0), lambda t, x: t + F.exp(x - top))
        return F.element_at(scores, p["token"] + 1) - top - F.log(total)

    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda t, p: t + log_probability(p)), F.size(kept))
