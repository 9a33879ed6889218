"""String preparation for models, cache keys and penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def both_ends(s: Column, most: int = 1000) -> Column:
    """A sequence longer than ``most``: its first and last half of that."""
    half = most // 2
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(half)), F.right(s, F.lit(half)))).otherwise(s)


def spaced(s: Column) -> Column:
    """Residues apart, rare ones as X."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[UZOB]", "X"), "(.)", "$1 "))


def token_ids(tokens: Column, vocabulary: Column, most: int = 218, pad: int = 0, unknown: int = 1, end: int = 2, begin: int = 3) -> Column:
    """Token ids of a fixed length: of too many tokens the first and last half, between begin and end, padded.

    vocabulary: a map from token to id.
    """
    half = most // 2
    cut = F.when(F.size(tokens) > most, F.concat(F.slice(tokens, 1, half), F.slice(tokens, -half, half))).otherwise(tokens)
    ids = F.transform(cut, lambda t: F.coalesce(F.try_element_at(vocabulary, t), F.lit(unknown)))
    marked = F.concat(F.array(F.lit(begin)), ids, F.array(F.lit(end)))
    return F.concat(marked, F.array_repeat(F.lit(pad), F.lit(most + 2) - F.size(marked)))


def cache_key(model: Column, sequence: Column) -> Column:
    return F.sha1(F.concat_ws("|", model, sequence))


def length_penalty(length: Column, mode: Column, power: float = 1.0) -> Column:
    share = F.abs(length - mode) / mode
    return 0.0 - (share if power == 1.0 else F.pow(share, F.lit(power)))


def hamming_rate(s: Column, wt: Column) -> Column:
    """Mismatches in percent of the wild type's length; null if lengths differ (an alignment would have to be chosen)."""
    mismatches = F.aggregate(F.zip_with(F.split(s, ""), F.split(wt, ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda t, x: t + x)
    return F.when((F.length(s) == F.length(wt)) & (F.length(wt) > 0), mismatches / F.length(wt) * 100.0)


def csv_out_name(name: str, suffix: str) -> str:
    """``x.csv`` as ``x<suffix>.csv``."""
    return f"{name.removesuffix('.csv')}{suffix}.csv"
