"""Residue expressions over a sequence column: all of them stay in the JVM but the isoelectric point.

Counts are made once as a struct column (see with_counts) and every other feature is arithmetic over it, so that the
expressions stay small.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import ready, ready_active
from .batches import MARKS, in_slices, side_by_side


def clean_sequence(s: Column) -> Column:
    """Upper case, rare codes replaced, everything but the 20 amino acids dropped."""
    return F.regexp_replace(F.translate(F.upper(s), *K.REPLACED), f"[^{K.AMINO_ACIDS}]", "")


def letters_to_sequence(text: Column) -> Column:
    """A sequence from any text: its ASCII letters in upper case, those that are no amino acid dropped."""
    return F.regexp_replace(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), f"[^{K.AMINO_ACIDS}]", "")


def residue_count(s: Column, residue: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(residue), F.lit("")))


def with_counts(df: DataFrame, sequence: str = "sequence", to: str = "n") -> DataFrame:
    counts = F.struct(*(residue_count(F.col(sequence), a).alias(a) for a in K.AMINO_ACIDS))
    return df.withColumn(to, counts)


def _weighted(n: Column, scale: dict[str, float]) -> Column:
    return reduce(add, (n[a] * F.lit(w) for a, w in scale.items()))


def _share(x: Column, length: Column) -> Column:
    return F.when(length > 0, x / length).otherwise(F.lit(0.0))


def composition(n: Column, length: Column) -> dict[str, Column]:
    """24 features: length, 20 shares, acidic and basic share, and the net charge proxy."""
    out = {"len": length}
    out |= {f"frac_{a}": _share(n[a], length) for a in K.AMINO_ACIDS}
    out["frac_acidic"] = _share(n["D"] + n["E"], length)
    out["frac_basic"] = _share(n["K"] + n["R"] + n["H"], length)
    out["net_charge_proxy"] = _share(n["K"] + n["R"] - n["D"] - n["E"], length)
    return out


def pro_gly_fraction(s: Column) -> Column:
    """Share of P and G in the string as it is (case counts, nothing is cleaned)."""
    return F.when(F.length(s) > 0, F.regexp_count(s, F.lit("[PG]")) / F.length(s)).otherwise(F.lit(0.0))


def hydropathy(n: Column, length: Column) -> Column:
    return _share(_weighted(n, K.HYDROPATHY), length)


def molecular_weight(n: Column, length: Column) -> Column:
    return F.when(length > 0, _weighted(n, K.MASS) - (length - 1) * F.lit(K.WATER)).otherwise(F.lit(0.0))


def _terminus(residue: Column, default: float, overrides: dict[str, float]) -> Column:
    out = F.lit(default)
    for a, pk in overrides.items():
        out = F.when(residue == a, F.lit(pk)).otherwise(out)
    return out


def net_charge(s: Column, n: Column, ph: Column) -> Column:
    """Henderson-Hasselbalch charge of side chains and termini; an empty sequence has none."""
    plus = lambda pk: 1.0 / (1.0 + F.pow(F.lit(10.0), ph - pk))
    minus = lambda pk: 1.0 / (1.0 + F.pow(F.lit(10.0), pk - ph))
    positive = [n[a] * plus(F.lit(pk)) for a, pk in K.PK_POSITIVE.items()]
    negative = [n[a] * minus(F.lit(pk)) for a, pk in K.PK_NEGATIVE.items()]
    first = plus(_terminus(F.left(s, F.lit(1)), K.PK_N_TERMINUS, K.PK_N_TERMINAL))
    last = minus(_terminus(F.right(s, F.lit(1)), K.PK_C_TERMINUS, K.PK_C_TERMINAL))
    return F.when(F.length(s) > 0, reduce(add, positive) + first - reduce(add, negative) - last).otherwise(F.lit(0.0))


def isoelectric_point(s: Column, n: Column) -> Column:
    """Bisection with a fixed number of steps, of all rows of an Arrow batch at once; it needs nine counts and the ends, never the sequence."""
    groups = [*K.PK_POSITIVE, *K.PK_NEGATIVE]
    pks = np.array([*K.PK_POSITIVE.values(), *K.PK_NEGATIVE.values()])
    sign = np.array([1.0] * len(K.PK_POSITIVE) + [-1.0] * len(K.PK_NEGATIVE))
    start, low, high, steps = K.PI_START, K.PI_LOW, K.PI_HIGH, K.PI_STEPS

    def bisected(counts: pd.DataFrame) -> pd.Series:
        c = counts.to_numpy(np.float64)
        own, first, last, full = c[:, : len(pks)], c[:, -3], c[:, -2], c[:, -1] > 0
        ph, lo, hi = (np.full(len(c), x) for x in (start, low, high))
        for _ in range(steps):
            # protonated bases and the first residue, less deprotonated acids and the last
            part = own / (1.0 + np.power(10.0, sign * (ph[:, None] - pks)))
            charge = part[:, sign > 0].sum(1) + 1.0 / (1.0 + np.power(10.0, ph - first)) - part[:, sign < 0].sum(1) - 1.0 / (1.0 + np.power(10.0, last - ph))
            up = np.where(full, charge, 0.0) > 0
            lo, hi = np.where(up, ph, lo), np.where(up, hi, ph)
            ph = (lo + hi) / 2
        return pd.Series(ph)

    first = _terminus(F.left(s, F.lit(1)), K.PK_N_TERMINUS, K.PK_N_TERMINAL)
    last = _terminus(F.right(s, F.lit(1)), K.PK_C_TERMINUS, K.PK_C_TERMINAL)
    inputs = [n[a].cast("double").alias(a) for a in groups] + [first.cast("double").alias("first"), last.cast("double").alias("last"), F.length(s).cast("double").alias("length")]
    found = F.pandas_udf(bisected, "double")(F.struct(*inputs))
    return F.when(s.isNotNull(), found)


def instability(s: Column, weights: DataFrame) -> Column:
    """10 / length times the sum of the weights of a sequence's dipeptides; 0 of fewer than two residues, null of null.

    weights (pair, weight) is the caller's table of at most 400 pairs, each once, which is checked; pairs that it lacks count nothing.
    One pass over the residues of an Arrow batch side by side: no row per dipeptide is made or shuffled.
    """
    size = weights.agg(F.count("*").alias("n"), F.countDistinct("pair").alias("pairs")).first()
    if size["n"] > len(K.AMINO_ACIDS) ** 2 or size["n"] != size["pairs"]:
        raise ValueError(f"instability weights: {size['n']} rows with {size['pairs']} pairs; at most {len(K.AMINO_ACIDS) ** 2}, each once, can be used")
    ready_active()
    known = {r["pair"]: r["weight"] or 0.0 for r in weights.filter(F.length("pair") == 2).collect()}  # 400 at most
    letters = np.array(sorted({ord(x) for pair in known for x in pair}), np.uint32)
    # the last row and column stand for what is in no pair
    table = np.zeros((len(letters) + 1, len(letters) + 1))
    for pair, weight in known.items():
        table[tuple(np.searchsorted(letters, [ord(x) for x in pair]))] = weight

    def scored(texts: pd.Series) -> np.ndarray:
        codes, sizes, begins = side_by_side(texts)
        at = np.searchsorted(letters, codes)
        at[at < len(letters)] = np.where(letters[at[at < len(letters)]] == codes[at < len(letters)], at[at < len(letters)], len(letters))
        worth = table[at[:-1], at[1:]]  # the marks between rows are in no pair
        rows = np.repeat(np.arange(len(sizes)), sizes + MARKS)[: len(worth)]
        return 10.0 / np.maximum(sizes, 1) * np.bincount(rows, worth, len(sizes))

    return F.when(s.isNotNull(), F.pandas_udf(lambda texts: in_slices(texts, scored, np.float64), "double")(F.coalesce(s, F.lit(""))))


def instability_index(df: DataFrame, weights: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """key, instability of each row, as ``instability`` has it; 0 of null."""
    ready(df.sparkSession)
    return df.select(key, F.coalesce(instability(F.col(sequence), weights), F.lit(0.0)).alias("instability"))


def all_params(s: Column, n: Column, length: Column, instability: Column | None = None) -> Column:
    """The named parameters of a sequence as one struct."""
    return F.struct(
        isoelectric_point(s, n).alias("iep"),
        net_charge(s, n, F.lit(7.4)).alias("charge7"),
        net_charge(s, n, F.lit(9.0)).alias("charge9"),
        net_charge(s, n, F.lit(5.5)).alias("charge55"),
        molecular_weight(n, length).alias("molecular_weight"),
        (instability if instability is not None else F.lit(None).cast("double")).alias("instability_index"),
        hydropathy(n, length).alias("hydrophobicity"),
        pro_gly_fraction(s).alias("pg_fraction"),
    )
