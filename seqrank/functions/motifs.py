"""Motifs, windows and runs in a sequence: what depends on positions goes through Arrow batches, as numpy over all residues of a batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from ..session import ready_active
from .batches import in_slices, side_by_side
from .residues import net_charge, residue_count


#: Positions at either end where a motif's centre isn't taken.
EDGE = 10


def motif_center(s: Column, pattern: tuple[str, str, str] = ("G", "S", "G")) -> Column:
    """0-based position of the middle residue of ``a.b.c`` nearest to 0.4 of the length, the earlier at a tie; -1 if absent, null of null.

    Centres among the first or last EDGE positions don't count. One pass over an Arrow batch: residues side by side in numpy, a slice of the batch at a time.
    """
    ready_active()
    a, b, c = (ord(x) for x in pattern)
    edge = EDGE

    def nearest(texts: pd.Series) -> np.ndarray:
        codes, sizes, begins = side_by_side(texts)
        at = np.flatnonzero((codes[:-4] == a) & (codes[2:-2] == b) & (codes[4:] == c))  # no motif reaches over the marks between rows
        row = np.searchsorted(begins, at, "right") - 1
        center = at + 2 - begins[row]
        ok = (center >= edge) & (center <= sizes[row] - edge - 1)
        row, center = row[ok], center[ok]
        gap = np.abs(center - np.floor(sizes[row] * 0.4).astype(np.int64))
        order = np.lexsort((center, gap, row))
        rows, first = np.unique(row[order], return_index=True)
        out = np.full(len(texts), -1, np.int64)
        out[rows] = center[order][first]
        return out

    return F.when(s.isNotNull(), F.pandas_udf(lambda texts: in_slices(texts, nearest, np.int32), "int")(F.coalesce(s, F.lit(""))))


def window(s: Column, center: Column, width: int = 41) -> Column:
    """The residues around a 0-based centre, cut at the ends; empty without a centre."""
    half = width // 2
    begin = F.greatest(F.lit(0), center - half)
    end = F.least(F.length(s), center + half + 1)
    return F.when(center < 0, F.lit("")).otherwise(F.substring(s, begin + 1, F.greatest(F.lit(0), end - begin)))


def counts_of(s: Column) -> Column:
    """The charged residues' counts, as net_charge needs them."""
    return F.struct(*(residue_count(s, a).alias(a) for a in (*K.PK_POSITIVE, *K.PK_NEGATIVE)))


def window_charge(part: Column, ph: float) -> Column:
    return net_charge(part, counts_of(part), F.lit(ph))


def max_hydrophobic_window(s: Column, width: int = 9) -> Column:
    """Greatest share of hydrophobic residues in a window; of a shorter sequence the whole; 0 if empty, null of null.

    One pass over an Arrow batch: a running count of residues side by side in numpy, a slice of the batch at a time.
    """
    ready_active()
    marks = np.zeros(128, bool)
    marks[[ord(x) for x in K.HYDROPHOBIC]] = True

    def greatest(texts: pd.Series) -> np.ndarray:
        codes, sizes, begins = side_by_side(texts)
        total = np.concatenate([[0], np.cumsum(marks[np.minimum(codes, 127)])])
        spans = np.minimum(sizes, width)
        top = np.zeros(len(texts), np.int64)
        full = np.flatnonzero(sizes > 0)
        if len(full):
            inside = total[width:] - total[:-width] if len(total) > width else np.zeros(0, np.int64)
            long = full[sizes[full] >= width]
            if len(long):
                cuts = np.stack([begins[long], begins[long] + sizes[long] - width + 1], 1).ravel()
                top[long] = np.maximum.reduceat(np.concatenate([inside, [0]]), cuts)[::2]
            short = full[sizes[full] < width]
            top[short] = total[begins[short] + sizes[short]] - total[begins[short]]
        return np.where(sizes > 0, top / np.maximum(spans, 1), 0.0)

    return F.when(s.isNotNull(), F.pandas_udf(lambda texts: in_slices(texts, greatest, np.float64), "double")(F.coalesce(s, F.lit(""))))


def max_hydrophobic_run(s: Column) -> Column:
    """Length of the longest run of hydrophobic residues."""
    return F.coalesce(F.array_max(F.transform(F.split(s, f"[^{K.HYDROPHOBIC}]+"), lambda x: F.length(x))), F.lit(0))
