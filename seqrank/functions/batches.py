"""Texts of an Arrow batch side by side in numpy, some at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

#: Marks behind each text, and the residues that are looked at together: what a worker holds doesn't grow with the batch.
MARKS, SLICE = 4, 1 << 19


def side_by_side(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts with marks (0) between them, their sizes, and where each begins."""
    sizes = texts.str.len().to_numpy(np.int64)
    gap = "\0" * MARKS
    codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, sizes, np.concatenate([[0], np.cumsum(sizes + MARKS)[:-1]]) if len(sizes) else sizes


def slices(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of texts of these sizes that hold SLICE residues, or one text more."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes + MARKS) // SLICE)) + 1
    return [(int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True) if a < b]


def in_slices(texts: pd.Series, found: Callable[[pd.Series], np.ndarray], kind: type) -> pd.Series:
    """What ``found`` gives for the texts, a slice of them at a time."""
    parts = [found(texts.iloc[a:b]) for a, b in slices(texts.str.len().to_numpy(np.int64))] if len(texts) else []
    return pd.Series(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
