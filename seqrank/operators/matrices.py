"""Global alignment scores of pairs by a substitution matrix with affine gaps.

The matrix is the caller's table. Pairs of an Arrow batch are worked on together, sorted by length: a dynamic programme over anti-diagonals takes all
cells of a diagonal of all pairs in one step, and holds three diagonals, so memory grows with one sequence's length and not with both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .alignment import blocks_of
from .meeting import behind, groups, numbered

#: Cells of a diagonal and pairs that are worked on at once, the most residues that a matrix may have, and references in a block.
CELLS, TOGETHER, RESIDUES, BLOCK = 1 << 18, 1024, 256, 64
_LOST = -1e18


class Matrix:
    """Scores by residues' numbers; residues that the table lacks have a number of their own."""

    def __init__(self, rows: list[tuple[str, str, float]], other: float):
        letters = sorted({a.upper() for a, _, _ in rows} | {b.upper() for _, b, _ in rows})
        self.number = {c: k for k, c in enumerate(letters)}
        self.scores = np.full((len(letters) + 2, len(letters) + 2), float(other))  # the last is for what lies behind a sequence's end
        for a, b, x in rows:
            self.scores[self.number[a.upper()], self.number[b.upper()]] = x

    def turned(self) -> Matrix:
        """The same for pairs in the other order."""
        out = Matrix([], 0.0)
        out.number, out.scores = self.number, self.scores.T
        return out

    def encoded(self, texts: list[str]) -> np.ndarray:
        other = len(self.number)
        out = np.full((len(texts), max(map(len, texts), default=0)), other + 1, np.int16)
        for k, t in enumerate(texts):
            out[k, : len(t)] = [self.number.get(c, other) for c in t]
        return out

    def align(self, one: list[str], two: list[str], opened: float, extended: float) -> np.ndarray:
        """Each pair's best score: a gap of n residues costs opened + (n - 1) * extended."""
        sizes, widths = np.array([len(t) for t in one]), np.array([len(t) for t in two])
        a, b = self.encoded(one), self.encoded(two)
        rows, width = len(one), b.shape[1] + 1
        place = np.arange(width)  # residues of the second sequence behind a cell
        lost = np.full((rows, width), _LOST)
        best1, best2, down1, along1 = lost, lost, lost, lost
        out = np.full(rows, _LOST)
        for diagonal in range(int((sizes + widths).max(initial=0)) + 1):
            i = diagonal - place
            down, along, best = lost.copy(), lost.copy(), lost.copy()
            if diagonal == 0:
                best[:, 0] = 0.0
            inside = (i >= 1) & (i <= a.shape[1])
            down[:, inside] = np.maximum(best1 - opened, down1 - extended)[:, inside]  # a residue of the first faces a gap
            along[:, 1:] = np.maximum(best1 - opened, along1 - extended)[:, :-1]
            at = place[inside & (place >= 1)]
            if len(at):
                best[:, at] = best2[:, at - 1] + self.scores[a[:, i[at] - 1], b[:, at - 1]]
            along[:, i < 0] = _LOST
            best = np.maximum(best, np.maximum(down, along))
            done = np.flatnonzero(sizes + widths == diagonal)
            out[done] = best[done, widths[done]]
            best2, best1, down1, along1 = best1, best, down, along
        return out


    def pairs(self, one: list[str | None], two: list[str | None], opened: float, extended: float) -> list[float | None]:
        """The same for pairs of any lengths, in batches of like ones; null where one of a pair is."""
        score: list[float | None] = [None] * len(one)
        real = [k for k in range(len(one)) if one[k] is not None and two[k] is not None]
        # the diagonal runs along the shorter one of a pair, for which the matrix is turned
        for turned in (False, True):
            some = [k for k in real if (len(one[k]) < len(two[k])) == turned]
            some.sort(key=lambda k: (min(len(one[k]), len(two[k])), len(one[k]) + len(two[k])))
            own = self.turned() if turned else self
            while some:
                few = max(1, min(TOGETHER, CELLS // (1 + min(len(one[some[-1]]), len(two[some[-1]])))))
                part, some = some[-few:], some[:-few]
                x, y = [one[k].upper() for k in part], [two[k].upper() for k in part]
                got = own.align(y, x, opened, extended) if turned else own.align(x, y, opened, extended)
                for k, v in zip(part, got.tolist(), strict=True):
                    score[k] = v
        return score


def known_matrix(matrix: DataFrame, opened: float, extended: float, other: float) -> Matrix:
    """A caller's table (a, b, score) of single residues, in any case and for both orders. other: the score of residues that it lacks."""
    if opened < extended:
        raise ValueError("opening a gap must cost as much as extending it at least")
    rows = matrix.select("a", "b", F.col("score").cast("double")).distinct().limit(RESIDUES * RESIDUES + 1).collect()  # residues x residues
    if len(rows) > RESIDUES * RESIDUES or any(len(a) != 1 or len(b) != 1 for a, b, _ in rows):
        raise ValueError(f"a matrix has a row for two single residues, of {RESIDUES} at most")
    return Matrix([tuple(r) for r in rows], other)


def matrix_scores(pairs: DataFrame, matrix: DataFrame, sequence: str = "sequence", ref: str = "ref_sequence", opened: float = 11.0, extended: float = 1.0, other: float = -1.0) -> DataFrame:
    """The rows with matrix_score, the best global alignment's of each pair; null where one of a pair is."""
    ship(pairs.sparkSession)
    table = known_matrix(matrix, opened, extended, other)
    names = [*pairs.columns, "matrix_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (sequence, ref))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(table.pairs(one, two, opened, extended), pa.float64())], names)

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields), "matrix_score double"])
    return pairs.mapInArrow(run, kinds)


def matrix_with_all(df: DataFrame, references: DataFrame, matrix: DataFrame, sequence: str = "sequence", ref: str = "ref_sequence", ref_id: str = "ref_id", opened: float = 11.0, extended: float = 1.0, other: float = -1.0) -> DataFrame:
    """sequence, ref_id, matrix_score: each distinct sequence with each reference (null ones left out). Sequences meet references in blocks."""
    ship(df.sparkSession)
    table = known_matrix(matrix, opened, extended, other)
    rows = df.select(F.col(sequence).alias("sequence")).filter("sequence is not null").distinct()
    blocks = blocks_of(references, ref, ref_id, BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for heads, held in groups(batches, TOGETHER // 16):
            one, two, ids = zip(*((r["sequence"], h["r"], h["i"]) for r in held for h in heads), strict=True)
            score = table.pairs(list(one), list(two), opened, extended)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["sequence", "ref_id", "matrix_score"])

    met = behind(numbered(rows, blocks.agg(F.max("block")), "block"), blocks, "block", "sequence")
    return met.mapInArrow(run, "sequence string, ref_id long, matrix_score double")
