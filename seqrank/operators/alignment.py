"""Global alignment with match 1 and all else 0, that is the longest common subsequence, with references.

``all_scores`` has every score; ``best_references`` has the best reference of each sequence without scoring all; ``mutations`` aligns pairs.
References lie in blocks of like length. Sequences and blocks meet in a shuffle: the references of a block come once for some hundred sequences,
not beside each of them. In an Arrow batch the references of a pack lie side by side in one wide integer, with bits between them that take
each one's carries, and a bit-parallel recurrence takes one step per residue on all of them.

No score is above the sum over residues of the smaller of two counts, nor above the same sum with the largest counts of a whole block.
The search takes each sequence to its most promising block first, there meets packs of references by falling bounds until no bound is above the
best score, and takes the sequence to other blocks only where their bound could still hold a better one. What is left out can't win, so the
result is that of all scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored
from .meeting import behind, groups, numbered
from .stats import running_before

#: References in a block and in a pack; sequences that a block's references are sent with. Where all are scored and none is ruled out, packs are wider: fewer steps for the same bits.
BLOCK, PACK, TOGETHER, WIDE = 1024, 16, 512, 256
#: Residues that are counted apart; all others are one kind, which keeps bounds true.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Spare bits above a reference: each step's carry sets one more of them, so they are cleared once in so many steps.
SPARE = 8


class Packed:
    """References side by side in one integer, each with SPARE bits above it."""

    def __init__(self, references: list[str]):
        self.masks: dict[str, int] = {}
        self.full, self.places, at = 0, [], 0
        for r in references:
            for i, c in enumerate(r, at):
                self.masks[c] = self.masks.get(c, 0) | (1 << i)
            self.full |= ((1 << len(r)) - 1) << at
            self.places.append((at, len(r), (1 << len(r)) - 1))
            at += len(r) + SPARE

    def rows(self, sequence: str, v: int | None = None) -> Iterator[int]:
        """The row of the table behind each residue; a bit is 0 where the score rises."""
        v, full, get = self.full if v is None else v, self.full, self.masks.get
        for c in sequence:
            if m := get(c):
                u = v & m
                v = ((v + u) | (v ^ u)) & full  # what is carried out of a reference ends in the bits above it
            yield v

    def lcs(self, sequence: str) -> list[int]:
        """The length of the longest common subsequence with each reference."""
        v, full, get = self.full, self.full, self.masks.get
        for k in range(0, len(sequence), SPARE):
            for c in sequence[k : k + SPARE]:
                if m := get(c):
                    u = v & m
                    v = (v + u) | (v ^ u)
            v &= full
        return [n - (v >> at & own).bit_count() for at, n, own in self.places]


def matched(a: str, b: str) -> list[tuple[int, int]]:
    """The pairs of places (from 0, last pair first) of one longest common subsequence.

    From the ends, a place of ``a`` is passed over whenever what is left of ``a`` still has the whole score, then one of ``b``; else the two match.
    Every K-th row of the table is kept, K about the root of the length, and the rows between are made again: memory grows with len(b) * root of len(a) bits.
    """
    packed = Packed([b])
    every = max(1, int(len(a) ** 0.5))
    kept, v = [packed.full], packed.full
    for k, v in enumerate(packed.rows(a), 1):
        if k % every == 0:
            kept.append(v)
    i, j = len(a), len(b)
    score = j - v.bit_count()
    out = []
    while i and score:
        base = (i - 1) // every * every
        rows = [kept[base // every], *packed.rows(a[base:i], kept[base // every])]
        while i > base and score:
            low = (1 << j) - 1
            if j - (rows[i - 1 - base] & low).bit_count() < score:
                j = (~rows[i - base] & low).bit_length() - 1  # the first place of b where this score is reached
                out.append((i - 1, j))
                score -= 1
            i -= 1
    return out


def mismatch_columns(a: str, b: str) -> tuple[int, int]:
    """Score and mismatch columns. Strings of one length stand as they are; else what lies between two matches faces each other as far as both have some."""
    a, b = a.lower(), b.lower()
    pairs = matched(a, b)
    if len(a) == len(b):
        return len(pairs), sum(x != y for x, y in zip(a, b, strict=True))
    mismatches, x, y = 0, len(a), len(b)
    for i, j in [*pairs, (-1, -1)]:
        mismatches += min(x - i - 1, y - j - 1)
        x, y = i, j
    return len(pairs), mismatches


def mutations(pairs: DataFrame, sequence: str = "sequence", ref: str = "ref_sequence") -> DataFrame:
    """The rows with score, mismatches, gaps and mutation_rate (mismatch columns in percent of the reference's length) of each pair; null where one of a pair is, and the rate with an empty reference."""
    ship(pairs.sparkSession)
    names = [*pairs.columns, "score", "mismatches", "gaps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (sequence, ref)), strict=True):
                if a is None or b is None:
                    found.append((None,) * 3)
                    continue
                score, wrong = mismatch_columns(a, b)
                found.append((score, wrong, 0 if len(a) == len(b) else len(a) + len(b) - 2 * (score + wrong)))
            more = [pa.array([f[k] for f in found], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields), "score int", "mismatches int", "gaps int"])
    size = F.length(ref)
    return pairs.mapInArrow(run, kinds).withColumn("mutation_rate", F.when(size > 0, F.col("mismatches") / size * 100.0))


def blocks_of(references: DataFrame, ref: str, ref_id: str, size: int | None = None) -> DataFrame:
    """block, i, r: references (in lower case) of like length together, ``size`` (else BLOCK) in a block; null ones are left out."""
    known = references.filter(F.col(ref).isNotNull()).select(F.col(ref_id).cast("long").alias("i"), F.lower(ref).alias("r"))
    placed = running_before(known, [F.length("r"), F.col("r"), F.col("i")], F.lit(1), "place")
    return stored(placed.select(F.floor(F.col("place") / (size or BLOCK)).alias("block"), "i", "r"), "blocks")


class _Block:
    """The packs of a block's references."""

    def __init__(self, heads: list[dict], pack: int = PACK):
        cut = [heads[k : k + pack] for k in range(0, len(heads), pack)]
        self.packs = [Packed([h["r"] for h in c]) for c in cut]
        self.ids, self.lengths = [[h["i"] for h in c] for c in cut], [[len(h["r"]) for h in c] for c in cut]
        self.references = [h["r"] for h in heads]


def _met(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    return behind(rows, blocks, "block", "sequence", [F.length("r"), F.col("r"), F.col("i")], TOGETHER, spread=True)


def counted(text: str) -> np.ndarray:
    """How often each of LETTERS occurs, and all else."""
    own = np.array([text.count(c) for c in LETTERS])
    return np.append(own, len(text) - own.sum())


def block_scores(df: DataFrame, references: DataFrame, sequence: str = "sequence", ref: str = "ref_sequence", ref_id: str = "ref_id", by: str = "sequence") -> DataFrame:
    """sequence, found (array of struct<ref_id, ref_length, score>, by ref_id): a row for each distinct sequence and block of references (null ones left out).

    by: "key" names a sequence by its MD5 instead, so that its scores go on without it.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(sequence).alias("sequence")).filter("sequence is not null").distinct().select(F.md5("sequence").alias("key"), "sequence")
    blocks = blocks_of(references, ref, ref_id)
    kind = pa.list_(pa.struct([("ref_id", pa.int64()), ("ref_length", pa.int32()), ("score", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = block = ids = lengths = order = None
        for heads, held in groups(batches, PACK):
            if heads is not at:
                at, block = heads, _Block(heads, WIDE)
                ids, lengths = (np.array([x for c in part for x in c]) for part in (block.ids, block.lengths))
                order = np.argsort(ids, kind="stable")
            scores = [np.array([x for packed in block.packs for x in packed.lcs(text)])[order] for text in (r["sequence"].lower() for r in held)]
            cells = [pa.array(c, k) for c, k in ((np.tile(ids[order], len(held)), pa.int64()), (np.tile(lengths[order], len(held)), pa.int32()), (np.concatenate(scores), pa.int32()))]
            found = pa.ListArray.from_arrays(pa.array(range(0, len(held) * len(ids) + 1, len(ids)), pa.int32()), pa.StructArray.from_arrays(cells, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([pa.array([r[by] for r in held], pa.string()), found], [by, "found"])

    met = _met(numbered(rows, blocks.agg(F.max("block")), "block"), blocks)
    return met.mapInArrow(run, f"{by} string, found array<struct<ref_id:long,ref_length:int,score:int>>")


def all_scores(df: DataFrame, references: DataFrame, sequence: str = "sequence", ref: str = "ref_sequence", ref_id: str = "ref_id") -> DataFrame:
    """sequence, ref_id, ref_length, score: each distinct sequence with each reference (null ones left out)."""
    return block_scores(df, references, sequence, ref, ref_id).select("sequence", F.inline("found"))


def best_match(blocks: DataFrame) -> DataFrame:
    """sequence, best_ref_id, best_score of block_scores: the highest score above 0, the lowest id at a tie; null and 0 if there is none."""
    own = F.array_max(F.transform("found", lambda x: F.struct(x["score"].alias("score"), (-x["ref_id"]).alias("i"))))
    found = blocks.groupBy("sequence").agg(F.max(own).alias("b"))
    hit = F.col("b.score") > 0
    return found.select("sequence", F.when(hit, -F.col("b.i")).alias("best_ref_id"), F.col("b.score").alias("best_score"))


def _with_counts(df: DataFrame, text: str) -> DataFrame:
    """The rows with n, the counts of the residues of a column."""
    names = [*df.columns, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [counted(t.lower()).tolist() for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.list_(pa.int32()))], names)

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "n array<int>"]))


def _searched(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """key, score, ref_id, scored: the best in the block that a row (key, sequence, block, best, best_id) names, if it beats those, and how many were scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = block = members = firsts = None
        for heads, held in groups(batches, TOGETHER):
            if heads is not at:
                at, block = heads, _Block(heads)
                members = np.array([counted(r) for r in block.references])
                firsts = [min(ids) for ids in block.ids]
            out = []
            for row in held:
                low = row["sequence"].lower()
                # each reference's bound, then the highest of each pack
                most = np.maximum.reduceat(np.minimum(members, counted(low)).sum(1), np.arange(0, len(members), PACK))
                top, who, scored = row["best"] or 0, row["best_id"], 0
                for k in np.argsort(-most, kind="stable").tolist():
                    if most[k] < top:
                        break
                    if most[k] == top > 0 and who is not None and firsts[k] > who:  # at best a tie, which its ids would lose
                        continue
                    for i, x in zip(block.ids[k], block.packs[k].lcs(low), strict=True):
                        if x > top or (x == top and x > 0 and (who is None or i < who)):
                            top, who = x, i
                    scored += len(block.ids[k])
                out.append((row["key"], top, who, scored))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "score", "ref_id", "scored"])

    return _met(rows, blocks).mapInArrow(run, "key string, score int, ref_id long, scored long")


def best_references(df: DataFrame, references: DataFrame, sequence: str = "sequence", ref: str = "ref_sequence", ref_id: str = "ref_id") -> DataFrame:
    """sequence, best_ref_id, best_score, scored, references of each distinct sequence: the highest score above 0, the lowest id at a tie (null and 0 if there is none), how many
    references were scored for it, and how many there are. Without references there are no rows."""
    ship(df.sparkSession)
    blocks = blocks_of(references, ref, ref_id)
    texts = df.select(F.col(sequence).alias("sequence")).filter("sequence is not null").distinct().withColumn("key", F.md5("sequence"))
    rows = stored(_with_counts(texts, "sequence"), "counted")
    each = _with_counts(blocks, "r")
    most = each.groupBy("block").agg(F.array(*(F.max(F.col("n")[k]) for k in range(len(LETTERS) + 1))).alias("most"))
    bound: Column = F.aggregate(F.zip_with("n", "most", lambda a, b: F.least(a, b)), F.lit(0), lambda t, x: t + x)
    pairs = stored(numbered(rows.select("key", "n"), blocks.agg(F.max("block")), "block").join(F.broadcast(most), "block").select("key", "block", bound.alias("bound")), "pairs")
    first = pairs.groupBy("key").agg(F.max(F.struct("bound", (-F.col("block")).alias("b"))).alias("top")).select("key", (-F.col("top.b")).alias("block"))
    texts = rows.select("key", "sequence")
    found = stored(_searched(first.join(texts, "key").select("key", "sequence", "block", F.lit(None).cast("int").alias("best"), F.lit(None).cast("long").alias("best_id")), blocks), "found")
    begun = first.join(found.select("key", F.col("score").alias("best"), F.col("ref_id").alias("best_id")), "key").withColumnRenamed("block", "done")
    rest = pairs.join(begun, "key").filter("block <> done AND bound >= best AND bound > 0").join(texts, "key").select("key", "sequence", "block", "best", "best_id")
    every = found.union(_searched(rest, blocks))
    better = F.max(F.struct("score", (-F.col("ref_id")).alias("i"))).alias("b")
    out = every.groupBy("key").agg(better, F.sum("scored").alias("scored"))
    total = blocks.agg(F.count("*").alias("references"))  # one row
    return out.join(texts, "key").join(F.broadcast(total)).select("sequence", (-F.col("b.i")).alias("best_ref_id"), F.col("b.score").alias("best_score"), "scored", "references")


def score_arrays(blocks: DataFrame, by: str = "sequence") -> DataFrame:
    """sequence (or its key), scores, identity_percent of block_scores: arrays over the references in the order of their ids."""
    part = F.sort_array(F.flatten(F.collect_list("found")))  # each block's are in order
    rows = blocks.groupBy(by).agg(part.alias("p"))
    return rows.select(
        by,
        F.transform("p", lambda x: x["score"]).alias("scores"),
        F.transform("p", lambda x: F.round(100.0 * x["score"] / F.greatest(F.lit(1), x["ref_length"]), 6)).alias("identity_percent"),
    )
