"""Hashed k-mer vectors as sparse rows: never a dense array per sequence."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.meeting import behind, groups, numbered
from ..session import ship, stored
from .batches import MARKS, side_by_side, slices


def fnv1a(word: Column, length: int, dim: int) -> Column:
    """32-bit FNV-1a of an ASCII word of a fixed length, modulo dim: straight arithmetic, so it is compiled."""
    h = F.lit(K.FNV_OFFSET).cast("long")
    for i in range(1, length + 1):
        h = (h.bitwiseXOR(F.ascii(F.substring(word, i, 1)).cast("long")) * F.lit(K.FNV_PRIME)).bitwiseAND(F.lit(K.FNV_MASK).cast("long"))
    return F.pmod(h, F.lit(dim)).cast("int")


def kmer_words(s: Column, k: int) -> Column:
    """All overlapping k-mers in one pass (a substring by position would walk the string from its start each time)."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def _counted(df: DataFrame, key: list[str], k: int, dim: int, valid_only: bool) -> DataFrame:
    """key, buckets, counts, weights of each row of key and s that has a k-mer: its buckets ascending, how many k-mers fall into each, and those scaled to unit length."""
    ship(df.sparkSession)
    letters = np.array(sorted(map(ord, K.AMINO_ACIDS)), np.uint32)
    offset, prime = np.uint32(K.FNV_OFFSET), np.uint32(K.FNV_PRIME)

    def vectors(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts with k residues at least: row, bucket and count, by row and bucket."""
        codes, sizes, begins = side_by_side(texts)
        n = len(codes) - k + 1
        rows = np.repeat(np.arange(len(sizes)), sizes + MARKS)[:n]
        ok = np.arange(n) - begins[rows] <= sizes[rows] - k
        h = np.full(n, offset)
        for j in range(k):
            h = (h ^ codes[j : j + n]) * prime  # modulo 2^32
        if valid_only:
            known = np.isin(codes, letters)
            for j in range(k):
                ok &= known[j : j + n]
        cells, counts = np.unique(rows[ok] * dim + h[ok] % dim, return_counts=True)
        return cells // dim, cells % dim, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("s")).to_pandas()
            heads = batch.select(key)
            for a, b in slices(texts.str.len().to_numpy(np.int64)):
                rows, buckets, counts = vectors(texts.iloc[a:b])
                norms = np.sqrt(np.bincount(rows, counts * counts, b - a))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=b - a))]), pa.int32())
                cells = (pa.array(buckets, pa.int32()), pa.array(counts, pa.int64()), pa.array(counts / norms[rows]))
                out = pa.RecordBatch.from_arrays([*heads.slice(a, b - a).columns, *(pa.ListArray.from_arrays(ends, c) for c in cells)], [*key, "buckets", "counts", "weights"])
                yield out.filter(pa.array(norms > 0))

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)
    return df.select(*key, "s").mapInArrow(run, f"{kinds}, buckets array<int>, counts array<long>, weights array<double>")


def kmer_vectors(df: DataFrame, key: list[str], sequence: str = "sequence", k: int = K.KMER, dim: int = K.KMER_DIM, valid_only: bool = False) -> DataFrame:
    """key, buckets, counts, weights: each key's sparse vector as one row. valid_only: of k-mers of the 20 amino acids alone.

    K-mers are counted by numpy in an Arrow batch, so that no row per k-mer is made or shuffled. Keys that several rows have are found first; the vectors
    of those rows alone are added up by key and bucket.
    """
    rows = df.select(*key, F.col(sequence).alias("s")).filter(F.length("s") >= k)
    held = df.groupBy(*(F.col(c).alias(f"__{c}") for c in key)).agg(F.count("*").alias("__n"))
    repeated = stored(held.filter("__n > 1").drop("__n"), "repeated")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key))
    single = _counted(rows.join(repeated, same, "left_anti"), key, k, dim, valid_only)
    parts = _counted(rows.join(repeated, same, "left_semi"), key, k, dim, valid_only)
    cells = parts.select(*key, F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(*key, F.col("x.buckets").alias("b")).agg(F.sum("x.counts").alias("c"))
    added = cells.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("x"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))  # dim at most
    return single.union(added.select(*key, "x.b", "x.c", F.transform("x.c", lambda c: c / F.col("norm"))))


def unit_rows(df: DataFrame, key: list[str], sequence: str = "sequence", k: int = K.KMER, dim: int = K.KMER_DIM, valid_only: bool = False) -> DataFrame:
    """key, bucket, w: each sequence's vector scaled to unit length."""
    v = kmer_vectors(df, key, sequence, k, dim, valid_only)
    return v.select(*key, F.explode(F.arrays_zip("buckets", "weights")).alias("x")).select(*key, F.col("x.buckets").alias("bucket"), F.col("x.weights").alias("w"))


def kmer_buckets(df: DataFrame, key: list[str], sequence: str = "sequence", k: int = K.KMER, dim: int = K.KMER_DIM, valid_only: bool = False) -> DataFrame:
    """key, bucket, c: how many k-mers of each sequence fall into a bucket. valid_only: of the 20 amino acids alone."""
    v = kmer_vectors(df, key, sequence, k, dim, valid_only)
    return v.select(*key, F.explode(F.arrays_zip("buckets", "counts")).alias("x")).select(*key, F.col("x.buckets").alias("bucket"), F.col("x.counts").alias("c"))


def unit_vectors(buckets: DataFrame, key: list[str], frequency: bool = False) -> DataFrame:
    """key, bucket, w: each sequence's vector scaled to unit length (of frequencies or of counts: the same direction)."""
    norms = buckets.groupBy(*key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"), F.sum("c").alias("total"))
    scaled = F.col("c") / F.col("norm") if not frequency else (F.col("c") / F.col("total")) / (F.col("norm") / F.col("total"))
    return buckets.join(norms, key).select(*key, "bucket", scaled.alias("w"))


def cosine_to(df: DataFrame, references: DataFrame, key: str, other: str, sequence: str = "sequence", ref: str = "ref_sequence", k: int = K.KMER, dim: int = K.KMER_DIM, per_block: int = 256) -> DataFrame:
    """key, other, cosine of all rows with all references that share a bucket, of k-mers of the 20 amino acids alone.

    References are dealt over blocks, and a block is sent once for some hundred rows; in an Arrow batch the k-mers of the rows are
    counted by numpy and their vectors multiplied with the block's as matrices. No row per k-mer is made or shuffled.
    """
    known = references.filter(F.col(ref).isNotNull()).select(F.col(other).cast("long").alias("i"), F.col(ref).alias("r"))
    last = known.agg(F.when(F.count("*") > 0, F.ceil(F.count("*") / per_block) - 1).alias("__end"))  # one row
    blocks = known.join(F.broadcast(last)).select(F.pmod(F.xxhash64("i"), F.col("__end") + 1).alias("block"), "i", "r")
    letter = np.full(256, -1, np.int64)
    letter[np.frombuffer(K.AMINO_ACIDS.encode(), np.uint8)] = np.frombuffer(K.AMINO_ACIDS.encode(), np.uint8)
    offset, prime, mask = K.FNV_OFFSET, K.FNV_PRIME, K.FNV_MASK

    def matrix(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float64)
        for row, t in zip(out, texts, strict=True):
            codes = letter[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)]
            n = len(codes) - k + 1
            if n < 1:
                continue
            h, ok = np.full(n, offset, np.int64), np.ones(n, bool)
            for j in range(k):
                part = codes[j : j + n]
                ok &= part >= 0
                h = ((h ^ np.maximum(part, 0)) * prime) & mask
            row += np.bincount(h[ok] % dim, minlength=dim)
            if (size := math.sqrt(float(row @ row))) > 0:
                row /= size
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = ids = other_side = None
        for heads, held in groups(batches, 256):
            if heads is not at:
                at, ids, other_side = heads, np.array([h["i"] for h in heads], np.int64), matrix([h["r"] for h in heads]).T.copy()
            dots = matrix([r["s"] for r in held]) @ other_side
            x, y = np.nonzero(dots)
            names = pa.array([r["__key"] for r in held], pa.int64())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), pa.array(ids[y]), pa.array(dots[x, y])], [key, other, "cosine"])

    rows = df.filter(F.col(sequence).isNotNull()).select(F.col(key).cast("long").alias("__key"), F.col(sequence).alias("s"))
    met = behind(numbered(rows, last, "block"), blocks, "block", "s", [F.col("i")])
    return met.mapInArrow(run, f"{key} long, {other} long, cosine double")


def centrality(vectors: DataFrame, key: str, group: str) -> DataFrame:
    """key, group, centrality: mean cosine to the others of a group; 1 for one alone.

    The mean of the cosines to all others is the dot product with the group's summed vector less the vector's own, so no pair is ever made.
    The sums are written, so that their size is known: where they are small they meet the vectors by broadcast.
    """
    sums = stored(vectors.groupBy(group, "bucket").agg(F.sum("w").alias("total")), "sums")
    sizes = vectors.groupBy(group).agg(F.countDistinct(key).alias("n"))
    dots = vectors.join(sums, [group, "bucket"]).groupBy(key, group).agg(F.sum(F.col("w") * F.col("total")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("own"))
    mean = F.when(F.col("n") > 1, (F.col("dot") - F.col("own")) / (F.col("n") - 1)).otherwise(F.lit(1.0))
    return dots.join(sizes, group).select(key, group, mean.alias("centrality"))
