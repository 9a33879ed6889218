"""Exact top-k by inner product, pruned with segment means and deviations at several resolutions.

A vector is cut into segments; of each it keeps sqrt(length) * mean and the deviation sqrt(sum (x - mean)^2). For two vectors
their distance is at least that of these statistics, so a score (half of |a|^2 + |b|^2 - distance^2) is at most their inner
product. Resolutions of 1, 4 and 16 segments follow each other: what a coarse one rules out isn't looked at by a finer one,
and the survivors of the last get their exact integer score.

Equal vectors become one class first, with its smallest ids, as many as could appear in a list; so copies, however many, cost
one vector. Classes are ordered by their coarse statistics and lie in blocks, and so do the queries. A pair of blocks is bounded by
the extremes of their statistics. The most promising pairs are searched first; their k-th scores rule out whole pairs of blocks,
then rows, in the search of all others. Nothing else is left out, so results are exact. Each task holds two blocks.

Defined results: a vector takes part, as a query and as a candidate, if it has an id, is not null, and holds neither null nor
non-finite components, and if its squared length in integers is below 2^62, so that every score fits a long. Vectors of unlike
length are not compared; empty ones score 0 with each other. Rows repeated with id and vector count once; rows of one id with
different vectors are queries of their own, and no candidates of each other. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stats import running_before
from .common import map_arrow, scratch, stored, table, whole_groups
from .lloyd import whole_components

#: The contract's numbers: every so many ids is a query, length of a list, integer steps to a unit.
EVERY, TOP, STEPS = 20, 20, 64
#: A squared length below this keeps every score in a long.
LONGEST = 1 << 62
#: Segments at each resolution, coarse to fine; the one that pairs of blocks are bounded by.
LEVELS, BLOCK_LEVEL = (1, 4, 16), 4
#: Vectors in a block of candidates and in one of queries, queries that meet a block at once, and pairs of blocks searched first for each block of queries.
BLOCK, QUERY_BLOCK, TILE, FIRST = 8192, 4096, 128, 2
#: What rounding may add to a bound, as a share of the product of the lengths.
SLACK = 1e-9


def statistics(q: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(length) * mean of every segment, then every segment's deviation, of each row."""
    dims = q.shape[1]
    begins = np.unique(np.arange(segments) * dims // segments) if dims else np.zeros(0, np.int64)
    if not len(begins):
        return np.zeros((len(q), 0))
    x = q.astype(np.float64)
    sizes = np.diff(np.append(begins, dims))
    mean = np.add.reduceat(x, begins, axis=1) / sizes
    apart = x - np.repeat(mean, sizes, axis=1)
    return np.hstack([np.sqrt(sizes) * mean, np.sqrt(np.add.reduceat(apart * apart, begins, axis=1))])


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat integers of a list column, and the lists' lengths."""
    return np.asarray(column.flatten()).astype(np.int64), np.diff(np.asarray(column.offsets))


def _by_dims(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of like length as a matrix, with their places."""
    flat, sizes = _integers(column)
    ends = np.cumsum(sizes)
    for dims in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dims)
        yield at, flat[(ends[at] - dims)[:, None] + np.arange(dims)[None, :]]


def _located(classes: DataFrame) -> DataFrame:
    """classes with code, by whose order vectors with like coarse statistics lie together, and f, the statistics of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, f = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2 * BLOCK_LEVEL))
            for at, q in _by_dims(batch.column(0)):
                s = statistics(q, BLOCK_LEVEL)
                half = s.shape[1] // 2
                f[at[:, None], np.r_[:half, BLOCK_LEVEL : BLOCK_LEVEL + half][None, :]] = s
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None]
                steps = np.clip((s[:, :half] / np.where(length > 0, length, 1) + 1) * 8, 0, 15).astype(np.int64)
                for bit in (3, 2, 1, 0):
                    for j in range(half):
                        code[at] = 2 * code[at] + (steps[:, j] >> bit & 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.FixedSizeListArray.from_arrays(f.ravel(), 2 * BLOCK_LEVEL).cast(pa.list_(pa.float64()))], ["q", "key", "ids", "asks", "code", "f"])

    return map_arrow(classes.select("q", "key", "ids", "asks"), run, "q array<int>, key string, ids array<long>, asks boolean, code long, f array<double>")


def _extremes(rows: DataFrame, block: str) -> DataFrame:
    sides = [how(F.col("f")[j]).alias(f"{name}{j}") for j in range(2 * BLOCK_LEVEL) for how, name in ((F.min, "lo"), (F.max, "hi"))]
    return rows.groupBy(block).agg(*sides, F.min(F.size("q")).alias("shortest"), F.max(F.size("q")).alias("longest"))


def _pairs(asking: DataFrame, candidates: DataFrame) -> DataFrame:
    """qb, b, bound: what the score of a query in qb with a candidate in b can't be above. One row for every two blocks, none for their rows."""
    ours, theirs = _extremes(asking, "qb"), _extremes(candidates, "b")
    blocks = theirs.agg(F.max("b").alias("last"))
    dealt = ours.join(F.broadcast(blocks)).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).alias("x")
    met = dealt.join(theirs.alias("y"), "b").filter("x.shortest <= y.longest AND y.shortest <= x.longest")
    parts = []
    for j in range(2 * BLOCK_LEVEL):
        x, y = (F.col(f"x.lo{j}"), F.col(f"x.hi{j}")), (F.col(f"y.lo{j}"), F.col(f"y.hi{j}"))
        parts.append(F.greatest(*(a * c for a in x for c in y)))
    # the squared statistics of a vector add up to its squared length
    most = [F.sqrt(reduce(add, (F.greatest(F.col(f"{t}.lo{j}") ** 2, F.col(f"{t}.hi{j}") ** 2) for j in range(2 * BLOCK_LEVEL)))) for t in ("x", "y")]
    return met.select("qb", "b", (reduce(add, parts) + F.lit(SLACK) * most[0] * most[1] + F.lit(1e-3)).alias("bound"))


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of all rows of a with all of b; exact: doubles hold them."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else np.stack([np.einsum("j,ij->i", x, b) for x in a]).reshape(len(a), len(b))


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray, a_stats: list[np.ndarray], b_stats: list[np.ndarray], slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs (row of a, row of b) that no resolution rules out for a score of ``least`` (a row of a), and how many each left."""
    left: list[int] = []
    columns = np.arange(len(b))
    rows = np.zeros(0, np.int64)
    for level, (x, y) in enumerate(zip(a_stats, b_stats, strict=True)):
        if level and len(rows) * 8 < len(a) * len(columns):  # few are left: one by one
            bound = np.empty(len(rows))
            for k in range(0, len(rows), 1 << 16):
                at = slice(k, k + (1 << 16))
                bound[at] = np.einsum("ij,ij->i", x[rows[at]], y[found[at]])
            ok = bound + slack[rows] >= least[rows]
            rows, found = rows[ok], found[ok]
        else:
            ok = x @ y[columns].T + slack[:, None] >= least[:, None]
            if level:
                known = np.zeros((len(a), len(b)), bool)
                known[rows, found] = True
                ok &= known[:, columns]
            rows, at = np.nonzero(ok)
            found = columns[at]
        left.append(len(rows))
        columns = np.unique(found)
    return rows, found, left


def _best(query: np.ndarray, score: np.ndarray, ident: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's ``most`` best: highest score, then smallest id."""
    order = np.lexsort((ident, -score, query))
    query = query[order]
    begins = np.flatnonzero(np.diff(query, prepend=-1))
    rank = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
    return order[rank < most]


def _of_block(a: np.ndarray, b: np.ndarray, least: np.ndarray, ids: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of a, id and score of the best that a block of candidates b offers to queries a. ids: those of all candidates in a row, sizes: how many each has."""
    begins = np.cumsum(sizes) - sizes
    levels = [s for s in LEVELS if s < a.shape[1]] or [1]
    a_stats, b_stats = [statistics(a, s) for s in levels], [statistics(b, s) for s in levels]
    length, most_b = np.sqrt((a.astype(np.float64) ** 2).sum(1)), np.sqrt((b.astype(np.float64) ** 2).sum(1)).max(initial=0)
    exact = bool(length.max(initial=0) * most_b < 2.0**52)
    found = []
    for k in range(0, len(a), TILE):
        at = slice(k, k + TILE)
        q, end = a[at], least[at].copy()
        slack = SLACK * length[at] * most_b + 1e-6
        open_rows = np.flatnonzero(np.isneginf(end))
        if len(open_rows) and len(b) >= most:  # the best bounds give a first k-th score
            bound = a_stats[-1][at][open_rows] @ b_stats[-1].T
            top = np.argpartition(bound, len(b) - most, axis=1)[:, len(b) - most :]
            end[open_rows] = [_scores(q[r : r + 1], b[c], exact)[0].min() for r, c in zip(open_rows.tolist(), top, strict=True)]
        rows, cols, _ = survivors(q, b, end, [s[at] for s in a_stats], b_stats, slack)
        if len(rows) * 4 > len(q) * len(b):
            score = _scores(q, b, exact)[rows, cols]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[rows[i : i + (1 << 16)]], b[cols[i : i + (1 << 16)]]) for i in range(0, len(rows), 1 << 16)] or [np.zeros(0, np.int64)])
        ok = score >= end[rows]
        rows, cols, score = rows[ok], cols[ok], score[ok]
        best = _best(rows, score, ids[begins[cols]], most)  # classes, by their smallest ids
        rows, cols, score = rows[best], cols[best], score[best]
        n = sizes[cols]
        place = np.repeat(begins[cols], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows, score, ident = np.repeat(rows, n), np.repeat(score, n), ids[place]
        best = _best(rows, score, ident, most)
        found.append((rows[best] + k, ident[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _searched(pairs: DataFrame, asking: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """key, id, score: what pairs of blocks (qb, b) offer to each query (qb, key, q, least), its ``most`` best at most."""
    no = F.lit(None)
    ours = pairs.join(asking, "qb").select("qb", "b", F.lit(0).alias("side"), "q", "key", "least", no.cast("array<long>").alias("ids"))
    theirs = pairs.join(candidates, "b").select("qb", "b", F.lit(1).alias("side"), "q", no.cast("string").alias("key"), no.cast("long").alias("least"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["qb", "b"], 1 << 12):
            for s, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                part = t.slice(s, e - s).combine_chunks()
                cut = int(np.searchsorted(np.asarray(part.column("side")), 1))
                one, other = part.slice(0, cut), part.slice(cut)
                if not len(one) or not len(other):
                    continue
                least = one.column("least").combine_chunks().cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                keys = one.column("key").combine_chunks()
                ids, sizes = _integers(other.column("ids").combine_chunks())
                firsts = np.cumsum(sizes) - sizes
                against = {q.shape[1]: (at, q) for at, q in _by_dims(other.column("q").combine_chunks())}
                for at, q in _by_dims(one.column("q").combine_chunks()):
                    if q.shape[1] not in against:
                        continue
                    has, b = against[q.shape[1]]
                    n = sizes[has]
                    own = ids[np.repeat(firsts[has], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    rows, ident, score = _of_block(q, b, least[at], own, n, most)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at[rows])), pa.array(ident), pa.array(score)], ["key", "id", "score"])

    rows = ours.union(theirs).repartition("qb", "b").sortWithinPartitions("qb", "b", "side")
    return map_arrow(rows, run, "key string, id long, score long")


def _cut(rows: DataFrame, most: int) -> DataFrame:
    best = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return rows.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).drop("r")


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", asks: Column | None = None, k: int = TOP, steps: int = STEPS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query (a row for which ``asks`` holds) with all other rows."""
    most = k + 1  # one of them may be the query itself
    asks = F.col(f"`{id_col}`").cast("long") % EVERY == 0 if asks is None else asks
    with scratch():
        whole = whole_components(F.col(f"`{vec_col}`"), None, steps, LONGEST)
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("q"), F.coalesce(asks, F.lit(False)).alias("asks")).filter("id is not null and q is not null")
        rows = stored(rows.withColumn("key", F.md5(F.array_join("q", ","))), "vectors", keep=True)
        queries = rows.filter("asks").select("id", "key").distinct()
        # a window with a limit on its rank passes on that many rows of a class from each task
        first = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("r") <= most)
        first = first.groupBy("key").agg(F.first("q").alias("q"), F.sort_array(F.collect_set("id")).alias("ids"))
        asked = queries.select("key").distinct().withColumn("asks", F.lit(True))
        classes = first.join(asked, "key", "left").select("key", "q", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
        located = stored(_located(classes), "located")
        order = [F.size("q"), F.col("code"), F.col("key")]
        candidates = running_before(located, order, F.lit(1), "place").withColumn("b", F.floor(F.col("place") / BLOCK))
        candidates = stored(candidates.select("b", "key", "q", "ids", "f"), "candidates")
        asking = running_before(located.filter("asks").select("key", "q", "code", "f"), order, F.lit(1), "place").withColumn("qb", F.floor(F.col("place") / QUERY_BLOCK))
        asking = stored(asking.select("qb", "key", "q", "f"), "asking")
        pairs = stored(_pairs(asking, candidates), "pairs")
        likely = Window.partitionBy("qb").orderBy(F.desc("bound"), "b")
        begun = stored(pairs.withColumn("r", F.row_number().over(likely)).filter(F.col("r") <= FIRST), "begun")
        blank = asking.select("qb", "key", "q", F.lit(None).cast("long").alias("least"))
        found = stored(_cut(_searched(begun.select("qb", "b"), blank, candidates, most), most), "found")
        full = found.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == most)
        asking = stored(asking.join(full, "key", "left").select("qb", "key", "q", "least"), "bounded")
        ends = asking.groupBy("qb").agg(F.min("least").alias("end"), F.max(F.col("least").isNull()).alias("open"))
        rest = pairs.join(begun.select("qb", "b"), ["qb", "b"], "left_anti").join(ends, "qb").filter("open OR bound >= end").select("qb", "b")
        more = _searched(rest, asking, candidates, most)
        lists = _cut(found.union(more), most).groupBy("key").agg(F.collect_list(F.struct((-F.col("score")).alias("below"), "id")).alias("best"))
        lists = stored(lists, "lists", keep=True)  # k + 1 entries at most
    out = queries.join(lists, "key").select("id", F.slice(F.array_sort(F.filter("best", lambda e: e["id"] != F.col("id"))), 1, k).alias("best"))
    return out.select(F.col("id").alias("query_id"), F.posexplode("best").alias("p", "e")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.below")).alias("score"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_exact_top_k": op11_exact_top_k}
ORACLE = {
    "op11_exact_top_k": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({STEPS} * x)::BIGINT) AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
             s AS (SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
                   FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % {EVERY} = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}"""
}
