"""Centroid clustering by plain Lloyd rounds, in whole numbers throughout.

Components become integers first. Each round sends the centroids about, finds every vector's nearest one in mapInPandas (integer
squared differences, one centroid at a time; argmin takes the lowest number of equals) and adds up, per task, each cluster's
count and component sums; a groupBy merges the tasks' sums. The driver holds the centroids alone: clusters x components.
Integers make the result the same for any split of the rows into tasks.

Defined results: a vector takes part if it has exactly ``dims`` components, none null or non-finite, and if its squared
length in integers stays below 2^60, so that every squared distance fits a long; others give no row. Rows repeated with an id
are vectors of their own. Of equal hashes, which only equal ids have, the smaller vector comes first; rows without an id come
last. Fewer vectors than clusters make a cluster each; an empty table gives no rows. An inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import scratch, stored, table

#: The contract's numbers: clusters, rounds, components of a vector, integer steps to a unit, and what ids are hashed with.
CLUSTERS, ROUNDS, DIMS, STEPS, SALT = 40, 5, 64, 256, "2:"
#: A squared length below this keeps every squared distance in a long.
LONGEST = 1 << 60


def whole_components(vec: Column, dims: int | None, steps: int, below: int) -> Column:
    """floor(steps * x) of each component as array<int>; null unless all are finite, there are ``dims`` (if given) and the squared length is below ``below``."""
    x = F.transform(vec.cast("array<double>"), lambda c: F.floor(c * F.lit(float(steps)).cast("double")).cast("double"))
    # floor makes a long of a double: infinity is the largest one, so its square is never below a bound
    squares = F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c)
    ok = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c)) & (squares < F.lit(float(below)))
    if dims is not None:
        ok &= F.size(vec) == dims
    return F.when(ok, x.cast("array<int>"))


def assigned(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each integer vector (the lowest number of equals) and its squared distance."""
    distance = np.empty((len(centroids), len(q)), np.int64)
    for c, centroid in enumerate(centroids):
        apart = q - centroid
        distance[c] = np.einsum("ij,ij->i", apart, apart)
    nearest = distance.argmin(0)
    return nearest, distance[nearest, np.arange(len(q))]


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    return np.concatenate(rows.to_numpy()).astype(np.int64).reshape(-1, dims) if len(rows) else np.zeros((0, dims), np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of every cluster that has vectors."""
    k, dims = centroids.shape
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for frame in frames:
            q = _matrix(frame["q"], dims)
            nearest, _ = assigned(q, sent.value)
            order = np.argsort(nearest, kind="stable")
            found, begins = np.unique(nearest[order], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(q[order], begins, axis=0)
            count += np.bincount(nearest, minlength=k)
        used = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": used.astype(np.int32), "n": count[used], **{f"s{i}": total[used, i] for i in range(dims)}})

    names = [f"s{i}" for i in range(dims)]
    parts = vectors.select("q").mapInPandas(run, ", ".join(["cluster int", "n long", *(f"{s} long" for s in names)]))
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names)).collect()  # a row per cluster
    sent.unpersist()
    return {r["cluster"]: (r["n"], [r[s] for s in names]) for r in rows}


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Every centroid with vectors at their componentwise floor(sum / count); the others where they were."""
    out = centroids.copy()
    for cluster, (n, total) in sums.items():
        out[cluster] = [s // n for s in total]
    return out


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, steps: int = STEPS, salt: str = SALT
) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance) of all vectors that take part, and the final centroids in integers."""
    spark = df.sparkSession
    ship(spark)
    with scratch():
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole_components(F.col(f"`{vec_col}`"), dims, steps, LONGEST).alias("q"))
        vectors = stored(rows.filter("q is not null"), "vectors", keep=True)
        by_hash = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last()
        first = vectors.orderBy(by_hash, "q").limit(clusters).collect()  # as many rows as clusters
        centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, dims)
        for _ in range(rounds if len(centroids) else 0):
            centroids = moved(centroids, _sums(vectors, centroids))
    sent = spark.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                nearest, distance = assigned(_matrix(frame["q"], dims), sent.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": nearest.astype(np.int32), "distance": distance})

    return vectors.mapInPandas(run, "vec_id long, cluster int, distance long"), centroids


def cluster_table(df: DataFrame, **parameters: object) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the final centroid's digest of every vector that takes part."""
    spark = df.sparkSession
    with scratch():
        rows, centroids = clustered(df, **parameters)
        rows = stored(rows, "clustered", keep=True)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    total = sums.agg(F.sum("d").alias("all"))
    digests = spark.createDataFrame([(i, _digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    known = sums.join(F.broadcast(digests), "cluster").join(F.broadcast(total))  # a row per cluster, beside the one row of their sum
    known = known.select("cluster", F.expr("try_cast(d AS long)").alias("cluster_inertia"), F.expr("try_cast(`all` AS long)").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_table(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds written out: each vector's nearest centroid, then exact floors of means."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(x * {STEPS})::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = {DIMS} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), q) - 1)::INTEGER AS cluster, q AS c FROM kept
            ORDER BY sha256('{SALT}' || vec_id), q LIMIT {CLUSTERS})""",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min((d, cluster)) AS best FROM (SELECT vec_id, q, cluster,
                list_sum(list_transform(range(1, {DIMS} + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT AS d FROM kept, c{r}) GROUP BY vec_id)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""m{r} AS MATERIALIZED (SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM (
                    SELECT best[2] AS cluster, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {DIMS} + 1) AS t(i) GROUP BY ALL) GROUP BY cluster)"""
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))")
    last = f"a{ROUNDS}"
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
               (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM {last} JOIN c{ROUNDS} ON cluster = best[2]"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLE = {"op13_centroid_clustering": _oracle()}
