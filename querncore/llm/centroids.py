"""Centroid clustering by sort-means: exact assignments that look at few of the centroids.

At the start of a round the distances between the centroids are known, and each centroid has the others in order of their distance from it. A vector
begins at the centroid of its last assignment, a, at distance d(x, a), and looks at the others in a's order. By the triangle inequality

    d(a, c) > 2 d(x, a)   implies   d(x, c) >= d(a, c) - d(x, a) > d(x, a)

so the first centroid strictly beyond twice the current distance, and all behind it, are neither nearer nor as near. Components are integers, so
squared distances are exact: the stop is D(a, c) > 4 D(x, a), and equal distances are seen as equal and go to the smaller number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querncore.llm.common import removed, small_batches, written

#: Components from here on in absolute value are not kept: four times 64 squares of differences up to 2**27 just fit a long.
LARGEST = 1 << 26


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of x and y, or between the rows of x and the one y."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def sorted_means(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others, nearest first, and their squared distances: two arrays of k rows of k - 1."""
    apart = np.array([squared(centroids, c) for c in centroids])
    np.fill_diagonal(apart, -1)
    order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, axis=1)


def assign(x: np.ndarray, last: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, its squared distance, how many distances were made) of each row of x; last: where each row was before."""
    cluster, distance, made = last.astype(np.int64), np.zeros(len(x), np.int64), len(x)
    for a in np.unique(last):
        rows = np.flatnonzero(last == a)
        own = squared(x[rows], centroids[a])
        far = np.argsort(-own, kind="stable")  # rows with the largest distance look furthest: those still looking are the first ones
        rows, own = rows[far], own[far]
        held, best, which = x[rows], own.copy(), np.full(len(rows), a, np.int64)
        for c, d in zip(order[a].tolist(), apart[a].tolist()):
            looking = int(np.searchsorted(-4 * own, -d, side="right"))  # 4 own >= d
            if not looking:
                break
            new = squared(held[:looking], centroids[c])
            made += looking
            better = (new < best[:looking]) | ((new == best[:looking]) & (c < which[:looking]))
            best[:looking][better], which[:looking][better] = new[better], c
        cluster[rows], distance[rows] = which, best
    return cluster, distance, made


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id long, v array<long>: floor(scale * x) of the vectors that take part."""
    x = F.col("e")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) >= float(LARGEST))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("e")).filter(F.size(x) == dims).filter(~F.exists(x, lambda c: F.coalesce(bad(c), F.lit(True))))
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id long, cluster int, distance long (squared), cluster_inertia long, inertia long (distance summed over the cluster and over all),
    centroid_sha256 string (of the final centroid's components, joined by commas): a row for each vector kept.

    Vectors of exactly ``dims`` components, none null or non-finite, are kept, as floor(scale * x); the first centroids are the k with the smallest
    sha256 of ``seed:id``. A round assigns every vector and moves each centroid that has any to the floor of their mean; then all are assigned once more.

    Each round is one pass over a table in the shared folder: assignments are made where vectors are read, sums are combined there and only k rows of
    sums reach the driver. Nothing is grouped by cluster, so a cluster that holds most rows is spread like the others.
    Null vectors and vectors with a component of absolute value 2**26 / scale and more, whose distances no long can hold, are not kept. Null ids take
    part but begin no cluster. Rows that repeat an id are vectors of their own; among equal hashes the smaller components begin. With fewer than k vectors
    there are as many clusters; an empty table gives no rows. Sums beyond a long are null. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    table = written(kept_vectors(vectors, dims, scale, id_col, vector_col).withColumn("cluster", F.lit(0)), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.filter("vec_id IS NOT NULL").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        removed(table)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for n in range(rounds + 1):
        last = n == rounds
        before, table = table, written(assigned(table, centroids, keep_vectors=not last), f"round{n}")
        removed(before)
        if not last:
            sums = table.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)))
            for r in sums.collect():
                centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]  # // goes down, for negative sums too
    inertia = {r.cluster: r.d for r in table.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}
    total = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(c, d, total, hashes[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each of k clusters


def assigned(table: DataFrame, centroids: np.ndarray, keep_vectors: bool) -> DataFrame:
    """The table with each row's nearest centroid: with the vectors for another round, or with the distances."""
    order, apart = sorted_means(centroids)
    dims = centroids.shape[1]

    def run(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy().reshape(-1, dims)
            which, distance, _ = assign(x, b.column("cluster").to_numpy(), centroids, order, apart)
            tail = b.column("v") if keep_vectors else pa.array(distance, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(which, pa.int32()), tail], names=["vec_id", "cluster", "tail"])

    out = table.select("vec_id", "cluster", "v").mapInArrow(run, f"vec_id long, cluster int, tail {'array<long>' if keep_vectors else 'long'}")
    return out.withColumnRenamed("tail", "v" if keep_vectors else "distance")
