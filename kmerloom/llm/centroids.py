"""Clustering by centroids, exact in integers and fast in single precision.

A matrix product in single precision gives all distances of a block, each with an interval that its rounding errors provably stay in. Where one
centroid's interval lies under all others it is the nearest; where intervals overlap, these centroids alone are compared by exact integer
distances, ties going to the smaller number. Sums are exact, so the result depends neither on the order of rows nor on partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, written

#: Components are smaller than this in size, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: Half a unit in the last place of single precision, relative.
UNIT = 2.0**-24
#: Products of a block.
BLOCK = 1 << 21


def integer_points(rows: DataFrame, vec_id: str, embedding: str, components: int, scale: int) -> DataFrame:
    """(vec_id, point): vectors of exactly ``components`` finite numbers, each as floor(scale * x). Larger ones than ``LARGEST`` raise."""
    whole = F.coalesce(F.size(embedding) == components, F.lit(False))
    finite = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = rows.where(F.when(whole, finite).otherwise(False))
    point = F.transform(embedding, lambda x: F.floor(x.cast("double") * float(scale)))
    large = F.exists(point, lambda x: F.abs(x) >= LARGEST)
    held = F.when(large, F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")).otherwise(point.cast("array<int>"))
    return kept.select(F.col(vec_id).alias("vec_id"), held.alias("point"))


def seeds(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` points with the smallest sha256 of salt and vec_id, in that order; of equal ids the smaller point comes first, null ids come last."""
    named = points.withColumn("name", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256))
    rows = named.orderBy(F.col("name").asc_nulls_last(), "point").limit(k).select("point").collect()
    return np.array([r["point"] for r in rows], np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each point (ties: the smaller number), and how many points had to be compared exactly.

    Compared are half the squared distances without the point's own square, c.c / 2 - p.c. In single precision a product of d components, summed in
    any order, is off by (d + 2) u / (1 - (d + 2) u) times the sum of the sizes of its terms at most (both factors rounded once), and
    that sum is at most the product of the norms; what doubles round is covered by a factor and a relative 2**-50.
    """
    d = points.shape[1]
    out, exact = np.zeros(len(points), np.int32), 0
    single = centroids.astype(np.float32).T
    half = (centroids.astype(np.float64) ** 2).sum(axis=1) / 2
    norm = np.sqrt(2 * half)
    gamma = (d + 2) * UNIT / (1 - (d + 2) * UNIT) * (1 + 2.0**-20)
    for at in range(0, len(points), step := max(1, BLOCK // max(1, len(centroids)))):
        part = points[at : at + step]
        product = (part.astype(np.float32) @ single).astype(np.float64)
        size = np.sqrt((part.astype(np.float64) ** 2).sum(axis=1))
        score = half - product
        radius = gamma * size[:, None] * norm + 2.0**-50 * (half + np.abs(product))
        most = (score + radius).min(axis=1)
        close = score - radius <= most[:, None]
        out[at : at + step] = np.argmax(close, axis=1)
        open_ = np.flatnonzero(close.sum(axis=1) > 1)
        exact += len(open_)
        if len(open_):
            row, number = np.nonzero(close[open_])
            distance = squared(part[open_[row]], centroids[number])
            order = np.lexsort((number, distance, row))
            first = np.concatenate(([True], row[order][1:] != row[order][:-1]))
            out[at + open_] = number[order][first]
    return out, exact


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two arrays, in bounded pieces."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), step := max(1, BLOCK // max(1, a.shape[1]))):
        difference = a[at : at + step] - b[at : at + step]
        out[at : at + step] = np.einsum("ij,ij->i", difference, difference)
    return out


def matrix(column: pa.Array, components: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the exact mean of its points; one without points stays. A task sends one sum for each centroid and component."""
    k, d = centroids.shape

    def tasks(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            block = matrix(batch.column("point"), d)
            own, _ = nearest(block, centroids)
            order = np.argsort(own, kind="stable")
            n = np.bincount(own, minlength=k)
            at = np.flatnonzero(n)
            sums[at] += np.add.reduceat(block[order], (np.cumsum(n) - n)[at]) if len(at) else 0
            count += n
        at = np.flatnonzero(count)
        values = np.column_stack((count[at], sums[at])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, d + 1)), pa.array(np.tile(np.arange(-1, d), len(at))), pa.array(values)], names=["cluster", "place", "total"])

    totals = points.select("point").mapInArrow(tasks, "cluster long, place long, total long").groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out, found = centroids.copy(), {(r["cluster"], r["place"]): int(r["total"]) for r in totals.collect()}  # k * (d + 1) rows at most
    for j in range(k):
        if n := found.get((j, -1)):
            out[j] = [found[j, i] // n for i in range(d)]
    return out


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of each point and the exact squared distance to it."""
    d = centroids.shape[1]

    def tasks(batches):
        for batch in batches:
            block = matrix(batch.column("point"), d)
            own, _ = nearest(block, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own), pa.array(squared(block, centroids[own]))], names=["vec_id", "cluster", "distance"])

    schema = T.StructType([T.StructField("vec_id", points.schema["vec_id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return points.mapInArrow(tasks, schema)


CENTROID = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.LongType())), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType())])


def cluster(
    rows: DataFrame,
    *,
    k: int = 8,
    rounds: int = 10,
    components: int = 64,
    scale: int = 1024,
    salt: str = "3:",
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids): (vec_id, cluster, distance) of every kept vector, and (cluster, centroid, cluster_inertia, inertia).

    Kept are vectors of exactly ``components`` components, none null or not finite; components become floor(scale * x). The first centroids are
    the ``k`` kept vectors with the least sha256 of salt and vec_id (fewer where there are fewer; vectors without vec_id come last). Each round assigns every
    vector to the nearest centroid, of equally near ones the smaller number, and moves each to the floor of its mean; empty ones stay. Rounds end
    early where no centroid moves, which gives the same result. Repeated rows and ids are points of their own. Without kept vectors both
    tables are empty. Only centroids, k times ``components`` numbers, pass through the driver.
    """
    points = written(integer_points(rows, vec_id, embedding, components, scale), "points")
    spark = rows.sparkSession
    at = seeds(points, k, salt)
    if not len(at):
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), spark.createDataFrame([], CENTROID)
    for _ in range(rounds):
        before, at = at, moved(points, at)
        if (before == at).all():
            break
    found = written(assigned(points, at), "clusters")
    dropped(points)
    inertia = {r["cluster"]: int(r["n"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # k rows at most
    told = [(j, [int(x) for x in c], inertia.get(j, 0), sum(inertia.values())) for j, c in enumerate(at)]
    return found, spark.createDataFrame(told, CENTROID)
