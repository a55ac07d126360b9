"""Centroid clustering against plain integers, ties and rounding included."""

import hashlib
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from kmerloom.llm import centroids, queries


def brute(points, at):
    distance = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, c, strict=True)) for c in at] for p in points]
    return [d.index(min(d)) for d in distance], [min(d) for d in distance]


@pytest.mark.parametrize("scale", [1, 3, 1 << 10, 1 << 25, (1 << 27) - 2])
def test_nearest_is_exact(scale):
    r = np.random.default_rng(scale)
    at = r.integers(-scale, scale + 1, (9, 64))
    at[4], at[7] = at[1], at[1] + (np.arange(64) == 3)
    points = np.concatenate((r.integers(-scale, scale + 1, (300, 64)), at, at[1:2] * np.ones((5, 1), int), (at[0:1] + at[2:3]) // 2, np.zeros((1, 64), int)))
    own, exact = centroids.nearest(points, at)
    expected, distance = brute(points, at)
    assert own.tolist() == expected and exact >= 7
    assert centroids.squared(points, at[own]).tolist() == distance


def test_few_points_need_exact_distances():
    r = np.random.default_rng(5)
    assert centroids.nearest(r.integers(-600, 600, (20_000, 64)), r.integers(-600, 600, (8, 64)))[1] < 20


def lloyd(rows, k, rounds, d, scale, salt):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in (named + sorted(("~", v) for i, v in kept if i is None))[:k]]
    for _ in range(rounds):
        own, _ = brute([v for _, v in kept], at)
        for j in range(len(at)):
            if members := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                at[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own, distance = brute([v for _, v in kept], at) if kept else ([], [])
    return sorted(((i is not None, i), o, x) for (i, _), o, x in zip(kept, own, distance, strict=True)), at


def vectors(n, d=4):
    r = random.Random(n)
    rows = [(i, [r.choice((-1.0, -0.25, 0.0, 0.5, r.uniform(-1, 1))) for _ in range(d)]) for i in range(n)]
    return rows + [(1, rows[1][1]), (1, rows[2][1]), (None, [0.5] * d), (900, None), (901, []), (902, [1.0] * (d - 1)), (903, [1.0] * (d + 1))] + [(904, [math.nan] + [0.0] * (d - 1)), (905, [math.inf] * d), (906, [None] * d)] + [(2000 + i, [0.125] * d) for i in range(n)]


@pytest.mark.parametrize("n, k, rounds", [(120, 5, 6), (3, 8, 3), (40, 1, 2), (60, 7, 0)])
def test_clusters_equal_brute_force(spark, n, k, rounds):
    rows = vectors(n)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, point string").repartition(6)
    found, centers = centroids.cluster(df, k=k, rounds=rounds, components=4, scale=64, salt="s")
    expected, at = lloyd(rows, k, rounds, 4, 64, "s")
    assert sorted(((r.vec_id is not None, r.vec_id), r.cluster, r.distance) for r in found.collect()) == expected
    told = centers.orderBy("cluster").collect()
    assert [r.centroid for r in told] == at
    assert [r.cluster_inertia for r in told] == [sum(x for _, o, x in expected if o == j) for j in range(len(at))]
    assert {r.inertia for r in told} == {sum(x for _, _, x in expected)}


def test_no_vectors_and_large_components(spark):
    kind = "vec_id long, embedding array<float>"
    found, centers = centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], kind))
    assert found.collect() == [] and centers.collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], kind))


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted(tuple(r) for r in queries.op13_clusters(spark, data).select(*columns).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.op13_sql()})").fetchall())
