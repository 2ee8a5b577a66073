"""Centroid clustering against plain rounds in Python integers, and the bounds against what they bound."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import clustering

SCHEMA = "vec_id bigint, embedding array<float>"


def blobs(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 2, (5, dim))
    return [(i, [float(np.float32(v)) for v in centres[i % 5] + rng.normal(0, spread, dim)]) for i in range(n)]


def plain_rounds(rows, k, rounds, dim, scale=1024, seed=3):
    kept = [(i, [int(np.floor(scale * np.float64(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(),
                             np.array(r[1], "<i4").tobytes()))
    centroids = [list(v) for _, v in kept[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return min(range(len(d)), key=lambda c: (d[c], c)), min(d)
    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [nearest(v) for _, v in kept]
    inertia = [sum(d for o, d in last if o == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, o, d, inertia[o], sum(inertia), digest[o]) for (i, _), (o, d) in zip(kept, last)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n, dim, k, rounds", [(300, 4, 6, 10), (120, 64, 8, 10), (40, 3, 1, 3), (3, 4, 8, 10), (50, 4, 5, 0)])
def test_equals_plain_rounds(spark, n, dim, k, rounds):
    rows = blobs(n, dim, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert result(clustering.clustered_vectors(df, k=k, rounds=rounds, dim=dim)) == plain_rounds(rows, k, rounds, dim)


def test_awkward_vectors(spark):
    rows = blobs(30, 4, 1)
    rows += [(31, None), (32, [1.0, 2.0, 3.0]), (33, [1.0, None, 2.0, 3.0]), (34, [1.0, float("nan"), 2.0, 3.0]),
             (35, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (None, [-0.5, 0.5, 0.5, 0.5]),
             (36, []), (37, [0.0] * 4), (37, [0.0] * 4), (38, [-1e-6, -0.0, 1e-6, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("cluster", "point", "upper", "delta", "distance"):
        df = df.withColumn(name, F.lit(name))
    assert result(clustering.clustered_vectors(df, dim=4)) == plain_rounds(rows, 8, 10, 4)
    none = clustering.clustered_vectors(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                     "centroid_sha256"]


def test_large_components_stay_exact(spark):
    rows = [(i, [float((i * 7919) % 131000), float(-(i * 104729) % 130000), 0.25, -131000.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert result(clustering.clustered_vectors(df, dim=4, k=4)) == plain_rounds(rows, 4, 10, 4)
    beyond = spark.createDataFrame([(1, [1e300, 0.0, 0.0, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        clustering.clustered_vectors(beyond, dim=4)


def test_a_table_of_equal_vectors(spark):
    rows = [(i, [0.1, 0.2, 0.3, 0.4]) for i in range(40)]
    got = result(clustering.clustered_vectors(spark.createDataFrame(rows, SCHEMA), dim=4))
    assert got == plain_rounds(rows, 8, 10, 4) and {r[1] for r in got} == {0}


@pytest.mark.parametrize("seed", range(6))
def test_loosening_bounds_every_vector_of_the_sphere(seed):
    rng = np.random.default_rng(seed)
    old = rng.normal(0, 1000, (6, 5)).round()
    new = old + rng.normal(0, 200, old.shape).round() * rng.integers(0, 2, (6, 1))
    radius = rng.uniform(0, 900, 6)
    fall = clustering.loosening(old, new, radius)
    drift = np.sqrt(((new - old) ** 2).sum(axis=1))
    for a in range(6):
        x = rng.normal(size=(4000, 5))
        x = old[a] + x / np.linalg.norm(x, axis=1)[:, None] * radius[a] * rng.uniform(0, 1, (4000, 1)) ** 0.2
        for j in range(6):
            if j != a:
                fell = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert fell.max() <= fall[a] + 1e-6
        assert fall[a] <= np.delete(drift, a).max() * (1 + 1e-6)
    assert (fall < np.array([np.delete(drift, a).max() for a in range(6)]) - 1).any()


def test_bounds_spare_most_scans_and_less_loosening_spares_more(spark, monkeypatch):
    rows = blobs(2000, 8, 9, spread=1.2)
    points = clustering.integer_vectors(spark.createDataFrame(rows, SCHEMA), dim=8)
    tight = clustering.Clustering(points, 8, 10, 8, 3)

    def full_drift(old, new, radius):
        drift = np.sqrt(((new - old).astype(float) ** 2).sum(axis=1))
        return np.array([np.delete(drift, a).max() for a in range(len(old))])
    monkeypatch.setattr(clustering, "loosening", full_drift)
    loose = clustering.Clustering(points, 8, 10, 8, 3)
    assert (tight.centroids == loose.centroids).all()
    assert tight.scanned[0] == 2000 and sum(tight.scanned[1:]) < 0.5 * 2000 * (len(tight.scanned) - 1)
    assert sum(tight.scanned) < sum(loose.scanned)
