"""Clusters against plain rounds, and the bounds against points."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, q int"


def plain(rows, clusters, dims, scale, rounds):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(np.float64(np.float32(x)) * scale) for x in v]))
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centers = [q for _, q in sorted(kept, key=key)[:clusters]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(centers))

    for number in range(rounds + 1):
        found = [nearest(q) for _, q in kept]
        if number < rounds:
            for k in range(len(centers)):
                members = [q for (_, q), (_, own) in zip(kept, found, strict=True) if own == k]
                if members:
                    centers[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    by_cluster = Counter()
    for d, k in found:
        by_cluster[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, k, d, by_cluster[k], sum(by_cluster.values()), digest[k]) for (i, _), (d, k) in zip(kept, found, strict=True))


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], SCHEMA)


def result(frame):
    return Counter(tuple(r)[:6] for r in frame.collect())


@pytest.mark.parametrize("seed, clusters, rounds", [(1, 5, 3), (2, 3, 6), (3, 9, 1), (4, 4, 0), (5, 1, 2)])
def test_clusters_equal_plain_rounds(spark, seed, clusters, rounds):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (6, 4))
    rows = [(i, (centers[rng.integers(6)] + rng.normal(0, rng.choice([0, 0.05, 0.6]), 4)).tolist()) for i in range(400)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (None, [0.0] * 4), (900, [0.125] * 4), (901, [-0.01] * 4)]
    rows += [(910, None), (911, []), (912, [1.0] * 3), (913, [1.0] * 5), (914, [1.0, None, 1.0, 1.0]), (915, [1.0, math.nan, 1.0, 1.0]), (916, [math.inf] * 4)]
    found = centroids.cluster_vectors(vectors_of(spark, rows), clusters=clusters, dims=4, scale=16, rounds=rounds)
    assert result(found) == plain(rows, clusters, 4, 16, rounds)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 4), 0.0]) for i in range(40)]
    assert result(centroids.cluster_vectors(vectors_of(spark, rows), clusters=8, dims=2, scale=2)) == plain(rows, 8, 2, 2, 3)


def test_few_large_and_no_vectors(spark):
    rows = [(1, [3e5, -2e5]), (2, [3e5, 1.0]), (3, [6e5, 6e5])]
    frame = vectors_of(spark, rows)
    assert result(centroids.cluster_vectors(frame, clusters=16, dims=2, scale=64)) == plain(rows, 16, 2, 64, 3)
    # Beyond 2^26 after scaling: counts as non-finite.
    assert centroids.cluster_vectors(vectors_of(spark, [(1, [2e6, 0.0])]), dims=2, scale=64).count() == 0
    assert centroids.cluster_vectors(vectors_of(spark, []), dims=2).collect() == []


def test_exact_for_large_integers():
    v = np.array([[2**26, -(2**26)] * 64, [2**26 - 1] * 128], np.int64)
    c = np.array([[-(2**26)] * 128, [3] * 128], np.int64)
    expected = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
    assert centroids.squared_distances(v, c).tolist() == expected


def test_losses_bound_every_point_and_fall_below_the_drift():
    rng = np.random.default_rng(8)
    smaller = 0
    for _ in range(300):
        dims = int(rng.integers(1, 6))
        center, old, move = rng.normal(0, 3, (3, dims))
        new, radius = old + move * rng.choice([0.01, 1, 4]), float(rng.exponential(1.5))
        bound = centroids.max_drift(center, radius, old[None], new[None])[0]
        points = rng.normal(0, 1, (400, dims))
        points = center + radius * points / np.linalg.norm(points, axis=1, keepdims=True) * rng.random((400, 1)) ** 0.2
        taken = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        drift = np.linalg.norm(new - old)
        assert taken.max() <= bound + 1e-9 and bound <= drift + 1e-12
        smaller += bound < 0.9 * drift
    assert smaller > 60
    away = centroids.max_drift(np.zeros(2), 1.0, np.array([[5.0, 0.0]]), np.array([[9.0, 0.0]]))
    across = centroids.max_drift(np.zeros(2), 0.1, np.array([[5.0, -1.0]]), np.array([[5.0, 1.0]]))
    toward = centroids.max_drift(np.zeros(2), 1.0, np.array([[9.0, 0.0]]), np.array([[5.0, 0.0]]))
    assert away[0] == 0 and across[0] < 0.05 and toward[0] == 4


def test_most_vectors_of_clear_clusters_are_not_scanned_again(spark):
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 4, (8, 6))
    rows = [(i, (centers[i % 8] + rng.normal(0, 0.2, 6)).tolist()) for i in range(2_000)]
    found = centroids.cluster_vectors(vectors_of(spark, rows), clusters=8, dims=6, scale=64, rounds=4)
    assert found.filter("scanned").count() < 500
    assert result(found) == plain(rows, 8, 6, 64, 4)


def test_wrong_parameters(spark):
    with pytest.raises(ValueError):
        centroids.cluster_vectors(vectors_of(spark, []), dims=0)
