"""Centroid clustering on integer vectors, with geometric bounds instead of most distances.

A vector keeps a lower bound on its distance to every centroid but its own. When
centroids move, the bound falls by what the move can take away from any vector of
the cluster. Let a centroid move from ``a`` to ``b`` with middle ``m``. For a vector
``x`` the difference |x-a| - |x-b| is 2 (x-m)(b-a) / (|x-a| + |x-b|), at most
|b-a| cos(angle of x-m and b-a), since |x-a| + |x-b| >= 2 |x-m|. The members of a
cluster lie in a sphere around its centroid, so in the plane of its centre, ``a`` and
``b`` the angle is at least that of the centre less half the angle under which ``m``
sees the sphere: moves across or away from the sphere take little or nothing, where
the plain bound would take the whole drift. A vector whose distance to its own
centroid is below the bound stays; all others are compared with every centroid.

Vectors and centroids are integers and distances are exact. Each round is one scan
that writes the state of all vectors, and one aggregate of a row per cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import snapshot

#: Largest component: with it squared distances of up to 128 components fit into a long.
LARGEST = 2**26
#: Up to this component size, distances are exact in doubles.
EXACT_IN_DOUBLE = 2**19
#: Share by which floating-point bounds are widened.
SLACK = 1e-9
#: Rows that a task compares with all centroids at once.
ROWS = 4_096


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(``vec_id``, ``q``): floor(scale * x) of the vectors that have ``dims`` finite components within ``LARGEST``."""
    vector = F.col(vector_col).cast("array<double>")
    scaled = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).filter(F.size("v") == dims)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST / scale))
    return scaled.filter(sound).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"))


def max_drift(center: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much nearer each move from ``old`` to ``new`` can be to any point of a sphere, at most."""
    move, offset = new - old, center - (old + new) / 2
    length, away = np.sqrt((move * move).sum(axis=1)), np.sqrt((offset * offset).sum(axis=1))
    outside = (away > radius) & (length > 0)
    product = np.where(outside, away * length, 1)
    angle = np.arccos(np.clip((offset * move).sum(axis=1) / product, -1, 1)) - np.arcsin(np.where(outside, radius / np.maximum(away, 1e-300), 0))
    return np.where(outside, length * np.maximum(0, np.cos(np.maximum(angle, 0))), length)


def bound_losses(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """By cluster, what its members' lower bounds lose when all centroids move; slightly too much, never too little."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    found = np.zeros(len(old))
    for i in range(len(old)):
        found[i] = np.delete(max_drift(old[i], radii[i], old, new), i).max(initial=0.0)
    drift = np.sqrt(((new - old) ** 2).sum(axis=1)).max(initial=0.0)
    return found + SLACK * (1 + drift)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to integer centroids."""
    largest = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if largest <= EXACT_IN_DOUBLE else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def assign(vectors: np.ndarray, own: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters, squared distances, lower bounds to all other centroids, and which vectors were ambiguous.

    ``own`` is the cluster of each vector so far, or -1; ``lower`` its bound for the present centroids.
    """
    own, lower = own.copy(), lower.copy()
    gap = vectors.astype(np.int64) - centroids[own]
    distance = (gap * gap).sum(axis=1)
    scanned = (own < 0) | (np.sqrt(distance) * (1 + SLACK) >= lower)
    ambiguous = np.flatnonzero(scanned)
    for at in range(0, len(ambiguous), ROWS):
        rows = ambiguous[at : at + ROWS]
        squared = squared_distances(vectors[rows], centroids)
        own[rows] = squared.argmin(axis=1)  # the first of equal ones
        distance[rows] = squared.min(axis=1)
        squared[np.arange(len(rows)), own[rows]] = np.iinfo(np.int64).max
        lower[rows] = np.sqrt(squared.min(axis=1)) * (1 - SLACK) if len(centroids) > 1 else np.inf
    return own, distance, lower, scanned


STATE = "vec_id long, q array<int>, cluster int, lower double, distance long, scanned boolean"


def _round(state: DataFrame, centroids: np.ndarray, losses: np.ndarray) -> DataFrame:
    """The state of all vectors for new centroids."""
    shared = state.sparkSession.sparkContext.broadcast((centroids, losses))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, lost = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            own = batch.column(2).to_numpy()
            bound = batch.column(3).to_numpy() - lost[own]
            cluster, distance, lower, scanned = assign(vectors, own, bound, centers)
            columns = [*batch.columns[:2], pa.array(cluster, pa.int32()), pa.array(lower), pa.array(distance), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "q", "cluster", "lower", "distance", "scanned"])

    return state.select("vec_id", "q", "cluster", "lower").mapInArrow(tasks, STATE)


def _totals(state: DataFrame, dims: int) -> dict[int, tuple]:
    """(rows, sums of the components, largest and summed squared distance) by cluster: one row each."""
    sums = [F.sum(F.get("q", F.lit(k)).cast("long")) for k in range(dims)]
    spread = F.max("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))
    found = state.groupBy("cluster").agg(F.count("*"), F.array(*sums), *spread).collect()
    return {r[0]: (r[1], r[2], r[3], int(r[4])) for r in found}


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:id``, in that order; equal ids by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = vectors.select(key.alias("key"), "q").orderBy("key", "q").limit(clusters).collect()
    return np.array([r.q for r in chosen], np.int64)


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, clusters: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1
) -> DataFrame:
    """One row per kept vector: ``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``, ``scanned``.

    Kept are vectors of ``dims`` components, none of them null or non-finite; each
    component becomes floor(scale * x). (Scaled components beyond 2^26 in size, whose
    squared distances do not fit into a long, count as non-finite.) Centroids start
    as ``first_centroids``; each round assigns every vector to the nearest one
    (squared Euclidean distance, the smaller number of equal ones) and moves every
    centroid that has members to the componentwise floor of their mean; one without
    stays. Then vectors are assigned once more. Inertia is the sum of distances over
    the cluster and over all. ``scanned`` tells whether the last assignment compared
    the vector with all centroids.

    Repeated rows are vectors of their own; a null id is kept and hashes as the empty
    text. With fewer vectors than ``clusters`` there are as many centroids as
    vectors. Other columns are not read. No kept vectors give an empty result.
    Tasks exchange one row of sums per cluster, so a large cluster is no large task.
    """
    if not 1 <= dims <= 128 or clusters < 1 or rounds < 0:
        raise ValueError("dims from 1 to 128, at least one cluster, no negative rounds")
    state = snapshot(integer_vectors(vectors, id_col, vector_col, dims, scale))
    centroids = first_centroids(state, clusters, seed)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)
    state = state.select("vec_id", "q", F.lit(-1).alias("cluster"), F.lit(0.0).alias("lower"))
    losses = np.zeros(len(centroids))
    totals: dict[int, tuple] = {}
    for number in range(rounds + 1):
        state = snapshot(_round(state, centroids, losses))
        totals = _totals(state, dims)
        if number < rounds:
            moved = np.array([[s // totals[k][0] for s in totals[k][1]] if k in totals else centroids[k] for k in range(len(centroids))], np.int64)
            radii = np.array([np.sqrt(totals[k][2]) * (1 + SLACK) if k in totals else 0.0 for k in range(len(centroids))])
            losses, centroids = bound_losses(centroids, moved, radii), moved
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = sum(t[3] for t in totals.values())

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))

    return state.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([totals[k][3] if k in totals else 0 for k in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(inertia).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
        "scanned",
    )
