"""Near vectors against comparing all pairs in double precision."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import groups_of

from tidemark.llm import embedding_dedup


def made(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(25):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 9)):
            rows.append((centre + rng.normal(size=16) * rng.choice([0, 0.02, 0.05])).astype(np.float32).tolist())
    rows += [[0.0] * 16, None, [], [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [2.0] * 16, [1.0] * 16, [1.0] * 15]
    labels = [random.Random(seed + k).choice([0, 0, 1]) for k in range(len(rows) - 3)] + [2, 2, 2]
    order = rng.permutation(len(rows))
    return [(int(k), rows[i], labels[i], "x", 5) for k, i in enumerate(order)] + [(900, [3.0] * 16, None, "x", 5), (None, [2.0] * 16, 2, "x", 5), (901, None, None, None, None)]


@pytest.mark.parametrize("block", [512, 3])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block)
    rows = made(block)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string, id int")
    found = embedding_dedup.near_vectors(frame, group=F.col("label")).collect()
    sound = [(k, np.asarray(v, np.float64), lab) for k, v, lab, *_ in rows if k is not None and v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [
        (a, b) for i, (a, x, p) in enumerate(sound) for b, y, q in sound[:i]
        if p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98
    ]
    group = groups_of(pairs, [r[0] for r in rows if r[0] is not None])
    links = {k: sum(k in p for p in pairs) for k in group}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {k: (links[k], g, g == k) for k, g in group.items()} | {None: (0, None, True)}
    assert len(found) == len(rows) and len(pairs) > 30


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (5, [0.0, 1.0], 0)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), group=F.col("label")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False), (5, 0, 5, True)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(empty, group=F.col("label")).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_one_id_may_name_different_vectors(spark, kind):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [-0.0, 2.0], 0), (4, [0.0, 2.0], 0)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int"), group=F.col("label")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_signs_drop_no_pair_at_the_threshold():
    """Pairs right at the threshold stay within the bound on differing signs; random pairs mostly do not."""
    rng = np.random.default_rng(3)
    bits, tables = embedding_dedup.plan_tables(100_000, 0.98)
    planes = rng.standard_normal((64, bits * tables))
    a, noise = rng.standard_normal((2, 3_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    limit = embedding_dedup.most_differing(bits * tables, 0.98)
    differing = lambda x, y: ((x @ planes > 0) != (y @ planes > 0)).sum(axis=1)
    assert (differing(a, b) <= limit).all() and (differing(a, rng.permutation(a)) <= limit).mean() < 0.01


def test_planned_recall():
    for n in (2, 1000, 10**9):
        bits, tables = embedding_dedup.plan_tables(n, 0.98)
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - agree) ** tables <= 1e-4 and n / 2**bits <= 8
