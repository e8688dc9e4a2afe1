"""Shards against their exact sizes, and the matrix against its exact law."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import queries, sharding
from tidemark.llm.common import with_row_key


def check_shards(rows, shards):
    sizes = Counter(r.shard for r in rows)
    assert all(0 <= r.shard < shards for r in rows)
    assert sorted(sizes.get(k, 0) for k in range(shards)) == sorted(sharding.shard_sizes(len(rows), shards).tolist())
    for k in sizes:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


@pytest.mark.parametrize("limit", [0, 10**9])
@pytest.mark.parametrize("good, bad, sample", [(7, 5, 4), (50, 3, 20), (300, 700, 90), (1, 1, 1), (40, 60, 99)])
def test_draws_follow_the_exact_law(monkeypatch, limit, good, bad, sample):
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", limit)
    rng = np.random.default_rng(3)
    n = 20_000
    seen = Counter(sharding.draw_hypergeometric(rng, good, bad, sample) for _ in range(n))
    expected = {k: n * math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample) for k in range(sample + 1)}
    likely = {k: e for k, e in expected.items() if e >= 5}
    statistic = sum((seen[k] - e) ** 2 / e for k, e in likely.items())
    assert set(seen) <= {k for k, e in expected.items() if e > 0}
    assert statistic < len(likely) + 5 * math.sqrt(2 * len(likely)) + 5


def test_very_large_draws():
    rng = np.random.default_rng(5)
    good, bad, sample = 3 * 10**11, 7 * 10**11, 4 * 10**11
    draws = np.array([sharding.draw_hypergeometric(rng, good, bad, sample) for _ in range(3_000)], float)
    mean, deviation = sample * 0.3, math.sqrt(sample * 0.3 * 0.7 * 0.6)
    assert abs(draws.mean() - mean) < 4 * deviation / math.sqrt(len(draws))
    assert 0.9 < draws.std() / deviation < 1.1
    assert [sharding.draw_hypergeometric(rng, good, bad, n) for n in (0, good + bad)] == [0, good]
    assert sharding.draw_hypergeometric(rng, 10**10, 0, 5) == 5


def matrix(rows, shards, seed=1):
    numbers = np.array(sorted(rows))
    sizes = np.array([rows[k] for k in numbers])
    return sharding.Matrix(numbers, np.concatenate([[0], np.cumsum(sizes)]), shards, seed)


def test_lines_add_up():
    rows = {0: 5, 3: 0, 4: 100, 9: 1, 11: 70_000, 200: 17}
    found = matrix(rows, 7)
    lines = {p: found.line(p) for p in rows}
    assert all(lines[p].sum() == n and (lines[p] >= 0).all() for p, n in rows.items())
    assert (sum(lines.values()) == sharding.shard_sizes(sum(rows.values()), 7)).all()
    for p, n in rows.items():
        dealt = [*found.blocks(p)]
        assert sum(map(len, dealt)) == n and all(len(b) == 1 << sharding.BLOCK_BITS for b in dealt[:-1])
        assert (np.bincount(np.concatenate([*dealt, []]).astype(int), minlength=7) == lines[p]).all()


def test_every_assignment_is_equally_likely():
    """Three partitions of two rows and three shards: 90 assignments."""
    seen = Counter()
    for seed in range(9_000):
        found = matrix({0: 2, 1: 2, 2: 2}, 3, seed)
        seen[tuple(int(s) for p in range(3) for b in found.blocks(p) for s in b)] += 1
    assert len(seen) == 90
    assert sum((n - 100) ** 2 / 100 for n in seen.values()) < 89 + 5 * math.sqrt(2 * 89)


@pytest.mark.parametrize("rows, shards", [(0, 3), (1, 5), (4, 5), (1_000, 7), (333, 1)])
def test_sizes_are_exact(spark, documents, rows, shards):
    docs = documents(*[(None if i % 5 == 0 else i // 2, None if i % 7 == 0 else "x" * (i % 3)) for i in range(rows)])
    found = sharding.shuffle_into_shards(docs, shards)
    assert found.columns == [*docs.columns, "shard", "slot"]
    placed = found.collect()
    check_shards(placed, shards)
    assert Counter((r.doc_id, r.text) for r in placed) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(str, placed)) == sorted(map(str, found.collect()))


def test_blocks_and_cells(spark, monkeypatch, tmp_path):
    """Partitions of many blocks and shards of many cells, and columns with the operator's names."""
    monkeypatch.setattr(sharding, "BLOCK_BITS", 4)
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    docs = spark.range(3_000).selectExpr("id", "id AS shard", "id AS cell", "id AS n", "id AS `a.b`", "id AS rank", "id AS offset", "id AS `order`")
    found = sharding.shuffle_into_shards(docs, 11)
    rows = found.collect()
    check_shards(rows, 11)
    assert sorted(r.id for r in rows) == list(range(3_000)) and all(r.id == r.cell == r["a.b"] == r.rank == r.offset for r in rows)
    # Neither the shard nor the slot follows the order of the input.
    for name in ("shard", "slot"):
        assert abs(np.corrcoef([r.id for r in rows], [r[name] for r in rows])[0, 1]) < 0.08
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 11)
    written = spark.read.parquet(path).collect()
    assert {(r.id, r.shard, r.slot) for r in written} == {(r.id, r.shard, r.slot) for r in rows}


def test_row_keys_carry_the_partition(spark):
    keyed = with_row_key(spark.range(10, numPartitions=3).toDF("x"))
    found = sharding.communication_matrix(keyed, 4, 1)
    assert found.partitions.tolist() == [0, 1, 2] and found.before.tolist() == [0, 3, 6, 10]


def test_query_describes_its_rows(spark, documents, monkeypatch):
    texts = ["", None, "é", "ab", "ab", "x" * 100_000]
    monkeypatch.setattr(queries, "table", lambda *_: documents(*texts))
    rows = queries.op11_sharding(spark, "").collect()
    assert rows[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "rows", None)
    check_shards(rows, 40)
