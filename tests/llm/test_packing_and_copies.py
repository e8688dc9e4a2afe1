"""Packing and exact copies against plain computations."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, packing


def padding(lengths, boundaries):
    return sum(min(b for b in boundaries if b >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(30))
def test_boundaries_are_optimal(seed):
    random.seed(seed)
    lengths = [random.choice([0, 1, 2, 3, 5, 8, 13, 40, 41, 90]) for _ in range(random.randint(1, 60))]
    buckets = random.randint(1, 5)
    bins = sorted(set(lengths))
    histogram = [(n, lengths.count(n), n * lengths.count(n)) for n in bins]
    found = packing.best_boundaries(histogram, buckets)
    choices = (c for k in range(1, buckets + 1) for c in itertools.combinations(bins, k) if c[-1] == bins[-1])
    assert len(found) <= buckets and found[-1:] == bins[-1:]
    assert padding(lengths, found or [0]) == min(padding(lengths, c) for c in choices)


def test_batches_are_full_and_whole(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    random.seed(1)
    sizes = [random.choice([0, 1, 4, 30, 31, 400]) for _ in range(300)]
    docs = documents(*("w " * n for n in sizes), None, (None, "a b"), (5, "w"), (5, "w"))
    rows = packing.pack_by_length(docs, packing.word_count("text"), token_budget=64, max_buckets=3, spread_by=F.col("text")).collect()
    assert len(rows) == 304 and sorted(r.n_tokens for r in rows) == sorted([*sizes, 0, 2, 1, 1])
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.padded_tokens
        batches[r.bucket, r.batch].append(r)
    last = {bucket: max(b for k, b in batches if k == bucket) for bucket, _ in batches}
    for (bucket, batch), members in batches.items():
        full = max(1, 64 // max(members[0].padded_tokens, 1))
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) == full if batch < last[bucket] else len(members) <= full
    assert all(sorted(b for k, b in batches if k == bucket) == list(range(n + 1)) for bucket, n in last.items())
    assert packing.pack_by_length(documents(), packing.word_count("text")).count() == 0


def test_very_long_lengths_share_bins(spark):
    lengths = spark.createDataFrame([(n,) for n in [1, 4095, 4096, 4097, 5_000_000, 5_000_001]], "n_tokens long")
    found = packing.length_histogram(lengths)
    assert sum(n for _, n, _ in found) == 6 and found[:2] == [(1, 1, 1), (4095, 1, 4095)] and found[-1][0] == 5_000_001


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256("".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()].append((-len(text or ""), doc_id))
    return {(doc_id, sha): (min(g)[1], len(g), min(g)[1] == doc_id) for sha, g in groups.items() for _, doc_id in g}


@pytest.mark.parametrize("all_digests", [True, False])
def test_groups_equal_plain_ones(documents, all_digests):
    random.seed(2)
    long = "x" * 300
    texts = [None, "", " \n", "ab", "a b", "A b", "a\x0bb", "a b", "é", "é", long + "1", long + "2", long + " 1", "z" * 200_000, "z " * 200_000]
    texts += [random.choice(["p", "q r", "s\tt"]) * random.randint(1, 3) for _ in range(60)]
    rows = list(enumerate(texts))
    random.shuffle(rows)
    found = exact_dedup.exact_groups(documents(*rows), all_digests=all_digests).collect()
    expected = {doc_id: v for (doc_id, _), v in plain_groups(rows).items()}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found} == expected
    digests = {doc_id: sha for doc_id, sha in plain_groups(rows)}
    assert all(r.text_sha256 == digests[r.doc_id] or (not all_digests and r.group_size == 1) for r in found)


def test_one_of_repeated_rows_stays(documents):
    found = exact_dedup.exact_groups(documents((1, "a b"), (1, "a b"), (None, "ab"), (None, "q"), (None, "q"), (9, "u"))).collect()
    assert len(found) == 6 and sum(r.kept for r in found) == 3
    assert {(r.doc_id, r.keep_id) for r in found if r.kept} == {(1, 1), (None, None), (9, 9)}
    assert exact_dedup.exact_groups(documents()).count() == 0
