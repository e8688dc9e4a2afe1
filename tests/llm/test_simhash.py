"""Trie join, components and SimHash against comparing all pairs."""

from __future__ import annotations

import random

import pytest
import xxhash
from tests.llm.conftest import groups_of

from tidemark.llm import simhash, trie_join
from tidemark.llm.components import components


def noisy_patterns(seed, bits, centres, copies, errors):
    """Random patterns, each with copies that differ in a few bits."""
    random.seed(seed)
    found = []
    for _ in range(centres):
        base = random.getrandbits(bits)
        for _ in range(copies):
            value = base
            for _ in range(random.randint(0, errors)):
                value ^= 1 << random.randrange(bits)
            found.append(value)
    return found


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize(("bits", "budget", "unit_rows"), [(64, 2, 1024), (64, 2, 3), (32, 3, 2), (12, 1, 2)])
def test_trie_links_equal_all_pairs(spark, monkeypatch, bits, budget, unit_rows):
    monkeypatch.setattr(trie_join, "UNIT_ROWS", unit_rows)
    values = noisy_patterns(bits + budget, bits, 12, 12, 4)
    rows = [(i, i % 2, signed(v)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "id long, family int, pattern long")
    edges = [tuple(r) for r in trie_join.trie_links(frame, bits, budget).collect()]
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if i % 2 == j % 2 and (values[i] ^ values[j]).bit_count() <= budget]
    assert groups_of(edges, range(len(values))) == groups_of(pairs, range(len(values)))
    assert set(edges) <= {tuple(sorted(e, reverse=True)) for e in edges}


def test_repeated_patterns_are_cut_by_id(spark, monkeypatch):
    """A pattern that many rows share, beside others near and far."""
    monkeypatch.setattr(trie_join, "UNIT_ROWS", 4)
    values = [7] * 48 + [6, 7 ^ (1 << 40), 7 ^ (0b111 << 20)] + noisy_patterns(5, 32, 4, 5, 2)
    frame = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "id long, family int, pattern long")
    edges = [tuple(r) for r in trie_join.trie_links(frame, 64, 2).collect()]
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    assert groups_of(edges, range(len(values))) == groups_of(pairs, range(len(values)))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40, 70)] + [(100, i) for i in range(101, 140)] + [(5, 5), (9, 8), (8, 9), (None, 3), (200, 201), (201, 202), (202, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    known = [(u, v) for u, v in edges if u is not None and u != v]
    assert found == groups_of(known, {n for e in known for n in e})
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_equal_all_pairs(spark, documents):
    random.seed(3)
    words = ["Alpha", "beta x", "É", "gamma", "Ünit", "delta", "eps", "zeta", "eta", "theta"]
    texts = [None, "", " \n\t", "one", "One", "two words", "a\x0bb\x0cc d"]
    for _ in range(15):
        base = [random.choice(words) for _ in range(random.randint(40, 400))]
        texts += ["  ".join(base), "\n".join(base), " ".join([*base[:-1], "other"])]
    texts.append("long " * 30_000)
    rows = simhash.simhash_components(documents(*texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    pairs = [(i, j) for i in prints for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == groups_of(pairs, prints)
    assert len({r.component_id for r in rows}) < len(texts) - 20


def test_ids_may_be_null_or_repeated(spark, documents):
    rows = simhash.simhash_components(documents((None, "a b c d"), (None, "q"), (4, "a b c d"), (4, "a b c d"), (7, "z"))).collect()
    assert sorted((r.doc_id or -1, -1 if r.component_id is None else r.component_id) for r in rows) == [(-1, -1), (-1, 4), (4, 4), (4, 4), (7, 7)]
    assert simhash.simhash_components(documents()).count() == 0


def test_near_copies_keep_one_of_each_group(spark, documents):
    """The smallest id of each component by comparing all fingerprints, with null and repeated ids."""
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = random.choices(vocabulary, k=900)
        texts += [" ".join(base), " ".join([*base[:-1], "changed"]), "\n".join(base)]
    texts += [None, "", " ", "one", "one"]
    ids = list(range(len(texts)))
    random.shuffle(ids)
    ids[4], ids[5], ids[-1] = None, ids[3], ids[-2]
    rows = [*zip(ids, texts, strict=True)]
    prints = [plain_fingerprint(t) for t in texts]
    roots = groups_of([(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], range(len(texts)))
    stay = {min((k for k in roots if roots[k] == root), key=lambda k: (ids[k] is None, ids[k] or 0, k)) for root in set(roots.values())}
    gone = sorted(r[0] for r in simhash.near_copies(documents(*rows).coalesce(1)).collect())
    assert gone == sorted(set(range(len(texts))) - stay) and len(gone) > 24
    assert simhash.near_copies(documents()).count() == 0
