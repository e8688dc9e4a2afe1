"""Spelling variants against a comparison of all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling
from tidemark.session import snapshot

ASCII_LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(ASCII_LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_groups(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def words_like(rng, word, alphabet):
    for _ in range(rng.randint(0, 3)):
        at = rng.randint(0, len(word))
        kind = rng.choice("ids")
        word = word[:at] + ("" if kind == "d" else rng.choice(alphabet)) + word[at + (kind != "i") :]
    return word


@pytest.mark.parametrize("seed, alphabet", [(1, "ab"), (2, "abcdefgh"), (3, "étaoinÿ×÷ßàz"), (4, "\U0001f600a字b")])
def test_groups_equal_all_pairs(spark, seed, alphabet):
    rng = random.Random(seed)
    seeds = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 6, 9, 30]))) for _ in range(25)]
    counts = {words_like(rng, rng.choice(seeds), alphabet): rng.choice([3, 3, 6, 7, 14, 40, 90]) for _ in range(500)}
    counts.pop("", None)
    frame = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")
    assert {tuple(r) for r in spelling.variant_groups(frame).collect()} == plain_groups(counts)


def test_documents_with_everything(spark, documents):
    rng = random.Random(6)
    base = ["colour", "color", "Colours", "mañana", "manana", "ÀLONG", "àlong", "élan", "theatre", "theater", "grey", "aaaaa", "aaaaaa", "aaaaaaa"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(None, "Colour_theatre9colour-COLOUR"), (None, None), (5, ""), (5, "..."), (7, "theatre"), (7, "theatre"), (8, "x" * 3_000), (8, "x" * 3_000)]
    rows += [(9, "colour theater " * 5_000), (10, "x" * 3_000 + " " + "x" * 2_999 + " " + ("x" * 2_999 + " ") * 3)]
    counts = plain_words(rows)
    found = spelling.word_counts(documents(*rows)).collect()
    assert {r.word: r.n for r in found} == counts and len(found) > 12
    assert {tuple(r) for r in spelling.spelling_variants(documents(*rows)).collect()} == plain_groups(counts)
    assert spelling.spelling_variants(documents()).collect() == []


def test_chains_end_at_their_root(spark):
    words = ["abcde" + "x" * k for k in range(20)]
    frame = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(words)], "word string, n long")
    rows = {r.word: r for r in spelling.variant_groups(frame).collect()}
    assert all(r.root == words[-1] for r in rows.values())
    assert rows[words[0]].form == words[1] and rows[words[-1]].form is None


def test_tables_of_words_are_not_broadcast(spark, documents, monkeypatch):
    plans = []

    def kept(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return snapshot(frame)

    monkeypatch.setattr(spelling, "snapshot", kept)
    rows = [(i, "colour color colours colors theatre theater") for i in range(3)] + [(i, "colors theatre") for i in range(3, 9)]
    found = spelling.spelling_variants(documents(*rows))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in found.collect()} == plain_groups(plain_words(rows))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_near_words_share_a_signature():
    rng = random.Random(7)
    for _ in range(400):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12)))
        at, letter = rng.randint(0, len(word) - 1), rng.choice("abcdeéz")
        replaced, longer = word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:]
        if replaced != word:
            signs = [*zip(*spelling.signatures([word, replaced], 2), strict=True)]
            assert set(signs[0]) & set(signs[1])
        signs = [*zip(*spelling.signatures([word, longer], 1), strict=True)]
        assert set(signs[0]) & set(signs[1])
