"""Name normalization, similarity and the candidate search."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.functions.text import name_similarity, normalize_key, normalize_text, tokens
from tidemark.operators.mapping.similar import similar_names


def plain_normalize(text):
    return "".join(c for c in (text or "").lower() if c not in " -_/.")


def plain_tokens(text):
    for c in "-_/.":
        text = text.replace(c, " ")
    return set(text.lower().split())


def plain_similarity(left, right):
    a, b = plain_normalize(left), plain_normalize(right)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    contained = min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
    x, y = plain_tokens(left), plain_tokens(right)
    return max(contained, len(x & y) / len(x | y) if x and y else 0.0)


def test_normalize_and_tokens(spark):
    names = [" Brand Search - US ", "brand_search", "", None, "A/B.c", "  "]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", normalize_key(F.col("n")).alias("k"), tokens(F.col("n")).alias("t")
    )
    for row in rows.collect():
        assert row.k == plain_normalize(row.n) == normalize_text(row.n)
        assert set(row.t) == plain_tokens(row.n or "")


def test_similar_names_equals_comparing_all_pairs(spark):
    rng = random.Random(7)
    words = ["us", "brand", "search", "q1", "retarget", "video", "x"]
    def name():
        return rng.choice("_- /.").join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    left = sorted({name() for _ in range(120)} | {"", "brand", "BRAND", "brandsearchus", "furnitur", "-"})
    right = sorted({name() for _ in range(120)} | {"", "Brand", "brand search us", "furniture", "."})
    frames = [spark.createDataFrame([(n,) for n in names], "n string") for names in (left, right)]
    for threshold in (0.5, 0.72, 0.78, 1.0):
        found = {(r.left_name, r.right_name): r.score for r in similar_names(*frames, threshold).collect()}
        expected = {
            (a, b): plain_similarity(a, b) for a in left for b in right if plain_similarity(a, b) >= threshold
        }
        assert found.keys() == expected.keys()
        assert all(abs(found[pair] - expected[pair]) < 1e-12 for pair in expected)


def test_one_word_in_every_name_forms_no_group(spark):
    """A word shared by all names is looked up only where nothing rarer can decide."""
    left = spark.createDataFrame([(f"us left{i} tag{i} more{i}",) for i in range(300)], "n string")
    right = spark.createDataFrame([(f"us right{i} tag{i} more{i}",) for i in range(300)], "n string")
    assert similar_names(left, right, 0.72).count() == 0
    assert similar_names(left, right, 0.6).count() == 300


def test_similarity_examples(spark):
    row = spark.range(1).select(
        name_similarity(F.lit("not_specified_4"), F.lit("4-NOT SPECIFIED")).alias("words"),
        name_similarity(F.lit("low"), F.lit("5-LOW")).alias("part"),
        name_similarity(F.lit("house-hold"), F.lit("HOUSEHOLD")).alias("same"),
        name_similarity(F.lit(None).cast("string"), F.lit("x")).alias("none"),
    ).first()
    assert (row.words, row.part, row.same, row.none) == (1.0, 0.75, 1.0, 0.0)
