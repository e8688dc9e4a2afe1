"""Toxicity and quality: decoding, trees, held-out accuracy and odd rows."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import char_model, labelled, quality, toxicity
from tidemark.llm.common import table
from tidemark.llm.queries import op5_toxicity, op6_quality
from tidemark.llm.recent import Recent

SF_DIR = os.environ.get("TEST_LABEL_DIR", "/root/testdata/sf0.01")


def path_cost(model, path):
    string = "".join(s for s, _ in path)
    grams = char_model.trigrams(string)
    return sum(c for _, c in path) - float(model[grams].sum())


@pytest.mark.parametrize("seed", range(12))
def test_decoding_finds_the_best_path(seed):
    random.seed(seed)
    corpus = "the cat sat on that mat at ten thin times"
    model = char_model.log_probabilities(np.bincount(char_model.trigrams(corpus), minlength=char_model.SIZE**3), strength=0.5)
    lattices = []
    for _ in range(6):
        lattice = []
        for k in range(random.randint(1, 6)):
            options = [(c, random.choice([0.0, 0.5, 1.5])) for c in random.sample("athes", random.randint(1, 3))]
            options += [(random.choice("at") * 2, 1.0)] if random.random() < 0.4 else []
            options += [(" " + random.choice("ath"), 0.3)] if k and random.random() < 0.4 else []
            lattice.append(options)
        lattices.append(lattice)
    for lattice, found in zip(lattices, char_model.viterbi(model, lattices), strict=True):
        costs = {}
        for path in itertools.product(*lattice):
            string = "".join(s for s, _ in path)
            costs[string] = min(path_cost(model, path), costs.get(string, np.inf))
        assert costs[found] == pytest.approx(min(costs.values()), abs=1e-3)


def test_disguises_are_restored():
    words = "idiot stupid moron hello there people walk in the park the and of".split()
    model = char_model.log_probabilities(np.bincount(char_model.trigrams(" ".join(words * 20)), minlength=char_model.SIZE**3))
    given = {"1d10t": "idiot", "stuuupid": "stupid", "$tup1d!!": "stupid", "m0r0n,": "moron", "i.d.i.o.t": "idiot", "hello": "hello", "(park)": "park", "thereee": "there"}
    assert {t: " ".join(w) for t, w in toxicity.restored(model, given).items()} == given
    (apart,) = set(toxicity.tokens_of("see i d i o t")) - {"see"}
    assert "idiot" in toxicity.restored(model, [apart])[apart]
    assert toxicity.tokens_of("a b") == ["a", "b"] and toxicity.tokens_of("") == []


def test_disguised_edges_are_read_both_ways():
    words = "mass shirt crap glass the and of park rap shir mas hello".split()
    model = char_model.log_probabilities(np.bincount(char_model.trigrams(" ".join(words * 20)), minlength=char_model.SIZE**3))
    read = toxicity.restored(model, ["ma$$", "shir+", "gla$$.", "(rap", "(rap)", "hello!", "hello!!", "$$", "(", "5$", "park+|"])
    assert {"mass", "ma"} >= set(read["ma$$"]) >= {"mass"} and "shirt" in read["shir+"] and "glass" in read["gla$$."]
    assert read["(rap"] == ["rap", "crap"] and read["(rap)"] == ["rap"]
    assert read["hello!"] == read["hello!!"] == ["hello"] and read["park+|"][0] == "park"
    assert read["$$"] == [""] and read["("] == [""] and read["5$"] == ["5"]


def test_trigram_counts_equal_plain_ones(documents):
    texts = ["Ab cé", None, "", "ab\n\nab!", "x" * 3000]
    counts = char_model.count_trigrams(documents(*texts))
    expected = np.zeros(char_model.SIZE**3, int)
    for text in texts:
        for word in (text or "").lower().split():
            padded = [0, 0, *char_model.symbols_of(word).tolist(), 0]
            for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
                expected[(a * 64 + b) * 64 + c] += 1
    assert (counts == expected).all()


def test_trees_learn_and_descend_together():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.fit_trees(x[:2000], y[:2000], trees=40, depth=3)
    assert ((model.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95

    def plain(row, tree):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + 1 + int(row[model.feature[tree, node]] > model.threshold[tree, node])
        return model.value[tree, node]

    assert model.margin(x[:20]) == pytest.approx([model.start + sum(plain(r, t) for t in range(40)) for r in x[:20]])
    assert quality.fit_trees(x[:5], np.ones(5)).probability(x[:1])[0] > 0.8
    assert quality.fit_trees(x[:0], np.zeros(0)).probability(x[:1])[0] == 0.5


def test_statistics_of_odd_texts():
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n") == [0.0] * len(quality.STATISTICS)
    assert all(np.isfinite(quality.statistics(t)).all() for t in ("a", "!!!", "\U0001f600", "A1 b\n\nA1 b", "w " * 50_000, "x" * 100_000))


@pytest.mark.parametrize(("query", "label", "divisor", "rest"), [(op5_toxicity, "toxic", 5, 0), (op6_quality, "quality", 3, 1)])
def test_held_out_accuracy(spark, query, label, divisor, rest):
    import zlib

    found = query(spark, SF_DIR)
    rows = found.join(table(spark, SF_DIR, "labels"), "doc_id", "left").collect()
    assert len(rows) == table(spark, SF_DIR, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r[label] is not None]
    share = sum(r[label] for r in held) / len(held)
    accuracy = sum(r.predicted == r[label] for r in held) / len(held)
    assert accuracy > max(share, 1 - share) + 0.02 and accuracy > 0.9


def test_odd_rows_and_labels(spark, documents):
    docs = documents(*[f"fine idiot {k} here" if k % 3 == 0 else f"fine words {k} here" for k in range(60)], None, "", (None, "you 1d10t"), (3, "fine"), "i d i o t", "idiot " * 30_000, "y o u i d i o t", "i d i o t " * 3_000, "fine y o u i d i o t fine words " * 50, "h e r e w o r d s " * 40)
    labels = [(k, 1, int(k % 3 == 0)) for k in range(60)] + [(None, 1, 1), (5, 1, None), (6, 1, 7), (999, 0, 1), (9, 1, 1), (9, 1, 1)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, given, F.lit(True))
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == 70 and all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None and 5 < r.doc_id < 60)
    assert [r.score >= 0.5 for r in rows if r.doc_id is None or r.doc_id in (60, 61, 64, 65, 66, 67, 68, 69)] == [False, False, True, True, True, True, True, True, False]
    assert labelled.labelled_texts(docs, given, "toxic", F.lit(True), sample_rows=7).select("doc_id").distinct().count() <= 7
    nothing = given.limit(0)
    for fit, score, unlearned in ((toxicity.fit_toxicity, toxicity.score_toxicity, 0.25), (quality.fit_quality, quality.score_quality, 0.5)):
        assert {round(r.score, 6) for r in score(docs, fit(docs, nothing, F.lit(True))).collect()} == {unlearned}
        assert score(documents(), fit(documents(), given, F.lit(True))).count() == 0


def test_labels_bound_the_rows(spark, documents):
    """Many documents of one id, ids with two labels, and ids of another type."""
    docs = documents(*[(7, f"text {k}") for k in range(500)], (8, "eight"), (9, None), (None, "none"))
    given = spark.createDataFrame([(7, 1), (7, 0), (7, 0), (8, 1), (9, 0), (10, 1), (None, 1)], "doc_id int, toxic int")
    found = labelled.labelled_texts(docs, given, "toxic", F.lit(True)).collect()
    assert sorted((r.doc_id, r.label) for r in found) == [(7, 0), (7, 0), (7, 1), (8, 1), (9, 0)]
    assert {r.text for r in found if r.doc_id == 7} == {"text 0"}
    assert labelled.labelled_texts(docs, given, "toxic", F.lit(True), sample_rows=2).count() == 2
    narrow = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    model = quality.fit_quality(narrow, given.withColumnRenamed("toxic", "quality"), F.lit(True))
    assert quality.score_quality(narrow, model).filter("score BETWEEN 0 AND 1").count() == 503


def test_recent_results_are_bounded():
    recent = Recent(3)
    for group in ({"a", "b", "c", "d"}, {"a", "e"}, {"a", "b"}):
        for key in recent.missing(group):
            recent.known[key] = key.upper()
        assert all(recent.known[k] == k.upper() for k in group) and len(recent.known) + len(recent.older) <= 8
