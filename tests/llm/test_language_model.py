"""The recurrent model: gradients, probabilities, and whole-document scores against plain sums."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import gru, language_model
from tidemark.llm.common import id_remainder


def small():
    shape = gru.Shape(np.array([0, 2, 5, 9]), 3)
    return shape, (gru.initial(shape, np.full(9, 1 / 9)) * 3).astype(np.float64)


def test_gradient_equals_differences():
    shape, flat = small()
    rng = np.random.default_rng(0)
    inputs = rng.integers(0, 9, (5, 2))
    inputs[0], inputs[3, 1] = 9, 9
    targets = np.r_[inputs[1:], rng.integers(0, 9, (1, 2))]
    run = lambda v: gru.window_gradient(shape, shape.split(v), inputs, targets, np.zeros((2, 3)), shape.class_of())
    gradient = run(flat)[0]
    for k in rng.choice(len(flat), 80, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert (run(up)[1] - run(down)[1]) / 2e-5 == pytest.approx(gradient[k], abs=1e-3)


def test_next_word_probabilities_sum_to_one():
    shape, flat = small()
    p, words = shape.split(flat), np.arange(9)
    state = gru.step(p, np.array([9]), np.random.default_rng(1).normal(size=(1, 3)))[0]
    logs = gru.log_probability(shape, p, np.repeat(state, 9, axis=0), words, shape.class_of())
    assert np.exp(logs).sum() == pytest.approx(1)


def test_texts_of_all_lengths_carry_their_state():
    shape, flat = small()
    p, rng = shape.split(flat), np.random.default_rng(2)
    texts = [rng.integers(0, 9, n) for n in (1, 40, 3, 100, 2, 33, 32)]
    expected = []
    for text in texts:
        h, total, word = np.zeros((1, 3)), 0.0, np.array([9])
        for target in text:
            h = gru.step(p, word, h)[0]
            total += float(gru.log_probability(shape, p, h, np.array([target]), shape.class_of())[0])
            word = np.array([target])
        expected.append(total)
    assert gru.score_texts(shape, p, texts) == pytest.approx(expected, rel=1e-4)
    assert len(gru.score_texts(shape, p, [])) == 0


def test_states_in_columns_advance_as_in_rows():
    shape, flat = small()
    p, n, words = shape.split(flat), shape.width, np.array([4, 9, 0, 7, 4])
    h = np.random.default_rng(4).uniform(-1, 1, (5, n))
    parts = [np.empty((k * n, 5)) for k in (2, 1, 1, 1)]
    gru._advance(p["embed"][words].T, h.T, p["recur"].T, *parts)
    state, update, reset, new, inner_new = gru.step(p, words, h)
    for got, expected in zip(parts, (np.hstack([update, reset]), inner_new, new, state), strict=True):
        assert got.T == pytest.approx(expected)


@pytest.mark.parametrize("size", [1.0, 300.0, 30_000.0])
def test_softmax_of_small_and_of_huge_weights(size):
    """Only weights that could overflow have their maximum taken off; both ways give the same gradient and likelihood."""
    rng = np.random.default_rng(6)
    s, weight, bias = rng.uniform(-1, 1, (50, 3)), rng.normal(0, size, (3, 7)), rng.normal(0, size, 7)
    place = rng.integers(0, 7, 50)
    loss, gradient = gru._softmax_gradient(s.astype(np.float32), place, weight.astype(np.float32), bias.astype(np.float32))
    scores = s @ weight + bias
    logs = scores - scores.max(axis=1)[:, None]
    logs -= np.log(np.exp(logs).sum(axis=1))[:, None]
    expected = np.exp(logs)
    expected[np.arange(50), place] -= 1
    assert loss == pytest.approx(-logs[np.arange(50), place].sum(), rel=1e-3)
    assert gradient == pytest.approx(expected, abs=1e-2)
    shape = gru.Shape(np.array([0, 7]), 3)
    p = {"class_w": np.zeros((3, 1)), "class_b": np.zeros(1), "word_w": weight, "word_b": bias}
    assert gru.log_probability(shape, p, s, place, shape.class_of()) == pytest.approx(logs[np.arange(50), place])


def test_training_lowers_the_loss():
    shape = gru.Shape(np.array([0, 1, 3, 6]), 8)
    texts = [np.array([1, 2, 3, 4, 5] * 8 + [0]) for _ in range(60)]
    counts = np.bincount(np.concatenate(texts), minlength=6)
    before = gru.initial(shape, counts / counts.sum())
    after, seen = gru.train(shape, before, texts, lanes=2, steps=8)
    assert seen > 2000
    assert gru.score_texts(shape, shape.split(after), texts).sum() > 0.5 * gru.score_texts(shape, shape.split(before), texts).sum()


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


@pytest.fixture
def tiny(monkeypatch):
    for name, value in {"VOCABULARY": 24, "GROUPS": 4, "DICTIONARY": 30, "CLASSES": 5, "WIDTH": 6, "GROUP_WORDS": 500, "HELD_WORDS": 10, "SHARD_WORDS": 900, "BLOCK": 64, "LANES": 4, "STEPS": 6}.items():
        monkeypatch.setattr(language_model, name, value)


def test_scores_of_whole_documents(documents, tiny):
    random.seed(3)
    tongues = [["the", "cat", "Sat", "on", "a", "mat", "the", "the"], ["le", "chat", "été", "sur", "la", "natte", "le", "le"]]
    texts = [None, "", "THE\x0bcat", "unseen words only", "x " * 4000]
    texts += [" ".join(random.choices(random.choice(tongues) + [f"rare{k % 40}"], k=random.randint(1, 60))) for k in range(160)]
    held = {k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 10 == 0}
    counts = Counter(w for k, t in enumerate(texts) if k not in held for w in [*words(t), None])
    total, distinct = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in language_model.score_documents(documents(*texts), id_remainder("doc_id", 10) == 0).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        r, tokens = rows[k], [*words(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k in held, len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0


def test_scores_equal_a_plain_walk(documents, tiny, monkeypatch):
    """Word by word through the trained network, with each word's share of its symbol."""
    random.seed(4)
    texts = [None, "", "A b\tc", "never seen before words", "x " * 300]
    texts += [" ".join(random.choices([f"w{k % 17}" for k in range(40)] + [f"rare{k}" for k in range(60)], k=random.randint(1, 50))) for _ in range(120)]
    held = {k for k in range(len(texts)) if k % 7 == 3}
    kept = {}
    for name in ("build_lexicon", "train_model"):
        monkeypatch.setattr(language_model, name, lambda *a, run=getattr(language_model, name), name=name: kept.setdefault(name, run(*a)))
    rows = {r.doc_id: r.score for r in language_model.score_documents(documents(*texts), F.col("doc_id").isin(*held)).collect()}
    lexicon, weights = kept["build_lexicon"], kept["train_model"]
    counts = Counter(w for k, t in enumerate(texts) if k not in held for w in [*words(t), ""])
    shape = lexicon.shape
    p, class_of = shape.split(weights.astype(np.float64)), shape.class_of()
    own = {w: s for w, number in lexicon.known.items() if (s := int(lexicon.symbol[number])) not in set(lexicon.groups.tolist())}
    for k, text in enumerate(texts):
        state, last, total = np.zeros((1, shape.width)), np.array([shape.words]), 0.0
        for word in [*words(text), ""]:
            group = language_model.spelling_group(word.encode())
            symbol = own.get(word.encode(), int(lexicon.groups[group]))
            state = gru.step(p, last, state)[0]
            classes = state @ p["class_w"] + p["class_b"]
            a, b = shape.first[class_of[symbol]], shape.first[class_of[symbol] + 1]
            inside = state @ p["word_w"][:, a:b] + p["word_b"][a:b]
            chance = np.exp(classes[0, class_of[symbol]]) / np.exp(classes).sum() * np.exp(inside[0, symbol - a]) / np.exp(inside).sum()
            share = 1.0 if word.encode() in own else (counts[word] + 0.1) / lexicon.masses[group]
            total += math.log10(chance) + math.log10(share)
            last = np.array([symbol])
        assert rows[k] == pytest.approx(total, rel=1e-3)


@pytest.mark.parametrize("lengths, lanes", [([], 4), ([1], 4), ([1, 1], 8), ([5, 1, 30, 2], 4), ([3] * 50, 16), ([700], 3)])
def test_every_word_is_a_target_once(lengths, lanes):
    shape = gru.Shape(np.array([0, 1000]), 2)
    numbers = iter(range(1000))
    texts = [np.array([next(numbers) for _ in range(n)], np.uint16) for n in lengths]
    rows = gru.lanes_of(shape, texts, lanes)
    targets = sorted(t for t in rows[1:].ravel().tolist() if t != 1000)
    assert targets == list(range(sum(lengths)))
    # What precedes a target is the word before it in its text, or the start.
    before = {int(t): int(i) for i, t in zip(rows[:-1].ravel(), rows[1:].ravel(), strict=True)}
    firsts = {int(t[0]) for t in texts}
    assert all(before[t] == (1000 if t in firsts else t - 1) for t in targets)


def test_held_out_documents_are_likelier_than_by_word_counts(spark):
    from tidemark.llm.queries import op3_language_model

    sums = op3_language_model(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).groupBy("held_out").agg(F.sum("score"), F.sum("base_score")).collect()
    assert len(sums) == 2 and all(score > base for _, score, base in sums)


def test_symbols_have_all_the_probability(spark, tiny):
    """Words of a group share its symbol, so all words and one unknown word per group sum to one."""
    random.seed(5)
    counts = {f"w{random.randint(0, 99)}x{k}": random.randint(1, 9) for k in range(80)} | {"": 7}
    lexicon = language_model.build_lexicon(spark.createDataFrame(list(counts.items()), "word string, n long"))
    mass = np.zeros(len(lexicon.frequency))
    for word, n in counts.items():
        number = lexicon.known.get(word.encode())
        group = language_model.spelling_group(word.encode())
        if number is None:
            mass[lexicon.groups[group]] += (n + 0.1) / lexicon.masses[group]
        else:
            mass[lexicon.symbol[number]] += 10 ** lexicon.share_log[number]
    for group, symbol in enumerate(lexicon.groups):
        mass[symbol] += 0.1 / lexicon.masses[group]
    assert mass == pytest.approx(np.ones(len(mass)))
    assert len(lexicon.known) <= 31 and lexicon.frequency.sum() == pytest.approx(1)
    assert {g: language_model.spelling_group("été".encode()) == g for g in range(4)}[spark.range(1).select(language_model._spelling_group(F.lit("été"))).first()[0]]


def test_degenerate_tables(documents, tiny):
    assert language_model.score_documents(documents(), F.lit(False)).count() == 0
    rows = language_model.score_documents(documents("a b", None), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3, 0, 0), (1, 0, 0)]
    same = language_model.score_documents(documents((1, "a a"), (1, "a a"), (None, "a")), F.lit(False)).collect()
    assert sorted((r.n_tokens, r.train_tokens) for r in same) == [(2, 8), (3, 8), (3, 8)]


def test_every_training_document_is_trained_on_once(spark, documents, tiny, monkeypatch):
    random.seed(8)
    trained, kind = [], type(spark.range(0))

    def recorded(self, function, schema, *rest, run=kind.mapInArrow, **options):
        if str(schema).startswith("block "):
            trained.extend(r.key for r in self.select("key").collect())
        return run(self, function, schema, *rest, **options)

    monkeypatch.setattr(kind, "mapInArrow", recorded)
    docs = documents(*(" ".join(random.choices(["a", "b", "c"], k=20)) for _ in range(200)))
    language_model.score_documents(docs, F.col("doc_id") % 10 == 0)
    keys = language_model.with_row_key(docs).filter("doc_id % 10 <> 0").collect()
    assert sorted(trained) == sorted(r[language_model.ROW] for r in keys) and len(trained) == 180
