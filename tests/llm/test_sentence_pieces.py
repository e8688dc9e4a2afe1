"""Pieces against the library that defines them."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import sentence_pieces as pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "b", " ", "  ", "\n", "\t", "é", "😀", "▁", "the", "ing", "<s>", "</s>", "<0x0A>", "梦", "ab", "xx", "aaaa", "​", "0", "ü", "ꦀ", "́", "th", "tion", "\x00"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def given():
    random.seed(8)
    made = ["".join(random.choices(BITS, k=random.randint(0, 50))) for _ in range(1500)]
    return [*made, "aab" * 3000, "▁" * 50 + " " * 77, "", " ", "\n", "x" * 5000, "word " * 20_000]


def test_ids_and_texts_equal_the_library(library):
    model = pieces.PieceModel.load(PATH)
    for text, (n, ids, decoded) in zip(given(), pieces.Encoder(model).encode(iter(given())), strict=True):
        expected = library.encode(text, add_eos=True)
        assert ids == " ".join(map(str, expected)) and n == len(expected), text[:60]
        assert decoded == library.decode(expected) == pieces.decode(model, expected), text[:60]


def test_random_ids_decode_as_the_library_does(library):
    model = pieces.PieceModel.load(PATH)
    random.seed(9)
    for _ in range(300):
        ids = random.choices([*range(3, 259), *random.sample(range(259, 32_000), 300), 1, 2], k=random.randint(0, 12))
        if ids[:1] and model.types[ids[0]] == pieces.CONTROL:
            continue
        assert pieces.decode(model, ids) == library.decode(ids), ids


def test_heap_and_rounds_agree():
    model = pieces.PieceModel.load(PATH)
    random.seed(10)
    parts = ["▁" + "".join(random.choices("abcdeinth", k=random.randint(1, 300))) for _ in range(50)]
    assert pieces.merge_rounds(model, parts) == [pieces.merge_long(model, p) for p in parts]


def test_known_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN_PARTS", 5)
    monkeypatch.setattr(pieces, "GROUP_CHARS", 10)
    model = pieces.PieceModel.load(PATH)
    few = pieces.Encoder(model)
    texts = [f"one two {k} three {k % 3}" for k in range(40)]
    found = list(few.encode(iter(texts)))
    assert found == list(pieces.Encoder(model).encode(iter(texts))) and len(few.recent.known) + len(few.recent.older) < 40


def test_query_columns(documents, library):
    texts = [None, "", "a  b", "same", "same"]
    rows = {r.doc_id: r for r in pieces.encode_texts(documents(*texts), PATH, digests=True).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_eos=True)
        assert rows[k].n_tokens == len(ids) and rows[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    plain = {r.doc_id: r for r in pieces.encode_texts(documents(*texts), PATH).collect()}
    assert plain[2].ids == library.encode("a  b", add_eos=True) and plain[2].decoded == "a  b"
    assert pieces.encode_texts(documents(), PATH).count() == 0
