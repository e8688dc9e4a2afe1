"""Spelling variants of words: a PartEnum join of letter multisets, verified by edit distance.

A word's letters, the k-th copy of a letter apart from the others, are a binary
vector. One inserted or deleted code point changes one position of it, a replaced
one two, so near words have vectors at a Hamming distance of one or two. Letters
are dealt to ``n`` parts; vectors that differ in at most ``k`` positions agree in at
least ``n - k`` of the parts, so each choice of ``n - k`` parts is a signature and near
words share at least one. Near words also have the first or the last half of the
shorter one in common, since one edit lies in one half: each signature is taken
once with either half, which keeps the groups of equal signatures small. Equal
signatures are joined and the pairs verified in the same step.

All joins are of tables that grow with the vocabulary, and ask for a merge. Spark
sizes such tables by their compressed files, and signed words as one row a word, so
one that it takes for small enough to broadcast can outgrow the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filled
from tidemark.session import snapshot

#: A run of letters (ASCII and Latin-1 from U+00C0 on).
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many, by a hash of document and run, loses a letter.
DAMAGED = 97
#: Common letters first; they are dealt to the parts in turn, other letters by code point.
DEALT = "etaoinshrdlucmfwypvbgkjqxz"
#: Parts of the letters by Hamming distance.
PARTS = {1: 3, 2: 4}
#: Words that a task signs at once.
ROWS = 2_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(``word``, ``n``): the letter runs of all texts, A-Z lower-cased, some damaged, that are long and frequent enough.

    A run is damaged if 97 divides h, the CRC-32 of ``id:run``: it loses its code
    point number h % length. A null id counts as the empty text.
    """
    runs = F.regexp_extract_all(F.translate(filled(text_col), UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    occurrences = docs.select(name.alias("name"), F.explode(runs).alias("run"))
    hashed = occurrences.filter(F.length("run") >= min_length).withColumn("h", F.crc32(F.concat("name", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % DAMAGED == 0, damaged).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _letter_values(letters: np.ndarray) -> np.ndarray:
    """A random 64-bit number per code point (a fixed mixing of it)."""
    x = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts_of(letters: np.ndarray, parts: int) -> np.ndarray:
    turn = np.arange(128)
    turn[[ord(c) for c in DEALT]] = np.arange(len(DEALT))
    return np.where(letters < len(turn), turn[np.minimum(letters, len(turn) - 1)], letters) % parts


def signatures(words: list[str], kind: int) -> Iterator[np.ndarray]:
    """Signatures of each word for pairs at Hamming distance ``kind``: equal lengths for 2, lengths one apart for 1.

    A signature holds the length of the shorter word of its pairs, one half of the
    word, the choice of parts and the multiset of letters in them (as the sum of the
    letters' numbers). Equal hashes of different signatures only add candidates.
    """
    parts = PARTS[kind]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    cell = np.repeat(np.arange(len(words)), lengths) * parts + _parts_of(letters, parts)
    sums = np.zeros(len(words) * parts, np.uint64)
    np.add.at(sums, cell, _letter_values(letters))
    sums = sums.reshape(len(words), parts)
    for role in (0, 1) if kind == 1 else (0,):
        shorter = lengths - role
        half = shorter // 2
        for side in (0, 1):
            shared = [w[:n] if side == 0 else w[len(w) - n :] for w, n in zip(words, half.tolist(), strict=True)]
            base = np.fromiter((xxhash.xxh64_intdigest(s.encode(), n * 4 + side * 2 + kind - 1) for s, n in zip(shared, shorter.tolist(), strict=True)), np.uint64, len(words))
            for number, chosen in enumerate(itertools.combinations(range(parts), parts - kind)):
                found = base + np.uint64(number)
                for p in chosen:
                    found = _letter_values(found ^ sums[:, p])
                yield found.view(np.int64)


def _signed(words: DataFrame) -> DataFrame:
    """(``signature``, ``kind``, ``word``): 24 rows per word."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                held = batch.column(0).slice(start, ROWS)
                values = held.to_pylist()
                for kind in PARTS:
                    for found in signatures(values, kind):
                        columns = [pa.array(found), pa.array(np.full(len(found), kind, np.int8)), held]
                        yield pa.RecordBatch.from_arrays(columns, names=["signature", "kind", "word"])

    return words.select("word").mapInArrow(tasks, "signature long, kind byte, word string")


def near_pairs(words: DataFrame) -> DataFrame:
    """(``a``, ``b``), ``a`` < ``b``: all pairs of the distinct ``word``s that differ by one inserted, deleted or replaced code point."""
    signed = _signed(words)
    left, right = signed.withColumnRenamed("word", "a"), signed.withColumnRenamed("word", "b")
    candidates = left.join(right.hint("merge"), ["signature", "kind"]).filter("a < b")
    apart = F.abs(F.length("a") - F.length("b"))
    fitting = candidates.filter(apart == F.when(F.col("kind") == 1, 1).otherwise(0))
    return fitting.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``): ``form`` followed to the last, by doubling the steps until nothing changes.

    A form occurs at least twice as often as its word, so a chain has at most 63
    steps and seven doublings reach every root.
    """
    current = snapshot(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not current.filter("moved").isEmpty():
        further = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = current.join(further.hint("merge"), "root", "left")
        current = snapshot(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return current.select("word", "root")


def variant_groups(counts: DataFrame) -> DataFrame:
    """One row per word of (``word``, ``n``): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are near if they differ by exactly one inserted, deleted or replaced code
    point. A word's form is its near word of largest ``n`` (the first in code-point
    order of equal ones) if that is at least twice the word's own, else null; its
    root is the end of the chain of forms, or the word itself. Words are distinct
    and not null. An empty table gives an empty result.
    """
    words = counts.select("word", "n")
    pairs = snapshot(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")).hint("merge"), "b")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b").alias("form")))
    nearest = known.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(nearest.hint("merge"), "word", "left")
    chosen = F.col("best.less") <= -2 * F.col("n")
    found = snapshot(
        joined.select(
            "word",
            F.when(chosen, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variant_groups`` of the words of all texts (see ``word_counts``).

    Null texts have no words; repeated rows count each; other columns are not read;
    an empty table gives an empty result.
    """
    return variant_groups(snapshot(word_counts(docs, id_col, text_col)))
