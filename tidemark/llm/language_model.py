"""Log-likelihood of whole documents under a gated recurrent language model.

Word counts of all training documents fix the vocabulary: the most frequent words
have a symbol of their own, all others share one symbol per spelling group, inside
which a word has its smoothed frequency. The model therefore gives every word a
probability, and starts as the unigram model. Texts become arrays of symbols once.
The model is trained on them in rounds: every task trains a copy on its part of the
round's documents, then the copies are averaged; the rounds together are one pass
over all words of all training documents. Scoring runs over all symbols in tasks;
only words outside a bounded dictionary are looked up by a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.common import ROW, with_row_key
from tidemark.llm.packing import length_histogram
from tidemark.session import snapshot

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The end of a text among the counted words; no word is empty.
END = ""
SMOOTHING = 0.1
#: Words with a symbol of their own, spelling groups of all others, words that tasks know without a join.
VOCABULARY, GROUPS, DICTIONARY = 1_024, 128, 262_144
WIDTH, CLASSES = 16, 32
#: Rounds of training, over which the training documents are dealt.
ROUNDS = 3
#: Words that a task trains on at least; numbers of a block when models are averaged.
SHARD_WORDS, BLOCK = 2_000_000, 8_192
#: Rows of a window, and its steps.
LANES, STEPS = 512, 16
#: Counted words that a task holds, and words that it scores together.
HELD_WORDS, GROUP_WORDS = 200_000, 2_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z as lower case."""
    return (text or "").encode().translate(LOWER).split()


def spelling_group(word: bytes) -> int:
    """Words of a group begin and end alike."""
    text = word.decode()
    return zlib.crc32((text[:2] + text[-2:]).encode()) % GROUPS


def _spelling_group(word: Column) -> Column:
    return F.crc32(F.concat(F.substring(word, 1, 2), F.right(word, F.lit(2)))) % GROUPS


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(``word``, ``n``) over all texts, with ``END`` once per text."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                held[END.encode()] += 1
                if len(held) > HELD_WORDS:
                    yield emit()
                    held.clear()
        yield emit()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(tasks, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What a task knows of words: their numbers, and by number symbol, log10 base probability and log10 share of the symbol."""

    known: dict[bytes, int]
    symbol: np.ndarray
    base_log: np.ndarray
    share_log: np.ndarray
    groups: np.ndarray
    shape: gru.Shape
    frequency: np.ndarray
    total: int
    distinct: int
    masses: np.ndarray

    def base(self) -> float:
        """The denominator of the base probability."""
        return self.total + SMOOTHING * (self.distinct + 1)


def build_lexicon(counts: DataFrame) -> Lexicon:
    """Vocabulary, classes and the masses of the spelling groups; bounded whatever the number of different words."""
    of_ends = F.sum(F.when(F.col("word") == END, F.col("n")))
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(of_ends, F.lit(0))).first()
    top = _most_frequent(counts)
    grouped = counts.filter(F.col("word") != END).groupBy(_spelling_group(F.col("word")).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    masses = np.full(GROUPS, SMOOTHING)
    for r in grouped.collect():
        masses[r.g] += r.n + SMOOTHING * r.words
    own = [(w, n) for w, n in top if w != END.encode()][: VOCABULARY - GROUPS - 1]
    for word, n in own:
        masses[spelling_group(word)] -= n + SMOOTHING
    masses = np.maximum(masses, SMOOTHING)
    symbols: list[tuple[float, bytes | int]] = [(n + SMOOTHING, w) for w, n in own] + [(ends + SMOOTHING, END.encode())] + [(m, g) for g, m in enumerate(masses)]
    symbols.sort(key=lambda s: (-s[0], str(s[1])))
    frequency = np.array([n for n, _ in symbols])
    frequency /= frequency.sum()
    place = np.cumsum(np.sqrt(frequency))
    classes = np.minimum((place / place[-1] * CLASSES).astype(int), CLASSES - 1)
    first = np.r_[np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]]), len(symbols)]
    number = {s: i for i, (_, s) in enumerate(symbols)}
    groups = np.array([number[g] for g in range(GROUPS)])
    top = [*((w, n) for w, n in top if w != END.encode()), (END.encode(), ends)]
    times = np.array([n for _, n in top]) + SMOOTHING
    group = np.array([spelling_group(w) for w, _ in top])
    symbol = np.array([number.get(w, -1) for w, _ in top])
    share = np.where(symbol >= 0, 0.0, np.log10(times / masses[group]))
    base = np.log10(times / (total + SMOOTHING * (distinct + 1)))
    known = {w: i for i, (w, _) in enumerate(top)}
    return Lexicon(known, np.where(symbol >= 0, symbol, groups[group]), base, share, groups, gru.Shape(first, WIDTH), frequency, total, distinct, masses)


def _most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """All words more frequent than the count at which they would outnumber the dictionary."""
    room, least = DICTIONARY, 0
    for top, words, _ in reversed(length_histogram(counts.select(F.col("n").alias("n_tokens")))):
        room -= words
        if room < 0:
            least = top
            break
    rows = counts.filter(F.col("n") > least).collect()
    return sorted(((r.word.encode(), r.n) for r in rows), key=lambda row: (-row[1], row[0]))


ROWS = f"{ROW} long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, share double"
NUMBERED = f"{ROWS}, rare array<string>, times array<long>, symbols binary"


def number_words(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row the symbols of its text, the sums over the words that tasks know, and the other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.known, lexicon.symbol.astype("<u2"), lexicon.groups.astype("<u2"), lexicon.base_log, lexicon.share_log))
    end = lexicon.known[END.encode()]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, symbol, groups, base_log, share_log = shared.value
        get = known.get
        for batch in batches:
            rows = []
            for text in batch.column(3):
                words = words_of(text.as_py())
                numbers = np.full(len(words) + 1, end, np.int64)
                numbers[:-1] = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                symbols, other = symbol[numbers], np.flatnonzero(numbers < 0)
                rare = [words[k] for k in other.tolist()]
                if rare:
                    symbols[other] = groups[[spelling_group(w) for w in rare]]
                hits = numbers[numbers >= 0]
                counted = Counter(rare)
                sums = float(base_log[hits].sum()), float(share_log[hits].sum())
                rows.append((len(numbers), len(hits), *sums, [w.decode() for w in counted], list(counted.values()), symbols.tobytes()))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            names = [ROW, "doc_id", "held_out", "n_tokens", "n_known", "base_score", "share", "rare", "times", "symbols"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return docs.select(ROW, "doc_id", "held_out", "text").mapInArrow(tasks, NUMBERED)


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(value.as_buffer(), "<u2") for value in column]


def train_model(numbered: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Weights after ``ROUNDS`` rounds of training and averaging; each (``key``, ``symbols``) is trained on in one of them."""
    spark = numbered.sparkSession
    first, width = lexicon.shape.first, lexicon.shape.width
    weights = gru.initial(lexicon.shape, lexicon.frequency)
    shards = max(1, lexicon.total // (ROUNDS * SHARD_WORDS))
    # Models are averaged in two steps, so that no group holds more than about the root of their number.
    parts = math.isqrt(shards) + 1
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)
        rate = 0.01 / 2**number
        chosen = numbered.filter(F.pmod(F.xxhash64("key"), F.lit(ROUNDS)) == number)

        def tasks(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            texts = [text for batch in batches for text in _symbols(batch.column(1))]
            trained, seen = gru.train(gru.Shape(first, width), shared.value, texts, lanes=LANES, steps=STEPS, rate=rate)
            blocks = [trained[at : at + BLOCK] for at in range(0, len(trained), BLOCK)]
            n = len(blocks) if seen else 0
            columns = [pa.array(range(n), pa.int32()), pa.array([seen] * n, pa.int64()), pa.array([np.random.default_rng(seen).integers(parts)] * n, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([b.tolist() for b in blocks[:n]], pa.list_(pa.float32()))], names=["block", "seen", "part", "values"])

        # Parts of the table are trained on where they lie; only the models move.
        copies = chosen.select("key", "symbols").coalesce(shards).mapInArrow(tasks, "block int, seen long, part int, values array<float>")
        halfway = copies.groupBy("block", "part").applyInArrow(_averaged, "block int, seen long, part int, values array<float>")
        merged = halfway.groupBy("block").applyInArrow(_averaged, "block int, seen long, part int, values array<float>").toArrow()
        if merged.num_rows:
            order = np.argsort(merged.column("block").to_numpy())
            values = merged.column("values").to_pylist()
            weights = np.concatenate([np.array(values[k], np.float32) for k in order])
    return weights


def _averaged(rows: pa.Table) -> pa.Table:
    """The mean of the rows' values, by the number of words each has seen."""
    seen = rows.column("seen").to_numpy()
    values = rows.column("values").combine_chunks().flatten().to_numpy().reshape(len(seen), -1)
    mean = np.average(values, axis=0, weights=seen).astype(np.float32)
    return pa.table(
        {"block": rows.column("block")[:1], "seen": pa.array([int(seen.sum())]), "part": rows.column("part")[:1], "values": pa.array([mean.tolist()], pa.list_(pa.float32()))}
    )


def _scored(numbered: DataFrame, lexicon: Lexicon, weights: np.ndarray) -> DataFrame:
    """Per row the score without its rare words."""
    shared = numbered.sparkSession.sparkContext.broadcast(weights)
    first, width = lexicon.shape.first, lexicon.shape.width

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = gru.Shape(first, width)
        p = shape.split(shared.value)
        held: list[pa.RecordBatch] = []
        size = 0

        def emit() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            scores = gru.score_texts(shape, p, _symbols(rows.column("symbols"))) / math.log(10)
            total = pa.array(scores + rows.column("share").to_numpy())
            return pa.RecordBatch.from_arrays([*[rows.column(k).combine_chunks() for k in range(6)], total], names=[*names, "score"])

        names = [ROW, "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
        for batch in batches:
            held.append(batch)
            size += sum(len(value.as_buffer()) for value in batch.column("symbols")) // 2
            if size >= GROUP_WORDS:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    columns = [ROW, "doc_id", "held_out", "n_tokens", "n_known", "base_score", "share", "symbols"]
    return numbered.select(*columns).mapInArrow(tasks, ROWS.replace("share", "score"))


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Scores are log10 probabilities of the whole text including its end. Everything
    is learned from rows that are not ``held_out``. Null and empty texts are their
    end alone. Repeated rows count and are scored each; a null id is kept. Without
    training rows all words are unknown and equally likely. Other columns are not
    read. An empty table gives an empty result.
    """
    rows = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")))
    counts = snapshot(word_counts(rows.filter(~F.col("held_out"))))
    lexicon = build_lexicon(counts)
    numbered = snapshot(number_words(rows, lexicon))
    weights = train_model(numbered.filter(~F.col("held_out")).select(F.col(ROW).alias("key"), "symbols"), lexicon)
    scored = _scored(numbered, lexicon, weights)
    rare = numbered.select(ROW, F.explode(F.arrays_zip("rare", "times")).alias("r")).select(ROW, F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = rare.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))
    mass = F.array(*map(F.lit, lexicon.masses.tolist()))[_spelling_group(F.col("word")).cast("int")]
    sums = found.groupBy(ROW).agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.col("c") / lexicon.base())).alias("more_base"),
        F.sum(F.col("times") * F.log10(F.col("c") / mass)).alias("more_score"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    # The end of a text is known by the tasks, but occurs only if there are training rows.
    unseen = F.lit(0 if lexicon.total else 1)
    return scored.join(sums, ROW, "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") - unseen + zero("more_known")).cast("long").alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("more_base")).alias("base_score"),
        (F.col("score") + zero("more_score")).alias("score"),
    )
