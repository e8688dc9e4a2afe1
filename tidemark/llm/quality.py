"""Text quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.labelled import SAMPLE_ROWS, labelled_texts

#: Class of each code point: 0 other, 1 upper case, 2 other letter, 3 digit; the last entry stands for all beyond.
CLASSES = np.array([1 if chr(c).isupper() else 2 if chr(c).isalpha() else 3 if chr(c).isdigit() else 0 for c in range(0x3000)] + [2], np.uint8)
SPLIT = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
MARKS = "!?.,;:|#*%&$@<>{}[]()_=+~^\\/\"'-"
MARK_POINTS = np.array([ord(mark) for mark in MARKS])
STATISTICS = (
    "log_chars log_words mean_word long_words short_words upper_chars capital_words all_caps digit_chars white_chars mark_chars other_chars "
    "end_marks marked_words lone_marks distinct_words top_word same_neighbours pair_repeats lines repeated_lines mean_line "
    "word_spread first_half"
).split() + [f"mark_{k}" for k in range(len(MARKS))]


def statistics(text: str | None) -> list[float]:
    """The statistics of one text; all are 0 for a text without words."""
    text = text or ""
    words = text.translate(SPLIT).split(" ")
    words = [w for w in words if w]
    if not words:
        return [0.0] * len(STATISTICS)
    chars, n = len(text), len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    _, upper, lower, digits = np.bincount(CLASSES[np.minimum(points, len(CLASSES) - 1)], minlength=4).tolist()
    alphabetic = upper + lower
    white = chars - int(sizes.sum())
    counts = np.bincount(np.minimum(points, 127), minlength=128)[MARK_POINTS].tolist()
    marks = sum(counts)
    numbers: dict[str, int] = {}
    for word in words:
        numbers[word] = numbers.get(word, 0) + 1
    pairs = len(set(zip(words[:-1], words[1:], strict=True)))
    same = sum(a == b for a, b in zip(words[:-1], words[1:], strict=True))
    lines = [line for line in text.split("\n") if line.strip()]
    half = set(words[: n // 2])
    ends = [w[-1] for w in words]
    return [
        math.log1p(chars),
        math.log1p(n),
        float(sizes.mean()),
        float((sizes > 14).mean()),
        float((sizes < 3).mean()),
        upper / max(alphabetic, 1),
        sum(w[0].isupper() for w in words) / n,
        sum(len(w) > 1 and w.isupper() for w in words) / n,
        digits / chars,
        white / chars,
        marks / chars,
        (chars - alphabetic - digits - white - marks) / chars,
        sum(e in ".!?" for e in ends) / n,
        sum(not e.isalnum() for e in ends) / n,
        sum(not any(map(str.isalnum, w)) for w in words if len(w) < 4) / n,
        len(numbers) / n,
        max(numbers.values()) / n,
        same / n,
        1 - pairs / max(n - 1, 1),
        len(lines) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(chars / max(len(lines), 1)),
        float(sizes.std()),
        len(half.intersection(words[n // 2 :])) / max(len(half), 1),
        *(1000 * c / chars for c in counts),
    ]


class BoostedTrees:
    """Trees of a logistic model, flattened: entry ``t, k`` of each array is node k of tree t."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, depth: int, start: float):
        self.feature, self.threshold, self.value, self.depth, self.start = feature, threshold, value, depth, start

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum of the trees; rows and trees descend together, one level at a time."""
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[trees, node]
            node = 2 * node + 1 + (x[rows, feature] > self.threshold[trees, node])
        return self.start + self.value[trees, node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least_rows: int = 8, ridge: float = 1.0) -> BoostedTrees:
    """Boosts full trees of ``depth`` levels on the logistic loss.

    Statistics are cut at ``bins`` quantiles. All nodes of a level get their
    histograms of gradients and curvatures from one counting pass. A node without a
    useful split sends all rows to the left. Without rows of both labels the model
    is the (smoothed) share of ones.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    start = math.log(share / (1 - share))
    inner, whole = 2**depth - 1, 2 ** (depth + 1) - 1
    if len(y) == 0 or y.min() == y.max():
        return BoostedTrees(np.zeros((1, whole), np.int64), np.full((1, whole), np.inf), np.zeros((1, whole)), depth, start)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    features, width = x.shape[1], bins + 1
    flat = binned + np.arange(features) * width
    margin = np.full(len(y), start)
    feature, threshold, value = np.zeros((trees, whole), np.int64), np.full((trees, whole), np.inf), np.zeros((trees, whole))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curvature = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (features * width) + flat).ravel()
            size = count * features * width
            sums = [np.bincount(place, np.repeat(w, features), size).reshape(count, features, width).cumsum(axis=2) for w in (gradient, curvature, np.ones(len(y)))]
            g, h, n = sums
            gain = g**2 / (h + ridge) + (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + ridge) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + ridge)
            gain[(n < least_rows) | (n[:, :, -1:] - n < least_rows)] = -1
            best = gain.reshape(count, -1).argmax(axis=1)
            split_feature, split_bin = best // width, best % width
            useful = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            for k in np.flatnonzero(useful):
                feature[t, first + k], threshold[t, first + k] = split_feature[k], cuts[split_feature[k]][split_bin[k]]
            at = node - first
            right = useful[at] & (binned[np.arange(len(y)), split_feature[at]] > split_bin[at])
            node = 2 * node + 1 + right
        leaf = node - inner
        step = rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, curvature, inner + 1) + ridge)
        value[t, inner:] = step
        margin += step[leaf]
    return BoostedTrees(feature, threshold, value, depth, start)


def _with_statistics(docs: DataFrame, extra: str, extra_type: str) -> DataFrame:
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", extra, "statistics"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", extra).mapInArrow(tasks, f"doc_id long, {extra} {extra_type}, statistics array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, *, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> BoostedTrees:
    """A model of ``label_col`` from at most ``sample_rows`` usable labelled documents (see ``labelled_texts``)."""
    sample = labelled_texts(docs, labels, label_col, usable, sample_rows=sample_rows)
    rows = _with_statistics(sample, "label", "int").toArrow()
    order = np.lexsort((rows.column("label").to_numpy(), rows.column("doc_id").to_numpy()))
    x = np.array(rows.column("statistics").to_pylist(), np.float64).reshape(-1, len(STATISTICS))[order]
    return fit_trees(x, rows.column("label").to_numpy().astype(np.float64)[order])


def score_quality(docs: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``score``, the probability of label 1.

    Null, empty and blank texts have all statistics 0 and are scored like any other.
    Other columns are not read; repeated rows are scored each. An empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(text.as_py()) for text in batch.column(1)], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.probability(x))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tasks, "doc_id long, score double")
