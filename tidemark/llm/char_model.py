"""A character trigram model and Viterbi decoding of character lattices under it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols: 0 word boundary, 1-26 a-z, 27-59 U+00DF-U+00FF, 60 other letters, 61 digits, 62 all else.
SIZE = 64
#: Characters whose trigrams are counted at a time.
GROUP_CHARS = 1 << 20


def _symbol_table() -> np.ndarray:
    def symbol(char: str) -> int:
        if char.isspace():
            return 0
        if "a" <= char <= "z":
            return ord(char) - 96
        if "ß" <= char <= "ÿ" and char != "÷":
            return ord(char) - 0xDF + 27
        return 60 if char.isalpha() else 61 if char.isdigit() else 62

    return np.array([symbol(chr(c)) for c in range(0x3000)] + [60], np.uint8)


SYMBOLS = _symbol_table()


def symbols_of(text: str) -> np.ndarray:
    """The symbols of a lower-case text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return SYMBOLS[np.minimum(points, len(SYMBOLS) - 1)]


def trigrams(text: str) -> np.ndarray:
    """Indexes of the trigrams of the words of a lower-case text; each word stands between boundaries."""
    c = np.r_[np.zeros(2, np.int64), symbols_of(text), 0].astype(np.int64)
    a, b, c = c[:-2], c[1:-1], c[2:]
    index = (np.where(b == 0, 0, a) * SIZE + b) * SIZE + c
    return index[(b > 0) | (c > 0)]


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all trigrams of all texts; a table of fixed size is all that leaves a task."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIZE**3, np.int64)
        held: list[str] = []
        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.append((text.as_py() or "").lower())
                size += len(held[-1])
                if size >= GROUP_CHARS:
                    counts += np.bincount(trigrams("\n".join(held)), minlength=SIZE**3)
                    held, size = [], 0
        counts += np.bincount(trigrams("\n".join(held)), minlength=SIZE**3)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["place", "n"])

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(tasks, "place long, n long")
    rows = parts.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SIZE**3, np.int64)
    counts[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    return counts


def log_probabilities(counts: np.ndarray, strength: float = 20.0) -> np.ndarray:
    """log P(c | a, b), flat; trigrams back off to bigrams and these to single symbols."""
    n = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    one = (n.sum(axis=(0, 1)) + 0.5) / (n.sum() + 0.5 * SIZE)
    pairs = n.sum(axis=0)
    two = (pairs + strength * one) / (pairs.sum(axis=1, keepdims=True) + strength)
    three = (n + strength * two) / (n.sum(axis=2, keepdims=True) + strength)
    return np.log(three).astype(np.float32).ravel()


Candidate = tuple[str, float]


def viterbi(model: np.ndarray, lattices: list[list[list[Candidate]]]) -> list[str]:
    """The best string of each lattice.

    A lattice lists per position its candidates: one or two characters (the first
    may be a blank, a word boundary) and the cost of having been written as they
    were. States are pairs of neighbouring candidates, which give the model its two
    characters of history. Lattices of similar length are decoded together.
    """
    found = [""] * len(lattices)
    order = sorted(range(len(lattices)), key=lambda k: (len(lattices[k]), max(map(len, lattices[k]), default=0)))
    start = 0
    while start < len(order):
        end, length = start, max(1, len(lattices[order[start]]))
        while end < len(order) and (end - start) * length < 100_000 and len(lattices[order[end]]) <= length + length // 4:
            end += 1
        group = order[start:end]
        for k, path in zip(group, _paths(model, [lattices[g] for g in group]), strict=True):
            found[k] = "".join(position[int(i)][0] for position, i in zip(lattices[k], path, strict=False))
        start = end
    return found


def _paths(model: np.ndarray, lattices: list[list[list[Candidate]]]) -> np.ndarray:
    """The index of the best candidate per lattice and position."""
    n, length = len(lattices), max(map(len, lattices))
    width = max((len(p) for lattice in lattices for p in lattice), default=1)
    if not length:
        return np.zeros((n, 0), np.int64)
    first, last = np.zeros((length, n, width), np.int64), np.zeros((length, n, width), np.int64)
    cost = np.full((length, n, width), np.inf, np.float32)
    double = np.zeros((length, n, width), bool)
    at: list[int] = []
    strings: list[str] = []
    costs: list[float] = []
    for row, lattice in enumerate(lattices):
        for place, position in enumerate(lattice):
            base = (place * n + row) * width
            for k, (string, price) in enumerate(position):
                at.append(base + k)
                strings.append(string if len(string) == 2 else string * 2)
                costs.append(price)
                if len(string) == 2:
                    double[place, row, k] = True
    symbols = symbols_of("".join(strings)).astype(np.int64).reshape(-1, 2)
    first.ravel()[at], last.ravel()[at] = symbols[:, 0], symbols[:, 1]
    cost.ravel()[at] = costs
    sizes = np.array([len(lattice) for lattice in lattices])

    def emitted(x: np.ndarray, y: np.ndarray, place: int) -> np.ndarray:
        """log P of the candidates at ``place`` after the characters x, y; shapes (n, j, k, 1) to (n, j, k, m)."""
        f, t, d = (v[place][:, None, None, :] for v in (first, last, double))
        after_gap = np.where(f == 0, 0, y)
        return model[(x * SIZE + y) * SIZE + f] + np.where(d, model[(after_gap * SIZE + f) * SIZE + t], 0)

    zero = np.zeros((n, 1, 1, 1), np.int64)
    score = emitted(zero, zero, 0)[:, 0] - cost[0][:, None, :]
    back: list[np.ndarray] = []
    final_j, final_k = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for place in range(length):
        # score[n, j, k]: candidate j before candidate k at this place
        y = last[place][:, None, :]
        before = last[place - 1][:, :, None] if place else np.zeros((n, 1, 1), np.int64)
        x = np.where(double[place][:, None, :], first[place][:, None, :], np.broadcast_to(before, (n, score.shape[1], width)))
        x = np.where(y == 0, 0, x)
        ending = sizes == place + 1
        if ending.any():
            ends = (score + model[(x * SIZE + y) * SIZE])[ending]
            best = ends.reshape(len(ends), -1).argmax(axis=1)
            final_j[ending], final_k[ending] = best // width, best % width
        if place + 1 == length:
            break
        step = score[..., None] + emitted(x[..., None], np.broadcast_to(y, x.shape)[..., None], place + 1)
        back.append(step.argmax(axis=1).astype(np.int8))
        score = step.max(axis=1) - cost[place + 1][:, None, :]
    path = np.zeros((n, length), np.int64)
    rows = np.arange(n)
    j, k = final_j, final_k
    for place in range(length - 1, -1, -1):
        here = sizes > place
        path[:, place] = np.where(here, k, 0)
        if place:
            # The candidate at place - 2 that led to candidates j, k at place - 1 and place.
            earlier = back[place - 1][rows, j, k]
            j, k = np.where(here, earlier, j), np.where(here, j, k)
    return path
