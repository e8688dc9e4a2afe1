"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each scan partition sends to each shard is drawn first: the matrix of
a uniform random permutation has fixed row sums (rows of a partition) and column
sums (rows of a shard). It is drawn along a binary tree over the partitions, whose
nodes split the columns by multivariate hypergeometric draws seeded by their place,
so every task finds its own line of the matrix from the row counts alone and no
matrix is built. A task deals its rows by a random permutation of its line, rows
are exchanged, and a second permutation inside the shards gives the slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ROW, with_row_key
from tidemark.session import snapshot

SEED = 20_250_117
#: A row key is the scan partition and, in this many low bits, the row's place in it.
PLACE_BITS = 33
#: Rows that a task deals at once.
BLOCK_BITS = 16
#: Rows of one numbering task, on average.
CELL_ROWS = 32_768
#: From this population on numpy refuses hypergeometric draws.
NUMPY_LIMIT = 10**9


def _stirling_error(n: float) -> float:
    """log n! less Stirling's approximation of it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n > 0 else 0.0
    s = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / s) / s) / s) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation near the mean."""
    gap = (x - mean) / (x + mean)
    if abs(gap) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, power, square = (x - mean) * gap, 2 * x * gap, gap * gap
    for k in range(3, 101, 2):
        power *= square
        more = total + power / k
        if more == total:
            break
        total = more
    return total


def _log_binomial(k: int, n: int, p: float) -> float:
    """Log probability of ``k`` hits in ``n`` trials, by its saddle point: accurate for any size."""
    if k == 0 or k == n:
        return n * (math.log1p(-p) if k == 0 else math.log(p))
    error = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
    return error - _deviance(k, n * p) - _deviance(n - k, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """The number of good rows in a sample without replacement, for populations of any size.

    Above numpy's limit it is a ratio-of-uniforms rejection around the mode, with the
    probabilities taken as quotients of binomial ones.
    """
    total = good + bad
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample)) if total and sample else 0
    low, high = max(0, sample - bad), min(sample, good)
    if low == high:
        return low
    p = sample / total
    density = lambda k: _log_binomial(k, good, p) + _log_binomial(sample - k, bad, p)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (total + 2)))
    top = density(mode)
    mean = sample * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - sample) / (total - 1)) + 0.5)
    # Stadlober's rectangle of a universal ratio of uniforms.
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= density(k) - top:
            return k


def split_columns(rng: np.random.Generator, columns: np.ndarray, sample: int) -> np.ndarray:
    """How many of each column's rows are in a random sample of all of them."""
    taken = np.zeros_like(columns)
    rest = int(columns.sum())
    for k, n in enumerate(columns.tolist()):
        rest -= n
        taken[k] = draw_hypergeometric(rng, n, rest, sample)
        sample -= int(taken[k])
    return taken


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return rows // shards + (np.arange(shards) < rows % shards)


@dataclass(frozen=True)
class Matrix:
    """The communication matrix, as what its lines follow from: rows by partition (with their numbers) and shards."""

    partitions: np.ndarray
    before: np.ndarray
    shards: int
    seed: int

    def line(self, partition: int) -> np.ndarray:
        """Rows that ``partition`` sends to each shard."""
        at = int(np.searchsorted(self.partitions, partition))
        low, high = 0, len(self.partitions)
        columns = shard_sizes(int(self.before[-1]), self.shards).astype(np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            rng = np.random.default_rng((self.seed, 0, low, high))
            left = split_columns(rng, columns, int(self.before[middle] - self.before[low]))
            if at < middle:
                high, columns = middle, left
            else:
                low, columns = middle, columns - left
        return columns

    def blocks(self, partition: int) -> Iterator[np.ndarray]:
        """Shards of a partition's rows by place, block by block, each a random permutation of what is drawn for it."""
        columns = self.line(partition)
        rng = np.random.default_rng((self.seed, 1, partition))
        while rest := int(columns.sum()):
            taken = split_columns(rng, columns, min(rest, 1 << BLOCK_BITS))
            columns = columns - taken
            yield rng.permutation(np.repeat(np.arange(self.shards, dtype=np.int32), taken))


def communication_matrix(keyed: DataFrame, shards: int, seed: int) -> Matrix:
    """The matrix of a table with row keys. One count per scan partition goes to the driver."""
    sizes = keyed.groupBy(F.shiftright(ROW, PLACE_BITS).alias("p")).agg(F.count("*").alias("n")).collect()
    found = sorted((r.p, r.n) for r in sizes)
    rows = np.array([n for _, n in found], np.int64)
    return Matrix(np.array([p for p, _ in found], np.int64), np.concatenate([[0], np.cumsum(rows)]).astype(np.int64), shards, seed)


def _dealt(keyed: DataFrame, matrix: Matrix) -> DataFrame:
    """``keyed`` with ``shard``; only the keys go to Python, and a task holds the shards of one block."""
    shared = keyed.sparkSession.sparkContext.broadcast((matrix.partitions, matrix.before))
    shards, seed = matrix.shards, matrix.seed

    @F.pandas_udf("int")
    def shard_of(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lines = Matrix(*shared.value, shards, seed)
        partition, number, blocks, held = -1, -1, iter(()), np.zeros(0, np.int32)
        for series in keys:
            values = series.to_numpy()
            out = np.empty(len(values), np.int32)
            block = values >> BLOCK_BITS
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(values)] if len(values) else [0]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                wanted = int(values[start]) >> PLACE_BITS, int(block[start]) & ((1 << PLACE_BITS - BLOCK_BITS) - 1)
                if wanted[0] != partition:
                    partition, number, blocks = wanted[0], -1, lines.blocks(wanted[0])
                while number < wanted[1]:
                    number, held = number + 1, next(blocks)
                out[start:end] = held[values[start:end] & ((1 << BLOCK_BITS) - 1)]
            yield pd.Series(out)

    return keyed.withColumn("shard", shard_of(ROW))


def shuffle_into_shards(docs: DataFrame, shards: int, *, seed: int = SEED) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, without gaps in each shard).

    All assignments of rows to slots are equally likely. Shard sizes differ by one
    at most. Rows count by their place in the table, so nulls, equal and repeated
    rows are rows like any other, and no value can make a shard or a task large.
    ``docs`` has to be a table (see ``with_row_key``); the same table read in the
    same splits gives the same result. Columns of ``docs`` named ``shard`` or
    ``slot`` are replaced; names that begin with two underscores are kept for the operator. With fewer rows than shards the last shards are empty;
    an empty table gives an empty result. ``docs`` is exchanged once.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    keyed = with_row_key(docs.select(*[F.col(f"`{c}`") for c in names]))
    matrix = communication_matrix(keyed.select(ROW), shards, seed)
    largest = -(-int(matrix.before[-1]) // shards)
    cells = max(1, -(-largest // CELL_ROWS))
    order = F.xxhash64(F.lit(seed), ROW)
    cell = F.pmod(order, F.lit(cells)).cast("int")
    sizes = _dealt(with_row_key(docs).select(ROW), matrix).groupBy("shard", cell.alias("__cell")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = snapshot(sizes.select("shard", "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset")))
    inside = Window.partitionBy("shard", "__cell").orderBy("__order", ROW)
    dealt = _dealt(keyed, matrix).withColumn("__cell", cell).withColumn("__order", order)
    ranked = dealt.withColumn("__rank", F.row_number().over(inside)).join(offsets, ["shard", "__cell"])
    return ranked.select(*[F.col(f"`{c}`") for c in names], "shard", (F.col("__offset") + F.col("__rank") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, *, seed: int = SEED) -> None:
    """The shuffled table as Parquet, one folder per shard; rows of a file ascend by slot."""
    placed = shuffle_into_shards(docs, shards, seed=seed)
    file = F.floor(F.col("slot") / CELL_ROWS)
    placed.repartition("shard", file).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
