"""Length buckets of least padding, and batches of a token budget inside them.

The histogram of all lengths is small whatever the number of rows: lengths below
``2 * EXACT`` are its keys as they are, longer ones in ``EXACT`` bins per power of
two, each with its true maximum and sum. Dynamic programming over it picks the
bucket boundaries; every row is padded to the boundary of its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import WORD, filled
from tidemark.session import snapshot

EXACT_BITS = 11
#: Rows of one numbering task at most, on average.
SHARD_ROWS = 4096


def word_count(text: Column | str) -> Column:
    """Number of words of a text, the length that the queries pack by."""
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def best_boundaries(histogram: list[tuple[int, int, int]], max_buckets: int) -> list[int]:
    """Boundaries of at most ``max_buckets`` buckets with the least total padding.

    ``histogram`` lists (largest length, rows, sum of lengths) of each bin by
    ascending length. With C and S the running rows and sums, a bucket of bins
    i+1..j pads ``top_j * (C_j - C_i) - (S_j - S_i)``. For a fixed j the choice of
    i minimises lines in ``top_j`` with falling slopes ``-C_i``, so each layer is
    one pass over a lower envelope.
    """
    tops = [0, *(top for top, _, _ in histogram)]
    rows, sums = [0], [0]
    for _, n, total in histogram:
        rows.append(rows[-1] + n)
        sums.append(sums[-1] + total)
    size = len(tops)
    if size == 1:
        return []
    cost = [0] + [tops[j] * rows[j] - sums[j] for j in range(1, size)]
    came_from = [[0] * size]
    for _ in range(1, min(max_buckets, size - 1)):
        layer, origin = cost[:], [-1] * size  # -1: no further bucket helps
        hull: list[tuple[int, int, int]] = []  # slope, intercept, bin
        at = 0
        for j in range(1, size):
            i = j - 1
            line = (-rows[i], cost[i] + sums[i], i)
            while len(hull) - at >= 2 and _crossed(hull[-2], hull[-1], line):
                hull.pop()
            hull.append(line)
            while len(hull) - at >= 2 and hull[at + 1][0] * tops[j] + hull[at + 1][1] <= hull[at][0] * tops[j] + hull[at][1]:
                at += 1
            padded = tops[j] * rows[j] - sums[j] + hull[at][0] * tops[j] + hull[at][1]
            if padded < layer[j]:
                layer[j], origin[j] = padded, hull[at][2]
        cost = layer
        came_from.append(origin)
    boundaries, j = [], size - 1
    for origin in reversed(came_from):
        if j and origin[j] >= 0:
            boundaries.append(tops[j])
            j = origin[j]
    return boundaries[::-1]


def _crossed(first: tuple[int, int, int], middle: tuple[int, int, int], last: tuple[int, int, int]) -> bool:
    """The middle line is nowhere below both others."""
    return (last[1] - first[1]) * (first[0] - middle[0]) <= (middle[1] - first[1]) * (first[0] - last[0])


def length_histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(largest length, rows, sum) of each bin of column ``n_tokens``; the number of bins has a fixed bound."""
    shift = F.greatest(F.length(F.bin("n_tokens")) - (EXACT_BITS + 1), F.lit(0))
    bins = lengths.groupBy(shift.alias("shift"), F.expr(f"shiftright(n_tokens, greatest(length(bin(n_tokens)) - {EXACT_BITS + 1}, 0))").alias("bin"))
    found = bins.agg(F.max("n_tokens").alias("top"), F.count("*").alias("n"), F.sum("n_tokens").alias("total")).collect()
    return sorted((r.top, r.n, r.total) for r in found)


def _by_bucket(boundaries: list[int], values: list[int]) -> Column:
    """The value of the first bucket whose boundary is not below the length."""
    chosen = F.lit(values[-1])
    for top, value in reversed(list(zip(boundaries[:-1], values[:-1], strict=True))):
        chosen = F.when(F.col("n_tokens") <= top, F.lit(value)).otherwise(chosen)
    return chosen.cast("long")


def pack_by_length(
    docs: DataFrame, length: Column, id_col: str = "doc_id", *, token_budget: int = 65_536, max_buckets: int = 32, spread_by: Column | None = None
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``bucket``, ``padded_tokens``, ``batch``, ``slot``.

    ``length`` gives the tokens of a row; null and negative lengths count as 0.
    A bucket's batches hold ``max(1, token_budget // boundary)`` rows each, all but
    its last are full; a row longer than the budget is a batch of its own and stays
    whole. Batches are numbered from 0 in each bucket, slots from 0 in each batch.
    Rows are ordered by a hash of ``spread_by`` (the id if not given), so repeated
    rows and null ids get places of their own. Other columns are not read. An empty
    table gives an empty result.
    """
    count = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    key = F.xxhash64(F.col(id_col), spread_by) if spread_by is not None else F.xxhash64(F.col(id_col))
    lengths = snapshot(docs.select(F.col(id_col).alias("doc_id"), count.alias("n_tokens"), key.alias("key")))

    histogram = length_histogram(lengths)
    boundaries = best_boundaries(histogram, max_buckets) or [0]
    in_bucket = [0] * len(boundaries)
    at = 0
    for top, n, _ in histogram:
        while top > boundaries[at]:
            at += 1
        in_bucket[at] += n
    shards = [max(1, -(-n // SHARD_ROWS)) for n in in_bucket]

    placed = lengths.select(
        "doc_id",
        "n_tokens",
        "key",
        _by_bucket(boundaries, list(range(len(boundaries)))).alias("bucket"),
        _by_bucket(boundaries, boundaries).alias("padded_tokens"),
        F.pmod("key", _by_bucket(boundaries, shards)).alias("shard"),
    )
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = snapshot(sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("bucket", "shard").orderBy("key", "doc_id", "n_tokens")
    rank = F.col("offset") + F.row_number().over(inside) - 1
    rows = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("padded_tokens"), F.lit(1)))).cast("long")
    numbered = placed.join(offsets, ["bucket", "shard"]).withColumn("rank", rank).withColumn("rows", rows)
    return numbered.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_tokens",
        F.expr("rank div rows").alias("batch"),
        (F.col("rank") % F.col("rows")).alias("slot"),
    )
