"""Hamming self-join of bit patterns by a binary trie.

Two subtries are traversed together. A pair of nodes carries the bits that differ
above it; a pair is dropped as soon as they exceed the error budget, and ends at
two single patterns, whose remaining bits are compared at once.

To spread the traversal, the bits are cut into ``budget + 1`` blocks: patterns
within the budget agree in one of them. Each rotation that starts with a block
therefore needs only pairs of nodes that are equal at the depth of the block, so
every subtrie at that depth is a unit of work. A unit with too many patterns is
replaced by the pairs of nodes some levels below it, with the budget that is left,
until all are small. Units are packed into tasks by Spark; a task walks all units
of a batch together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import snapshot

#: Patterns of a unit above which it is cut further.
UNIT_ROWS = 1024
#: Levels that one cut descends.
STEP_BITS = 5
#: Node pairs that a task expands at a time.
FRONTIER = 1 << 19


def _rotated(pattern: Column, bits: int, shift: int) -> Column:
    """The lowest ``bits`` of the pattern rotated left by ``shift``."""
    if shift == 0:
        return pattern
    mask = (1 << bits) - 1 if bits < 64 else -1
    turned = F.shiftleft(pattern, shift).bitwiseOR(F.shiftrightunsigned(pattern, bits - shift))
    return turned.bitwiseAND(F.lit(mask))


def _right(pattern: Column, shift: Column) -> Column:
    return F.call_function("shiftrightunsigned", pattern, shift.cast("int"))


def _near(width: int, errors: Column, other: Column) -> Column:
    """The values of ``width`` bits that differ from ``other`` in at most ``errors`` bits."""
    return F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda x: F.bit_count(x.bitwiseXOR(other.cast("int"))) <= errors)


def _cut(units: DataFrame, bits: int, width: int, budget: int) -> DataFrame:
    """The rows of large units, dealt to the pairs of nodes ``width`` levels below.

    Rows of one pattern (families may repeat patterns) are dealt to all pairs of
    parts by a hash of their id.
    """
    width = width or STEP_BITS
    ended = F.col("depth") >= bits
    step = F.when(ended, 0).otherwise(width)
    below = _right(F.col("pattern"), F.greatest(F.lit(bits) - F.col("depth") - width, F.lit(0))).bitwiseAND(F.lit((1 << width) - 1))
    part = F.pmod(F.xxhash64("id", "unit"), F.lit(1 << width))
    own = units.withColumn("own", F.when(ended, part).otherwise(below).cast("int"))
    errors = F.when(ended, F.lit(width)).otherwise(F.lit(budget) - F.col("errors"))
    dealt = own.withColumn("other", F.explode(_near(width, errors, F.col("own"))))
    # In a pair of a node with itself a row stands on the side of its own part; else it keeps its side.
    same = F.col("side") == 0
    first = F.when(same, F.least("own", "other")).when(F.col("side") == 1, F.col("own")).otherwise(F.col("other"))
    second = F.when(same, F.greatest("own", "other")).when(F.col("side") == 1, F.col("other")).otherwise(F.col("own"))
    side = F.when(same, F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)).otherwise(F.col("side"))
    return dealt.select(
        F.concat_ws("/", "unit", F.concat_ws("-", first.cast("string"), second.cast("string"))).alias("unit"),
        side.cast("int").alias("side"),
        (F.col("errors") + F.when(ended, 0).otherwise(F.bit_count(F.col("own").bitwiseXOR(F.col("other"))))).cast("int").alias("errors"),
        (F.col("depth") + step).cast("int").alias("depth"),
        "pattern",
        "id",
    )


def trie_links(patterns: DataFrame, bits: int, budget: int) -> DataFrame:
    """Edges (``u``, ``v``) that connect all patterns linked by at most ``budget`` differing bits.

    ``patterns`` has ``id`` (long, one per different pattern), ``family`` (patterns
    of different families are not compared) and ``pattern`` (long, the lowest
    ``bits`` count). The edges are not all links: each unit gives a spanning forest
    of its links, which has the same components. No patterns give no edges.
    """
    blocks = [(k * bits // (budget + 1), (k + 1) * bits // (budget + 1)) for k in range(budget + 1)]
    turned = [
        F.struct(
            F.lit(k).alias("turn"), F.lit(end - start).alias("depth"), _rotated(F.col("pattern"), bits, start).alias("pattern")
        )
        for k, (start, end) in enumerate(blocks)
    ]
    turns = patterns.withColumn("t", F.explode(F.array(*turned)))
    path = F.concat_ws(".", F.col("family").cast("string"), F.col("t.turn").cast("string"), _right(F.col("t.pattern"), F.lit(bits) - F.col("t.depth")).cast("string"))
    units = snapshot(
        turns.select(
            path.alias("unit"), F.lit(0).alias("side"), F.lit(0).alias("errors"), F.col("t.depth").alias("depth"), F.col("t.pattern").alias("pattern"), "id"
        )
    )
    edges = None
    while True:
        counts = units.groupBy("unit").agg(
            F.count("*").alias("n"), F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2")
        )
        useful = counts.filter("n > 1 and (n1 = 0 or n2 > 0) and (n2 = 0 or n1 > 0)")
        large = F.col("n") > 2 * UNIT_ROWS
        sizes = snapshot(useful.select("unit", large.alias("large")))
        known = units.join(sizes, "unit")
        found = _walk(known.filter("not large").drop("large"), bits, budget)
        edges = found if edges is None else edges.unionByName(found)
        if not sizes.filter("large").limit(1).count():
            return edges
        hot = known.filter("large").drop("large")
        left = bits - hot.filter(F.col("depth") < bits).agg(F.coalesce(F.max("depth"), F.lit(bits))).first()[0]
        units = snapshot(_cut(hot, bits, min(STEP_BITS, left), budget))


def _walk(units: DataFrame, bits: int, budget: int) -> DataFrame:
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_units(batches):
            u, v = _unit_edges(part, bits, budget)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    ordered = units.repartition("unit").sortWithinPartitions("unit", "side", _unsigned("pattern"))
    return ordered.mapInArrow(tasks, "u long, v long")


def _unsigned(name: str) -> Column:
    """Sorts like the unsigned value."""
    return F.col(name).bitwiseXOR(F.lit(-(1 << 63)))


def whole_units(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Sorted batches, regrouped so that no unit is cut; units are small, so these tables are too."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        names = table.column("unit").to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(names != names[-1])[-1]) + 1 if names[0] != names[-1] else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        size = table.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def _unit_edges(table: pa.Table, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    names = table.column("unit").to_numpy(zero_copy_only=False)
    side = table.column("side").to_numpy()
    ids = table.column("id").to_numpy()
    patterns = table.column("pattern").to_numpy().view(np.uint64)
    starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    ends = np.r_[starts[1:], len(names)]
    # Rows of a unit are sorted by side: one node with itself, or side 1 with side 2.
    middle = np.searchsorted(np.cumsum(side == 2), np.r_[0, np.cumsum(side == 2)][starts], side="right")
    pair = side[starts] > 0
    a0, a1 = starts, np.where(pair, middle, ends)
    b0, b1 = np.where(pair, middle, starts), ends
    errors, depth = table.column("errors").to_numpy()[starts], table.column("depth").to_numpy()[starts]
    i, j = traverse(patterns, bits, budget, a0, a1, b0, b1, errors, depth)
    return forest(ids, i, j)


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id to the smallest id that the links ``ids[i]``-``ids[j]`` connect it with."""
    if not len(i):
        return ids[:0], ids[:0]
    nodes, at = np.unique(ids[np.r_[i, j]], return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def traverse(
    patterns: np.ndarray, bits: int, budget: int, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, errors: np.ndarray, depth: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the budget, from pairs of trie nodes.

    A node is a range of rows of sorted ``patterns`` that share their first ``depth``
    bits; node pairs with equal ranges are a node with itself, whose pairs count
    once. Pending node pairs are a stack of pieces of bounded size.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [tuple(np.asarray(x, np.int64) for x in (a0, a1, b0, b1, errors, depth))]
    while stack:
        piece = stack.pop()
        if len(piece[0]) > FRONTIER:
            half = len(piece[0]) // 2
            stack += [tuple(x[:half] for x in piece), tuple(x[half:] for x in piece)]
            continue
        a0, a1, b0, b1, errors, depth = piece
        same = a0 == b0
        live = (a1 > a0) & (b1 > b0) & ~(same & (a1 - a0 < 2))
        single = live & (((a1 - a0 == 1) & (b1 - b0 == 1)) | (depth >= bits))
        if single.any():
            found.append(_compared(patterns, budget, a0[single], a1[single], b0[single], b1[single]))
        more = live & ~single
        if not more.any():
            continue
        a0, a1, b0, b1, errors, depth, same = (x[more] for x in (a0, a1, b0, b1, errors, depth, same))
        shift = (bits - 1 - depth).astype(np.uint64)
        am, bm = _ones_from(patterns, a0, a1, shift), _ones_from(patterns, b0, b1, shift)
        cross = errors < budget
        parts = [
            (a0, am, b0, bm, errors, depth + 1),
            (am, a1, bm, b1, errors, depth + 1),
            tuple(x[cross] for x in (a0, am, bm, b1, errors + 1, depth + 1)),
            tuple(x[cross & ~same] for x in (am, a1, b0, bm, errors + 1, depth + 1)),
        ]
        children = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (children[1] > children[0]) & (children[3] > children[2]) & ~((children[0] == children[2]) & (children[1] - children[0] < 2))
        if keep.any():
            stack.append(tuple(x[keep] for x in children))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _compared(patterns: np.ndarray, budget: int, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the given ranges within the budget; ranges are single rows but for repeated patterns."""
    width = b1 - b0
    if (a1 - a0 > 1).any() or (width > 1).any():
        sizes = (a1 - a0) * width
        pair = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        i, j = a0[pair] + at // width[pair], b0[pair] + at % width[pair]
        once = (a0 != b0)[pair] | (i < j)
        i, j = i[once], j[once]
    else:
        i, j = a0, b0
    near = np.bitwise_count(patterns[i] ^ patterns[j]) <= budget
    return i[near], j[near]


def _ones_from(patterns: np.ndarray, start: np.ndarray, end: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The first row of each range whose bit at ``shift`` is set, by bisection of all ranges at once."""
    low, high = start.copy(), end.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        one = open_ & ((patterns[np.minimum(mid, len(patterns) - 1)] >> shift) & np.uint64(1)).astype(bool)
        high = np.where(one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
