"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components.

Buckets are dealt out with the ids and the signs of their vectors alone. Signs tell
how far apart two vectors can be, so most rows of a bucket have no partner; only
those that have one are given their vectors, and compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, with_row_key
from tidemark.llm.components import components
from tidemark.llm.trie_join import forest
from tidemark.session import snapshot

SEED = 20_240_229
#: Probability with which a pair right at the threshold shares no bucket in any table.
MISS = 1e-4
#: Random vectors that a bucket is planned for.
BUCKET_ROWS = 8
#: Rows of one side of a comparison; larger buckets are compared in pairs of blocks.
BLOCK_ROWS = 512


def plan_tables(largest: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for groups of up to ``largest`` vectors: bits keep buckets small, tables keep the recall."""
    bits = min(30, max(4, math.ceil(math.log2(max(largest, 2) / BUCKET_ROWS))))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))


def most_differing(signs: int, threshold: float) -> int:
    """Signs that differ between two vectors at the threshold at most, but for a chance below 1e-14 (eight deviations)."""
    share = math.acos(threshold) / math.pi
    return math.ceil(signs * share + 8 * math.sqrt(signs * share * (1 - share)))


def _signed(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """``vectors`` with ``signs``: per table the signs of ``bits`` random projections as an integer."""
    kind = vectors.schema["vector"].dataType.simpleString()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            signs: list[list[int]] = []
            for vector in batch.column(1):
                values = np.asarray(vector.as_py(), np.float64)
                if len(values) not in planes:
                    planes[len(values)] = np.random.default_rng((SEED, len(values))).standard_normal((len(values), bits * tables))
                positive = values @ planes[len(values)] > 0
                signs.append((positive.reshape(tables, bits) @ weights).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, pa.list_(pa.int32()))], names=["id", "vector", "family", "weight", "signs"])

    return vectors.select("id", "vector", "family", "weight").mapInArrow(tasks, f"id long, vector {kind}, family long, weight long, signs array<int>")


def _candidates(units: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """The rows (``unit``, ``side``, ``place``, ``id``) of the units that have a partner there, as far as signs tell."""
    limit = most_differing(bits * tables, threshold)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            place = unit.column("place")[0].as_py()
            side = unit.column("side").to_numpy()
            signs = unit.column("signs").combine_chunks().flatten().to_numpy().reshape(unit.num_rows, -1)
            middle = int(np.searchsorted(side, 2)) if side[-1] else 0
            near = _near_signs(signs[:middle] if middle else signs, signs[middle:] if middle else signs, place, limit)
            if not middle:
                np.fill_diagonal(near, False)
            wanted = np.r_[near.any(axis=1), near.any(axis=0)] if middle else near.any(axis=1)
            if wanted.any():
                yield from unit.select(["unit", "side", "place", "id"]).filter(pa.array(wanted)).to_batches()

    ordered = units.repartition("unit").sortWithinPartitions("unit", "side")
    return ordered.mapInArrow(tasks, "unit long, side int, place int, id long")


def _near_signs(a: np.ndarray, b: np.ndarray, place: int, limit: int) -> np.ndarray:
    """Which pairs differ in ``limit`` or fewer signs and share no bucket in a table before ``place``."""
    near = np.zeros((len(a), len(b)), np.int32)
    met = np.zeros(near.shape, bool)
    for table in range(a.shape[1]):
        differing = a[:, table, None] ^ b[None, :, table]
        if table < place:
            met |= differing == 0
        near += np.bitwise_count(differing)
    return (near <= limit) & ~met


def _compare(units: DataFrame, threshold: float) -> DataFrame:
    """(``u``, ``v``, ``n``): ``n`` further links of ``u``, or an edge ``u``-``v`` of the links' spanning forests."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            ids, links, u, v = _unit_links(unit, threshold)
            if len(ids):
                counted = [pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(links)]
                joined = [pa.array(u), pa.array(v), pa.array(np.zeros(len(u), np.int64))]
                for columns in (counted, joined):
                    yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "n"])

    ordered = units.repartition("unit").sortWithinPartitions("unit", "side")
    return ordered.mapInArrow(tasks, "u long, v long, n long")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each unit; units are bounded by the block size."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        names = table.column("unit").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            if held and held[0].column("unit")[0].as_py() != names[start]:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(start, end - start))
    if held:
        yield pa.concat_tables(held)


def _unit_links(unit: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids with their links first found in this table, and the edges that connect them."""
    ids, weight, side = (unit.column(c).to_numpy() for c in ("id", "weight", "side"))
    place = unit.column("place")[0].as_py()
    flat = unit.column("vector").combine_chunks().flatten().to_numpy()
    vectors = flat.reshape(len(ids), -1).astype(np.float64)
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    if side[-1]:
        middle = int(np.searchsorted(side, 2))
        i, j = np.nonzero(vectors[:middle] @ vectors[middle:].T >= threshold)
        j = j + middle
    else:
        i, j = np.nonzero(np.triu(vectors @ vectors.T >= threshold, 1))
    if len(i) and place:
        signs = unit.column("signs").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[:, :place]
        first = ~(signs[i] == signs[j]).any(axis=1)
        i, j = i[first], j[first]
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    found = links > 0
    return ids[found], links[found].astype(np.int64), *forest(ids, i, j)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group: Column | None = None, *, threshold: float = 0.98
) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of equal ``group`` and dimension link at a cosine of ``threshold`` or
    more, worked out in double precision. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows whose group or id is null, link with
    nothing and are their own component (null for a null id); they are kept. Equal
    vectors (by a 128-bit digest) are compared once and count as often as they
    occur; repeated rows are vectors of their own. Other columns are not read. An
    empty table gives an empty result. ``vectors`` is a table (see ``with_row_key``).

    Pairs right at the threshold share a bucket with a probability of 1 - 1e-4 or
    more. A pair counts in the first table whose bucket it shares, so links are
    exact counts of the pairs found. Buckets are compared in blocks of bounded size.
    """
    group = F.lit("") if group is None else group.cast("string")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.transform(F.col(vector_col).cast("array<float>" if single else "array<double>"), lambda x: x + F.lit(0.0).cast("float" if single else "double"))
    rows = with_row_key(vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), group.alias("label")))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    digest = [F.when(F.col("sound"), F.xxhash64(*part)).alias(name) for name, part in (("d1", ("label", "vector")), ("d2", (F.lit(1), "vector", "label")))]
    members = snapshot(rows.select(ROW, "vec_id", *digest))
    classes = snapshot(members.filter("d1 is not null").groupBy("d1", "d2").agg(F.min(ROW).alias("id"), F.min("vec_id").alias("low"), F.count("*").alias("weight")))

    family = F.xxhash64(F.size("vector"), "label")
    firsts = rows.join(classes.select(F.col("id").alias(ROW), "weight"), ROW).select(F.col(ROW).alias("id"), "vector", family.alias("family"), "weight")
    largest = rows.filter("sound").groupBy(F.size("vector"), "label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits, tables = plan_tables(largest, threshold)
    signed = snapshot(_signed(firsts, bits, tables))
    placed = signed.select("id", "signs", "family", F.posexplode("signs").alias("place", "sign")).select(
        "id", "signs", "place", F.xxhash64("place", "sign", "family").alias("bucket")
    )
    large = snapshot(placed.groupBy("bucket").count().filter(F.col("count") > BLOCK_ROWS).select("bucket", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")))
    own = placed.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select(
        F.xxhash64(F.least("own", "other"), F.greatest("own", "other"), "bucket").alias("unit"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "place",
        "id",
        "signs",
    )
    wanted = snapshot(_candidates(units, bits, tables, threshold))
    found = snapshot(_compare(wanted.join(signed.drop("family"), "id"), threshold))
    links = found.filter("v is null").groupBy("u").agg(F.sum("n").alias("links"))
    linked = classes.join(components(found.filter("v is not null").select("u", "v")), F.col("id") == F.col("node"))
    low = snapshot(linked.groupBy("component").agg(F.min("low").alias("component_id")))
    named = snapshot(linked.select("id", "component").join(low, "component").select("id", "component_id"))
    known = classes.join(links, F.col("id") == F.col("u"), "left").join(named, "id", "left")
    n_links = (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    known = snapshot(known.select("d1", "d2", n_links, F.coalesce("component_id", "low").alias("component_id")))

    result = members.join(known, ["d1", "d2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
