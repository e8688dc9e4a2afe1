"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are compared after deleting ASCII white space. The first scan takes the
length and a hash of the first characters of each text. Only rows that share
both with another row can have a copy, and only for those the second scan hashes
the whole text. Which rows these are travels as a set of hash slots of a fixed
size, so neither scan shuffles a text; slots that two keys share by accident
cost a hash and are told apart by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, WHITE, filled, with_row_key
from tidemark.session import snapshot

#: Number of slots; the broadcast set has at most so many rows, whatever the input.
SLOTS = 1 << 20


def normalised(text: Column | str) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(filled(text), WHITE, "")


def _slot() -> Column:
    return F.pmod(F.xxhash64("size", "prefix"), F.lit(SLOTS))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = 256, all_digests: bool = False
) -> DataFrame:
    """One row per input row: ``__row``, ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with most characters stays, then the smallest id (null
    last), then the first row; exactly one row of a group is ``kept``, also among
    repeated rows. Null and empty texts, and texts of white space only, form one
    group. ``text_sha256`` is null for rows that the refinement settled earlier,
    unless ``all_digests`` asks for it. Other columns of ``docs`` are not read. An
    empty table gives an empty result.
    """
    rows = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    keyed = rows.select(
        ROW,
        "doc_id",
        "text",
        F.length(filled("text")).alias("chars"),
        F.octet_length(normalised("text")).alias("size"),
        F.xxhash64(F.substring(normalised("text"), 1, prefix_chars)).alias("prefix"),
    )
    keys = snapshot(keyed.select(ROW, "doc_id", "chars", "size", "prefix"))

    sizes = snapshot(keys.groupBy("size").count().filter("count > 1").select("size"))
    pairs = keys.join(sizes, "size", "left_semi").groupBy("size", "prefix").count().filter("count > 1")
    slots = snapshot(pairs.select(_slot().alias("slot")).distinct()).withColumn("alive", F.lit(True))

    digest = F.sha2(normalised("text"), 256).alias("text_sha256")
    read = keyed.withColumn("slot", _slot()).join(F.broadcast(slots), "slot", "left" if all_digests else "inner")
    hashed = snapshot(read.select(ROW, "doc_id", "chars", digest, "alive"))

    alive = hashed.filter("alive")
    first = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(ROW).alias("row")))
    groups = snapshot(
        alive.groupBy("text_sha256")
        .agg(F.count("*").alias("n"), first.alias("first"))
        .filter("n > 1")
        .select("text_sha256", "n", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"))
    )
    grouped = alive.join(groups, "text_sha256", "left").select(
        ROW,
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first_row") == F.col(ROW), F.lit(True)).alias("kept"),
        "text_sha256",
    )
    if all_digests:
        settled = hashed.filter("alive is null").select(ROW, "doc_id", "text_sha256")
    else:
        settled = keys.withColumn("slot", _slot()).join(F.broadcast(slots), "slot", "left_anti")
        settled = settled.select(ROW, "doc_id", F.lit(None).cast("string").alias("text_sha256"))
    single = settled.select(
        ROW, "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return grouped.unionByName(single)
