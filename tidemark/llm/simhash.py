"""SimHash fingerprints of word shingles and the groups of near copies they link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, with_row_key
from tidemark.llm.components import components
from tidemark.llm.trie_join import trie_links
from tidemark.session import snapshot

SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Words of a shingle, and bits in which linked fingerprints differ at most.
SHINGLE_WORDS, MOST_BITS = 3, 2


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; of the whole sequence if it is shorter.

    A-Z count as lower case; words are separated by ASCII white space; no words, no hashes.
    """
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) > size:
        starts, ends = starts[: 1 - size], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(octets) < 64:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0)
    else:
        counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(counts * 2 > len(octets), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int) -> int:
    """The fingerprint as a signed 64-bit number; zero for a text without words."""
    found = majority(shingle_hashes(text, size))
    return found - (1 << 64) if found >> 63 else found


def fingerprints(docs: DataFrame, id_col: str, text_col: str = "text", *, size: int = SHINGLE_WORDS) -> DataFrame:
    """(``id``, ``print``) of each row; null texts are empty."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), size) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tasks, "id long, print long")


def linked(prints: DataFrame, budget: int) -> DataFrame:
    """``prints`` with ``component``: the smallest id that links lead to.

    Equal fingerprints are one node with their smallest id. Rows whose fingerprint
    has no id at all get a null component.
    """
    nodes = snapshot(prints.groupBy("print").agg(F.min("id").alias("id")).filter("id is not null"))
    rows = nodes.select("id", F.lit(0).alias("family"), F.col("print").alias("pattern"))
    found = components(snapshot(trie_links(rows, 64, budget)))
    labels = nodes.join(found, nodes["id"] == found["node"], "left").select("print", F.coalesce("component", "id").alias("component"))
    return prints.join(snapshot(labels), "print", "left")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE_WORDS, budget: int = MOST_BITS) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    64-bit fingerprints of ``size``-word shingles link at ``budget`` or fewer
    differing bits, exactly. Null, empty and blank texts have the fingerprint zero,
    which links like any other; a text of fewer words is one shingle. Rows of one id
    are one document; rows without an id take the component of equal fingerprints,
    null if there is none. Other columns are not read. An empty table gives an empty
    result.
    """
    found = linked(snapshot(fingerprints(docs, id_col, text_col, size=size)), budget)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SHINGLE_WORDS, budget: int = MOST_BITS) -> DataFrame:
    """``__row`` of the rows of ``docs`` (see ``with_row_key``) that are not the one that stays of their component.

    Rows are grouped by ``simhash_components``, every row by itself. Of each group
    the row with the smallest id stays (null last; of equal ids the first). Null,
    empty and blank texts are one group. An empty table gives no rows.
    """
    found = simhash_components(with_row_key(docs), ROW, text_col, size=size, budget=budget)
    ids = with_row_key(docs.select(F.col(id_col).alias("doc_id")))
    grouped = snapshot(found.select(F.col("doc_id").alias(ROW), "component_id").join(ids, ROW))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(ROW).alias("row")))
    kept = grouped.groupBy("component_id").agg(F.count("*").alias("n"), least.alias("first")).filter("n > 1")
    several = snapshot(kept.select("component_id", F.col("first.row").alias("first_row")))
    return grouped.join(several, "component_id").filter(F.col(ROW) != F.col("first_row")).select(ROW)
