"""Labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, with_row_key
from tidemark.session import snapshot

#: Labelled rows that a classifier is fitted on at most.
SAMPLE_ROWS = 20_000


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(``doc_id``, ``text``, ``label``) of the usable labelled documents, at most ``sample_rows`` of them.

    Labels are 0 or 1; other values, nulls and rows without a document are left
    out. The sample is taken by a hash of the id over all labels, so it is the same
    whenever it is taken. Each label row counts with one document, the first of
    those with its id, so rows stay bounded whatever ids repeat; an id with two
    labels counts once with each. Only ids and row keys, whose number is bounded,
    are joined with the texts.
    """
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).select(F.col("doc_id").cast("long"), F.col(label_col).cast("int").alias("label"))
    ids = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    present = known.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = F.broadcast(snapshot(present.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)).withColumn("__label", F.monotonically_increasing_id()))
    first = ids.join(chosen, "doc_id").groupBy("__label", "label").agg(F.min(ROW).alias(ROW))
    keys = F.broadcast(snapshot(first.select(ROW, "label")))
    texts = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return texts.join(keys, ROW).select("doc_id", "text", "label")
