"""The corpus pipeline: toxicity, exact copies, near copies, secrets, packing.

Each stage takes the documents that the one before it kept. Decisions on rows are
small tables of row keys, so a stage that drops documents reads its texts a second
time instead of shuffling them, unless the dropped keys outgrow a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, packing, secrets, simhash, toxicity
from tidemark.llm.common import ROW, filled, id_remainder, table, with_row_key, without_rows
from tidemark.session import snapshot, use_local_scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model does not learn from a fifth of the labels."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(with_row_key(docs), model, id_col=ROW)
    toxic = snapshot(scored.filter("score >= 0.5").select(F.col("doc_id").alias(ROW)))
    return without_rows(docs, toxic)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return without_rows(docs, snapshot(exact_dedup.exact_groups(docs).filter("not kept").select(ROW)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash: fingerprints of three-word shingles within two bits."""
    return without_rows(docs, snapshot(simhash.near_copies(docs)))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in a text replaced; ``n_chars`` follows the text where it changed."""
    columns = docs.columns
    found = secrets.with_secrets(docs, prefix="__")
    text = secrets.redacted(filled("text"), F.col("__secrets"))
    hit = F.size("__secrets") > 0
    changed = found.withColumn("__text", F.when(hit, text).otherwise(F.col("text")))
    result = changed.withColumn("text", F.col("__text"))
    if "n_chars" in columns:
        length = F.length("__text").cast(docs.schema["n_chars"].dataType)
        result = result.withColumn("n_chars", F.when(hit, length).otherwise(F.col("n_chars")))
    return result.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in batches of 65,536 padded words."""
    return packing.pack_by_length(docs, packing.word_count("text"), spread_by=filled("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: Scores of a trained model decide which documents stay, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what a stage returns is written and read again."""
    use_local_scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = snapshot(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
