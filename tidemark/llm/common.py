"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: A word: a run of anything else (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
#: Name of the row key; input columns of this name are refused.
ROW = "__row"
#: Setting of the least number of partitions of a file scan.
SPLITS = "spark.sql.files.minPartitionNum"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` with a key per row that also tells repeated rows apart.

    The key is the row's place in the scan, so ``df`` has to be a table (or
    anything else that yields the same rows in the same order when read again).
    Small tables are split by the number of cores; that number is pinned in the
    session, so that a scan after the loss of executors gives the same keys. A
    column of the key's name is refused.
    """
    if ROW in (c.lower() for c in df.columns):
        raise ValueError(f"the column name {ROW} is kept for row keys")
    spark = df.sparkSession
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, str(spark.sparkContext.defaultParallelism))
    return df.withColumn(ROW, F.monotonically_increasing_id())


def without_rows(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """``df`` without the rows whose keys ``dropped`` lists; both keys come from ``with_row_key`` of the same table."""
    return with_row_key(df).join(dropped.select(ROW), ROW, "left_anti").select(*df.columns)


def id_remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % divisor
