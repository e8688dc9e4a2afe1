"""CSV files as tables, and extracts back to files."""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, DataFrameReader, Observation, SparkSession, functions as F, types as T

from tidemark.contracts import CONTRACTS

log = logging.getLogger(__name__)


def table_name(stem: str) -> str:
    """A view name from a file name: lower case, other characters as ``_``, no leading digit."""
    name = re.sub(r"[^a-z0-9]", "_", stem.strip().lower())
    return f"t_{name}" if name[:1].isdigit() else name


def _contract_types(name: str) -> dict[str, T.DataType]:
    """Types of the columns of a contract table, also under their other names; none for other tables."""
    contract = CONTRACTS.get(name)
    if contract is None:
        return {}
    known = {f.name: f.dataType for f in contract.schema.fields}
    for canonical, aliases in contract.aliases.items():
        known.update({alias: known[canonical] for alias in aliases if alias not in known})
    return known


def _default_schema(spark: SparkSession, path: str, name: str) -> T.StructType | None:
    """The contract's types in the file's own column order; columns that the contract does not know have inferred types."""
    known = _contract_types(name)
    header = _reader(spark).csv(path).columns if known else []
    if not header:
        return None
    if all(column in known for column in header):
        return T.StructType([T.StructField(column, known[column]) for column in header])
    inferred = _reader(spark).option("inferSchema", True).csv(path).schema
    return T.StructType([T.StructField(f.name, known.get(f.name, f.dataType)) for f in inferred.fields])


def _reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("header", True)


#: Column that holds the text of a row with a value that does not fit.
UNFIT = "_unfit"


def _name_of(path: str) -> str:
    stem = path.rstrip("/").rsplit("/", 1)[-1]
    return table_name(re.sub(r"\.csv$", "", stem, flags=re.IGNORECASE))


def load_csv(
    spark: SparkSession, path: str, name: str | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """One CSV file (or folder of parts) with a header, registered as a view.

    Without a schema the contract of that table name gives the types, and nothing
    but the header is read before the table is, unless the file has columns that the
    contract does not know: theirs are inferred. A value that does not fit its
    column's type is null and its row stays; :func:`unfit_rows` hands such rows out
    as text. Types of tables without a contract are inferred.
    """
    name = name or _name_of(path)
    if schema is None:
        schema = _default_schema(spark, path, name)
    reader = _reader(spark)
    table = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if not table.columns:
        raise ValueError(f"{path} has no columns")
    table.createOrReplaceTempView(name)
    return table


def unfit_rows(spark: SparkSession, path: str, name: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of a CSV table with a value that does not fit its column's type: the columns as read, and the row's text as ``_unfit``.

    Arguments are those of :func:`load_csv`; tables whose types are inferred have none.
    """
    if schema is None:
        schema = _default_schema(spark, path, name or _name_of(path))
    if schema is None:
        table = _reader(spark).option("inferSchema", True).csv(path)
        return table.withColumn(UNFIT, F.lit(None).cast("string")).filter("false")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    checked = T.StructType([*schema.fields, T.StructField(UNFIT, T.StringType())])
    read = _reader(spark).schema(checked).option("columnNameOfCorruptRecord", UNFIT).csv(path)
    # Spark parses the columns that are asked for. This asks for all, so a row that is unfit in any of them shows.
    everything = F.length(F.concat_ws("", *[F.col(f"`{f.name}`").cast("string") for f in schema.fields])) >= 0
    return read.filter(F.col(UNFIT).isNotNull() & everything)


def list_csv(spark: SparkSession, directory: str) -> list[str]:
    """Paths of the ``*.csv`` entries of a folder on any file system Spark can read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(directory)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        log.warning("folder not found: %s", directory)
        return []
    return sorted(str(s.getPath()) for s in fs.listStatus(folder) if s.getPath().getName().lower().endswith(".csv"))


def load_csv_dir(
    spark: SparkSession, directory: str, schemas: Mapping[str, T.StructType | str] | None = None
) -> dict[str, DataFrame]:
    """Every ``*.csv`` of a folder as a table; a file that cannot be read is logged and skipped."""
    tables = {}
    for path in list_csv(spark, directory):
        name = table_name(path.rsplit("/", 1)[-1][: -len(".csv")])
        try:
            tables[name] = load_csv(spark, path, name, (schemas or {}).get(name))
        except (PySparkException, Py4JError, ValueError) as error:
            log.error("skipped %s: %s", path, error)
    return tables


def write_extract(
    table: DataFrame,
    path: str,
    file_format: str = "csv",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> str:
    """Write a normalized table; returns its path, or '' when it has no rows, and then leaves ``path`` as it was.

    The rows are counted by the write itself, so the plan runs once. Where ``path``
    holds something that is to be overwritten, the new extract is written beside it
    and takes its place afterwards. Partition spend and events by their date column:
    the date windows of the operators then prune whole folders. Rows of one
    partition value are brought together before writing, so that tasks do not leave
    one small file each per value; the rebalance splits a value that holds too many
    rows for one task.
    """
    spark = table.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    present = files.exists(target)
    if present and mode == "ignore":
        return path
    beside = hadoop.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}") if present and mode == "overwrite" else target
    if partition_by:
        table = table.hint("rebalance", *partition_by)
    written = Observation()
    writer = table.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("append" if mode == "append" else "error").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(beside.toString())
    if not written.get["rows"]:
        if not (present and mode == "append"):
            files.delete(beside, True)
        return ""
    if present and mode == "overwrite":
        files.delete(target, True)
        if not files.rename(beside, target):
            raise OSError(f"could not move {beside.toString()} to {path}")
    return path
