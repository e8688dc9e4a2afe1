"""Table catalog, profiling, freshness and contract checks.

A catalog is a mapping of table names to DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.contracts import CONTRACTS, DATE_COLUMNS, Contract
from tidemark.functions.dates import DateLike, days_before
from tidemark.functions.numeric import percent

Catalog = Mapping[str, DataFrame]
# Issue texts and the limits of the freshness grades in days.
MISSING_TABLE = "Missing canonical table."
MISSING_COLUMN = "Missing required column `{}`."
ALIASED_COLUMN = "Missing canonical column `{}` but alias detected."
FRESH_DAYS, STALE_DAYS = 2, 14

SHOWN_COLUMNS = 6
SAMPLES = 5
#: Items that a sketch of frequent values tracks per column, and characters of an item.
SKETCHED_ITEMS, SKETCHED_TEXT = 1_000, 100


def _stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def list_tables(catalog: Catalog) -> DataFrame:
    """Rows, number of columns and the first column names of each table.

    A bare row count is answered from Parquet footers.
    """
    frames = []
    for name, table in catalog.items():
        shown = ", ".join(table.columns[:SHOWN_COLUMNS])
        hidden = len(table.columns) - SHOWN_COLUMNS
        frames.append(
            table.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"),
                "row_count",
                F.lit(len(table.columns)).alias("column_count"),
                F.lit(shown + (f" (+{hidden} more)" if hidden > 0 else "")).alias("column_names"),
            )
        )
    return _stacked(frames)


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _exact_counts(table: DataFrame) -> DataFrame:
    """``position, row_count, nulls, distinct_count``, with values as 128-bit numbers.

    Two 64-bit hashes of its text stand for a value, so neither the aggregate nor
    its exchange holds texts; equal numbers of different values are as good as
    impossible (below 1e-18 for a billion values of a column).
    """
    pairs = []
    for i, name in enumerate(table.columns):
        text = _text(name)
        known = text.isNotNull()
        pairs.append(F.struct(F.lit(i + 1).alias("position"), F.when(known, F.xxhash64(text)).alias("h"), F.when(known, F.xxhash64(F.lit(i), text)).alias("g")))
    values = table.select(F.inline(F.array(*pairs))).groupBy("position", "h", "g").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("position").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("h").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("h").alias("distinct_count"),
    )


def _least_values(table: DataFrame) -> DataFrame:
    """``position, samples``: the first distinct values of each column as text, in order.

    Every task keeps no more than that many values per column, so what is exchanged
    does not grow with the table.
    """
    width = len(table.columns)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set[str]] = [set() for _ in range(width)]
        for batch in batches:
            for values, column in zip(held, batch.columns, strict=True):
                found = pc.drop_null(pc.unique(column))
                # UTF-8 sorts as bytes, as Spark compares texts.
                values.update(found.take(pc.array_sort_indices(found)).slice(0, SAMPLES).to_pylist())
                for extra in sorted(values, key=str.encode)[SAMPLES:]:
                    values.discard(extra)
        rows = [(i + 1, v) for i, values in enumerate(held) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], names=["position", "value"])

    texts = table.select(*[_text(name).alias(f"c{i}") for i, name in enumerate(table.columns)])
    least = texts.mapInArrow(tasks, "position int, value string").distinct()
    rank = F.row_number().over(Window.partitionBy("position").orderBy("value"))
    # The rank limit is applied within each partition first.
    first = least.withColumn("rank", rank).filter(F.col("rank") <= SAMPLES)
    return first.groupBy("position").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("samples"))


def _sketched(table: DataFrame) -> DataFrame:
    """``position, row_count, nulls, distinct_count, samples`` from sketches that merge: one pass, nothing exchanged but them.

    Distinct counts come from HyperLogLog, samples from sketches of frequent items:
    the most frequent values as far as the sketch can tell, the most frequent first.
    """
    measures = [F.count(F.lit(1)).alias("row_count")]
    rows = []
    for i, name in enumerate(table.columns):
        text = F.left(_text(name), F.lit(SKETCHED_TEXT))
        measures += [
            F.count(f"`{name}`").alias(f"n{i}"),
            F.approx_count_distinct(_text(name)).alias(f"d{i}"),
            F.expr(f"approx_top_k(left(cast(`{name}` AS string), {SKETCHED_TEXT}), {SAMPLES + 1}, {SKETCHED_ITEMS})").alias(f"s{i}"),
        ]
        known = F.slice(F.filter(F.transform(f"s{i}", lambda item: item["item"]), lambda item: item.isNotNull()), 1, SAMPLES)
        rows.append(
            F.struct(
                F.lit(i + 1).alias("position"),
                F.col("row_count"),
                (F.col("row_count") - F.col(f"n{i}")).alias("nulls"),
                F.col(f"d{i}").alias("distinct_count"),
                F.array_join(known, ", ").alias("samples"),
            )
        )
    return table.agg(*measures).select(F.inline(F.array(*rows)))


def profile_table(table: DataFrame, approx: bool = False) -> DataFrame:
    """``position, column_name, data_type, row_count, null_pct, distinct_count, samples`` per column.

    Values count by their text. The exact form counts 128-bit numbers of the values
    and takes the first distinct values as samples, in two passes over the table;
    ``approx`` takes sketches in one (see ``_sketched``).
    """
    columns = table.sparkSession.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(table.schema.fields)],
        "position int, column_name string, data_type string",
    )
    if approx:
        stats = _sketched(table)
    else:
        stats = _exact_counts(table).join(_least_values(table), "position", "left")
    zero = F.lit(0).cast("bigint")
    return columns.join(stats, "position", "left").select(
        "position",
        "column_name",
        "data_type",
        F.coalesce("row_count", zero).alias("row_count"),
        F.coalesce(percent(F.col("nulls"), F.col("row_count")), F.lit(0.0)).alias("null_pct"),
        F.coalesce("distinct_count", zero).alias("distinct_count"),
        F.coalesce("samples", F.lit("")).alias("samples"),
    )


def sample_rows(table: DataFrame, limit: int = 3) -> DataFrame:
    """The first rows of a table."""
    return table.limit(limit)


def format_schema(catalog: Catalog, approx: bool = False) -> DataFrame:
    """The schema of all tables as lines of text, in order of ``table_name, line``."""
    frames = []
    for name, table in catalog.items():
        profile = profile_table(table, approx)
        text = F.format_string(
            "| %s | %s | %s | %.1f%% | %s |", "column_name", "data_type", F.format_number("distinct_count", 0), "null_pct", "samples"
        )
        line = F.struct(F.col("position").alias("line"), text.alias("text"))
        # The first column's row also gives the head line: the number of rows is in it.
        head = F.struct(F.lit(0).alias("line"), F.format_string(f"TABLE: {name} (%s rows)", F.format_number("row_count", 0)).alias("text"))
        lines = F.when(F.col("position") == 1, F.array(head, line)).otherwise(F.array(line))
        frames.append(profile.select(F.lit(name).alias("table_name"), F.inline(lines)))
    return _stacked(frames)


def date_column(table: DataFrame) -> str | None:
    """The table's first column that goes by one of the known date names."""
    return next((name for name in table.columns if name in DATE_COLUMNS), None)


def freshness(catalog: Catalog, as_of: DateLike) -> DataFrame:
    """First and last date of each table with a date column, and how stale it is."""
    frames = []
    for name, table in catalog.items():
        column = date_column(table)
        if column is None:
            continue
        day = F.col(column) if dict(table.dtypes)[column] == "date" else F.col(column).try_cast("date")
        frames.append(
            table.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date")).select(
                F.lit(name).alias("table_name"), F.lit(column).alias("date_column"), "min_date", "max_date"
            )
        )
    if not frames:
        raise ValueError("no table has a date column")
    days = F.col("days_stale")
    return (
        _stacked(frames)
        .withColumn("days_stale", days_before(as_of, F.col("max_date")))
        .withColumn(
            "status",
            F.when(days.isNull(), "unknown")
            .when(days <= FRESH_DAYS, "fresh")
            .when(days <= STALE_DAYS, "stale")
            .otherwise("outdated"),
        )
    )


def source_date_range(catalog: Catalog, as_of: DateLike) -> DataFrame:
    """One row over several sources: first and last date and which of them are stale or outdated."""

    def listed(status: str) -> Column:
        names = F.collect_list(F.when(F.col("status") == status, F.col("table_name")))
        return F.array_join(F.array_sort(names), ", ").alias(f"{status}_tables")

    return freshness(catalog, as_of).agg(
        F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"), listed("stale"), listed("outdated")
    )


def contract_issues(catalog: Catalog, contracts: Mapping[str, Contract] = CONTRACTS) -> list[tuple[str, str, str]]:
    """``(table, severity, message)`` for missing tables, missing columns and columns of another type."""
    issues = []
    for name, contract in contracts.items():
        if name not in catalog:
            issues.append((name, "error", MISSING_TABLE))
            continue
        present = {field.name: field.dataType for field in catalog[name].schema.fields}
        for column in contract.required:
            if column in present:
                continue
            if any(alias in present for alias in contract.aliases.get(column, ())):
                issues.append((name, "warning", ALIASED_COLUMN.format(column)))
            else:
                issues.append((name, "error", MISSING_COLUMN.format(column)))
        for column, wanted in {**contract.required, **contract.optional}.items():
            found = present.get(column)
            if found is not None and found != wanted and not _compatible(found, wanted):
                issues.append((name, "info", f"Column `{column}` is {found.simpleString()}, not {wanted.simpleString()}."))
    return issues


def _compatible(found, wanted) -> bool:
    """Numbers may come in another numeric type, dates as timestamps."""
    numeric = ("int", "bigint", "double", "float", "decimal", "smallint", "tinyint")
    a, b = found.simpleString(), wanted.simpleString()
    return (a.startswith(numeric) and b.startswith(numeric)) or (b == "date" and a.startswith("timestamp"))


def validate_contracts(
    catalog: Catalog, as_of: DateLike, contracts: Mapping[str, Contract] = CONTRACTS
) -> DataFrame:
    """Contract issues and freshness of all tables in one result.

    The data set is ready when no row has severity ``error``. Schemas are
    checked without reading data; only freshness scans the date columns.
    """
    fresh = freshness(catalog, as_of).select(
        "table_name",
        F.when(F.col("status") == "fresh", "ok").otherwise("info").alias("severity"),
        F.concat_ws(
            " ", F.lit("Dates in"), F.col("date_column"), F.lit("up to"), F.col("max_date").cast("string"), F.lit("are"), "status"
        ).alias("message"),
    )
    issues = contract_issues(catalog, contracts)
    if not issues:
        return fresh
    return fresh.sparkSession.createDataFrame(issues, fresh.schema).unionByName(fresh)


def apply_contract_aliases(
    catalog: Catalog, contracts: Mapping[str, Contract] = CONTRACTS
) -> tuple[dict[str, DataFrame], list[tuple[str, str, str]]]:
    """The catalog with aliased columns under their canonical names, and the renames made.

    A canonical column that is missing takes the first of its aliases that is
    present. Renaming changes the plan only; no data is read.
    """
    renamed, changes = dict(catalog), []
    for name, contract in contracts.items():
        if name not in catalog:
            continue
        present, moves = list(catalog[name].columns), {}
        for canonical, aliases in contract.aliases.items():
            if canonical in present:
                continue
            alias = next((a for a in aliases if a in present), None)
            if alias is not None:
                moves[alias] = canonical
                present[present.index(alias)] = canonical
                changes.append((name, alias, canonical))
        if moves:
            renamed[name] = catalog[name].withColumnsRenamed(moves)
    return renamed, changes
