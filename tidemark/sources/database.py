"""Tables of a relational database through JDBC."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession

FETCH_SIZE = 10_000


def jdbc_options(url: str) -> dict[str, str]:
    """JDBC url, user and password from a ``postgresql://user:password@host:port/db`` url.

    A ``jdbc:`` url is passed through unchanged.
    """
    if url.startswith("jdbc:"):
        return {"url": url}
    parts = urlsplit(url)
    if parts.scheme not in ("postgres", "postgresql") or not parts.hostname:
        raise ValueError("expected a postgresql:// or jdbc: url")
    host = parts.hostname + (f":{parts.port}" if parts.port else "")
    query = f"?{urlencode(parse_qsl(parts.query))}" if parts.query else ""
    options = {"url": f"jdbc:postgresql://{host}{parts.path}{query}"}
    if parts.username:
        options["user"] = parts.username
    if parts.password:
        options["password"] = parts.password
    return options


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower_bound: object = None,
    upper_bound: object = None,
    num_partitions: int | None = None,
    **options: str,
) -> DataFrame:
    """A table read in parallel ranges of ``partition_column``.

    Filters, columns, aggregates and limits are pushed into the database. Rows
    outside the bounds are read too: the bounds only shape the ranges. Without
    a partition column one task reads the table.
    """
    settings: dict[str, object] = {
        "dbtable": table,
        "fetchsize": FETCH_SIZE,
        "sessionInitStatement": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY",
        "pushDownAggregate": True,
        **jdbc_options(url),
        **options,
    }
    if not str(settings["url"]).startswith("jdbc:postgresql:"):
        settings.pop("sessionInitStatement")
    if partition_column is not None:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("a partition column needs both bounds and the number of partitions")
        settings.update(
            partitionColumn=partition_column, lowerBound=lower_bound, upperBound=upper_bound, numPartitions=num_partitions
        )
    return spark.read.format("jdbc").options(**settings).load()


@dataclass(frozen=True)
class JdbcTable:
    """A table of a database and the ranges in which it is read."""

    url: str
    table: str
    partition_column: str | None = None
    lower_bound: object = None
    upper_bound: object = None
    num_partitions: int | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        """The table, in parallel ranges where a partition column is given."""
        ranges = (self.partition_column, self.lower_bound, self.upper_bound, self.num_partitions)
        return load_jdbc(spark, self.url, self.table, *ranges)


def list_jdbc_tables(spark: SparkSession, url: str, schema: str = "public") -> list[str]:
    """Names of the tables and views of a database schema, in order."""
    listed = load_jdbc(spark, url, "information_schema.tables")
    names = listed.filter((listed["table_schema"] == schema) & listed["table_type"].isin("BASE TABLE", "VIEW")).select("table_name")
    return sorted(row.table_name for row in names.collect())
