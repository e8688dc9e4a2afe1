"""Plain types for a result that leaves Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def report_types(df: DataFrame) -> DataFrame:
    """Decimals and floats as double, whole numbers as bigint, dates as ISO text.

    Operators keep native types; only a report or an extract for another
    system needs this.
    """
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        columns.append(column.alias(field.name))
    return df.select(*columns)
