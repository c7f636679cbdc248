"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow.session import materialize

__all__ = ["materialize", "portable", "rounded"]


def portable(df: DataFrame) -> DataFrame:
    """Plain column types that any engine's result can be compared with."""

    def plain(field: T.StructField):
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.DateType):
            column = column.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            column = F.array_join(column, ",")
        return column.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
