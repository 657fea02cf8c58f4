"""Sorts that bring equal bags of rows into one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.sources.arrow import data_width


def sort_all(df: DataFrame) -> DataFrame:
    """By all columns, first to last, nulls first."""
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in df.columns])


def little_endian_hex(column: Column, kind: T.DataType) -> Column:
    """The value's bytes, lowest first, as hex digits; they compare as the bytes do. Null is all zero."""
    width = data_width(kind)
    if isinstance(kind, T.BooleanType):
        number = column.cast("int")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(column)
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(column)
    elif isinstance(kind, T.DoubleType):
        number = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.coalesce(column, F.lit(0.0))).cast("long")
    elif isinstance(kind, T.FloatType):
        number = F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), F.coalesce(column, F.lit(0.0).cast("float"))).cast("long")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        number = column
    else:
        raise NotImplementedError(f"{kind.simpleString()} has no byte order here")
    digits = F.lpad(F.hex(F.coalesce(number.cast("long"), F.lit(0))), 16, "0")
    return F.concat(*[F.substring(digits, 17 - 2 * (i + 1), 2) for i in range(width)])


def binary_keys(df: DataFrame) -> list[Column]:
    """The columns' bytes in schema order, then their validity, false first."""
    columns = [F.col(f"`{f.name}`") for f in df.schema]
    return [little_endian_hex(c, f.dataType) for c, f in zip(columns, df.schema)] + [c.isNotNull() for c in columns]


def sort_all_binary(df: DataFrame) -> DataFrame:
    """By the bytes of the rows as a fixed-width row table would hold them: 256 comes before 1, null just before 0."""
    return df.orderBy(*binary_keys(df))
