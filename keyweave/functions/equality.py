"""Equality that counts nulls as values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.plans.frames import with_position


def _bits(column: Column, kind: T.DataType) -> Column:
    name, method = {T.DoubleType: ("java.lang.Double", "doubleToRawLongBits"), T.FloatType: ("java.lang.Float", "floatToRawIntBits")}[type(kind)]
    return F.when(column.isNotNull(), F.reflect(F.lit(name), F.lit(method), F.coalesce(column, F.lit(0).cast(kind))))


def equal(left: Column, right: Column, kind: T.DataType | None = None, bitwise: bool = False) -> Column:
    """Null equals null and nothing else. bitwise, for floats of type kind: 0.0 differs from -0.0, NaN equals only the same NaN."""
    if bitwise and isinstance(kind, (T.FloatType, T.DoubleType)):
        left, right = _bits(left, kind), _bits(right, kind)
    return left.eqNullSafe(right)


def column_equality(df: DataFrame, left: str, right: str, bitwise: bool = False, name: str = "eq") -> DataFrame:
    """df with a flag per row. Columns of different types are never equal."""
    a, b = df.schema[left].dataType, df.schema[right].dataType
    return df.withColumn(name, equal(F.col(left), F.col(right), a, bitwise) if a == b else F.lit(False))


def all_equal(df: DataFrame, left: str, right: str, selection: str | None = None, bitwise: bool = False) -> DataFrame:
    """One row, eq: whether the columns agree everywhere, or wherever selection is true."""
    flagged = column_equality(df, left, right, bitwise, "_kw_eq")
    if selection is not None:
        flagged = flagged.where(F.col(selection))
    return flagged.agg(F.coalesce(F.bool_and("_kw_eq"), F.lit(True)).alias("eq"))


def frames_equal(left: DataFrame, right: DataFrame, ordered: bool = False, left_order=(), right_order=()) -> bool:
    """Same types by position, same number of rows, and equal rows: position by position, or as bags."""
    if [f.dataType for f in left.schema] != [f.dataType for f in right.schema]:
        return False
    names = [f"_kw_{i}" for i in range(len(left.columns))]
    if not ordered:
        a, b = left.toDF(*names), right.toDF(*names)
        signed = a.withColumn("_kw_n", F.lit(1)).unionByName(b.withColumn("_kw_n", F.lit(-1)))
        return signed.groupBy(*names).agg(F.sum("_kw_n").alias("n")).where("n != 0").isEmpty()
    a, b = with_position(left, "_kw_p", *left_order), with_position(right, "_kw_q", *right_order)
    a, b = a.toDF(*names, "_kw_p"), b.toDF(*[f"{n}r" for n in names], "_kw_q")
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"{n}r"))
    return a.join(b, F.col("_kw_p") == F.col("_kw_q"), "full").where(~same | F.col("_kw_p").isNull() | F.col("_kw_q").isNull()).isEmpty()


def has_nulls(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(F.col(column).isNull()), F.lit(False)).alias("has_nulls"))


def all_set(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(F.coalesce(F.col(flag), F.lit(False))), F.lit(True)).alias("all_set"))


def schemas_equal(left: T.StructType, right: T.StructType) -> bool:
    """Names, types, nullability and metadata."""
    return left == right and [f.metadata for f in left] == [f.metadata for f in right]
