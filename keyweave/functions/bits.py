"""What bitmap kernels mean for flag columns and for validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.operators.columns import take
from keyweave.plans.frames import with_position


def count_set(flag: Column) -> Column:
    return F.count_if(flag)


def count_both_set(left: Column, right: Column) -> Column:
    return F.count_if(left & right)


def both(left: Column, right: Column) -> Column:
    return left & right


def left_only(left: Column, right: Column) -> Column:
    return left & ~right


def either(left: Column, right: Column) -> Column:
    return left | right


def left_or_not(left: Column, right: Column) -> Column:
    return left | ~right


def inverted(flag: Column) -> Column:
    return ~flag


def validity_counts(df: DataFrame, left: str, right: str) -> DataFrame:
    """n_left and n_both: how many values of left, and of both columns in one row, are not null."""
    valid = F.col(left).isNotNull()
    return df.agg(count_set(valid).alias("n_left"), count_both_set(valid, F.col(right).isNotNull()).alias("n_both"))


def reversed_rows(df: DataFrame, *order_by: str | Column) -> DataFrame:
    """The rows, last position first. An order by names is one sort, downwards; other orders, and the order as read, go by positions."""
    if order_by and all(isinstance(c, str) for c in order_by):
        return df.orderBy(*[F.desc(c) for c in order_by])  # nulls, first upwards, come last
    return with_position(df, "_kw_position", *order_by).orderBy(F.desc("_kw_position")).drop("_kw_position")


def validity_equal(df: DataFrame, left: str, right: str) -> DataFrame:
    """eq: whether both columns are null in the same rows."""
    return df.agg(F.coalesce(F.bool_and(F.col(left).isNull() == F.col(right).isNull()), F.lit(True)).alias("eq"))


def indexed_copy(df: DataFrame, flag: str, indices: DataFrame, *order_by: str | Column) -> DataFrame:
    """pos and flag: the flag of the row at position row_id, for every row of indices."""
    keys = [c for c in order_by if isinstance(c, str) and c != flag]
    return take(df.select(flag, *keys), indices, *order_by).select("pos", flag)


def aligned(value: Column | int, to: int):
    """value rounded up to a multiple of to."""
    return -(-value // to) * to if isinstance(value, int) else (F.ceil(value / to) * to).cast("long")


def aligned_down(value: Column | int, to: int):
    """value rounded down to a multiple of to."""
    return value // to * to if isinstance(value, int) else value - F.pmod(value, F.lit(to))


def popcount(value: Column) -> Column:
    return F.bit_count(value)


def _mask(at: int) -> Column:
    if not 0 <= at < 64:
        raise ValueError("a long has bits 0 to 63")
    return F.lit((1 << at) - (1 << 64 if at == 63 else 0)).cast("long")


def bit_is_set(value: Column, at: int) -> Column:
    return value.bitwiseAND(_mask(at)) != 0


def with_bit(value: Column, at: int, flag: bool = True) -> Column:
    """value with the bit at that place set or cleared."""
    return value.bitwiseOR(_mask(at)) if flag else value.bitwiseAND(F.bitwise_not(_mask(at)))
