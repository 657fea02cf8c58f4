"""Columns and rows by position: select, concatenate, zip, slice, take."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.plans.frames import with_position

POSITION = "_kw_position"
#: Slices that end before this row are taken without numbering all rows.
FIRST = 1 << 20


def _at(n: int, indices: Sequence[int]) -> list[int]:
    if bad := [i for i in indices if not 0 <= i < n]:
        raise IndexError(f"there is no column {bad[0]} among {n}")
    return list(indices)


def select_schema(schema: T.StructType, indices: Sequence[int]) -> T.StructType:
    return T.StructType([schema[i] for i in _at(len(schema), indices)])


def select_view(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    """The columns at indices, in that order; repeats are allowed and names may repeat."""
    names = [f"c{i}" for i in range(len(df.columns))]
    picked = _at(len(names), indices)
    return df.toDF(*names).select(*[F.col(names[i]) for i in picked]).toDF(*[df.columns[i] for i in picked])


def all_columns_from(left: T.StructType, right: T.StructType) -> T.StructType:
    """Left's fields, then right's; equal names stay twice."""
    return T.StructType([*left.fields, *right.fields])


def combine(left: DataFrame, right: DataFrame, left_order: Sequence[str | Column] = (), right_order: Sequence[str | Column] = ()) -> DataFrame:
    """Row i of left beside row i of right, in the given orders or as the rows come; ValueError if one has more rows."""
    names = [*left.columns, *right.columns]
    left = with_position(left.toDF(*[f"l{i}" for i in range(len(left.columns))]) if not left_order else left, POSITION, *left_order)
    right = with_position(right.toDF(*[f"r{i}" for i in range(len(right.columns))]) if not right_order else right, POSITION, *right_order)
    left = left.toDF(*[f"_kw_l{i}" for i in range(len(left.columns) - 1)], POSITION)
    right = right.toDF(*[f"_kw_r{i}" for i in range(len(right.columns) - 1)], "_kw_position2")
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"cannot combine {n} rows with {m} rows")
    joined = left.join(right, left[POSITION] == right["_kw_position2"]).drop(POSITION, "_kw_position2")
    return joined.toDF(*names)


def merge_tables(left: pa.Table | pa.RecordBatch, right: pa.Table | pa.RecordBatch) -> pa.Table:
    """Arrow data side by side, batches or tables in any mixture."""
    if left.num_rows != right.num_rows:
        raise ValueError(f"cannot combine {left.num_rows} rows with {right.num_rows} rows")
    return pa.table([*left.columns, *right.columns], names=[*left.schema.names, *right.schema.names])


def slice_view(df: DataFrame, offset: int, length: int, *order_by: str | Column) -> DataFrame:
    """Rows offset to offset + length of the order, or as the rows come, as far as there are any. Any offset is allowed.

    A slice that ends within the first FIRST rows keeps only that many of each task; one further on goes by positions.
    """
    if offset < 0 or length < 0:
        raise ValueError("offset and length must not be negative")
    if offset + length <= FIRST:
        return (df.orderBy(*order_by) if order_by else df).offset(offset).limit(length)
    placed = with_position(df, POSITION, *order_by)
    return placed.where((F.col(POSITION) >= offset) & (F.col(POSITION) < offset + length)).drop(POSITION)


def slice_array(column: str | Column, offset: int, length: int) -> Column:
    return F.slice(column, offset + 1, length)


def take(df: DataFrame, indices: DataFrame, *order_by: str | Column, pos: str = "pos", row_id: str = "row_id") -> DataFrame:
    """pos and the row of df at position row_id, for every row of indices; repeats repeat, absent positions give nothing.

    Results carry pos, by which to order them.
    """
    placed = with_position(df, POSITION, *order_by)
    wanted = indices.select(F.col(pos).alias("pos"), F.col(row_id).cast("long").alias("_kw_row"))
    return wanted.join(placed, F.col("_kw_row") == F.col(POSITION)).drop("_kw_row", POSITION)
