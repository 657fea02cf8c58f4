"""Re-batching: rows in groups of an exact size, order kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.operators.columns import take
from keyweave.plans.frames import with_position
from keyweave.sources.arrow import ensure_compatible, record_batches, to_spark_schema


def _checked(rows_per_batch: int) -> int:
    if rows_per_batch < 1:
        raise ValueError("rows_per_batch must be 1 or more")
    return rows_per_batch


def regrouped(batches: Iterable[pa.RecordBatch], rows_per_batch: int) -> Iterator[pa.RecordBatch]:
    """Batches of exactly rows_per_batch rows, the last one of what is left, if anything."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, rows_per_batch - count)
            held.append(part)
            count += len(part)
            batch = batch.slice(len(part))
            if count == rows_per_batch:
                yield _one(held)
                held, count = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def rebatch(df: DataFrame, rows_per_batch: int, *order_by: str | Column, batch_id: str = "batch_id") -> DataFrame:
    """df with batch_id: every rows_per_batch rows of the order have one, only the last may have fewer."""
    placed = with_position(df, "_kw_batch_row", *order_by)
    return placed.withColumn(batch_id, F.floor(F.col("_kw_batch_row") / _checked(rows_per_batch)).cast("long")).drop("_kw_batch_row")


def rebatch_indexed(df: DataFrame, indices: DataFrame, rows_per_batch: int, *order_by: str | Column, batch_id: str = "batch_id") -> DataFrame:
    """The rows of df at the positions row_id of indices, in the order of its column pos, with their batch_id."""
    return rebatch(take(df, indices, *order_by), rows_per_batch, "pos", batch_id=batch_id)


def rebatch_partitions(df: DataFrame, rows_per_batch: int) -> DataFrame:
    """df with its record batches regrouped within each partition; each partition may end with a short one."""
    _checked(rows_per_batch)
    return df.mapInArrow(lambda batches: regrouped(batches, rows_per_batch), df.schema)


class Accumulator:
    """Collects Arrow data, or frames, on the driver and calls back with batches of rows_per_batch rows."""

    def __init__(self, schema: pa.Schema | T.StructType, rows_per_batch: int, callback: Callable[[pa.RecordBatch], None]):
        self.schema, self.rows_per_batch, self.callback = to_spark_schema(schema), _checked(rows_per_batch), callback
        self._held: list[pa.RecordBatch] = []
        self._count = 0

    def insert(self, data: pa.RecordBatch | pa.Table | DataFrame) -> None:
        if isinstance(data, DataFrame):
            ensure_compatible(data.schema, self.schema)
            batches: Iterable[pa.RecordBatch] = record_batches(data)
        elif isinstance(data, (pa.RecordBatch, pa.Table)):
            ensure_compatible(to_spark_schema(data.schema), self.schema)
            batches = [data] if isinstance(data, pa.RecordBatch) else data.to_batches()
        else:
            raise TypeError(f"expected a DataFrame, Table or RecordBatch, got {type(data).__name__}")
        for batch in batches:
            self._insert(batch)

    def insert_range(self, data: pa.RecordBatch, start: int = 0, length: int = -1) -> None:
        """Inserts rows from start on, length of them or all the rest."""
        if not 0 <= start <= len(data):
            raise IndexError(f"there is no row {start} among {len(data)}")
        self.insert(data.slice(start, len(data) - start if length < 0 else length))

    def insert_indexed(self, data: pa.RecordBatch, indices: pa.Array) -> None:
        """Inserts the rows at indices, which may repeat."""
        self.insert(data.take(indices))

    def _insert(self, batch: pa.RecordBatch) -> None:
        while len(batch):
            part = batch.slice(0, self.rows_per_batch - self._count)
            self._held.append(part)
            self._count += len(part)
            batch = batch.slice(len(part))
            if self._count == self.rows_per_batch:
                self.finish()

    def finish(self) -> None:
        """Hands over what is left, if anything."""
        if self._held:
            held, self._held, self._count = self._held, [], 0
            self.callback(_one(held))
