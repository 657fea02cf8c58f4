"""Streams against keyed tables and accumulators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from keyweave.operators.batching import Accumulator
from keyweave.operators.keyed import KeyedTable
from keyweave.plans.frames import shared_dir


def probe_stream(table: KeyedTable, stream: DataFrame) -> DataFrame:
    """inner_join with a streaming probe side: a stream-static join, so no state is kept."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming frame")
    return table.inner_join(stream)


def insert_stream(table: KeyedTable, stream: DataFrame) -> DataStreamWriter:
    """A writer, to be started, that inserts each micro-batch; a batch that is replayed is inserted again."""
    return stream.writeStream.foreachBatch(lambda batch, _: table.insert(_settled(table, batch)) and None)


def accumulate_stream(accumulator: Accumulator, stream: DataFrame) -> DataStreamWriter:
    """A writer, to be started, that hands rows to the accumulator; call its finish when the stream has ended."""
    return stream.writeStream.foreachBatch(lambda batch, _: accumulator.insert(batch))


def _settled(table: KeyedTable, batch: DataFrame) -> DataFrame:
    """A micro-batch's rows in the table's own session, from a written table that outlives the batch."""
    path = f"{shared_dir(table.spark).rstrip('/')}/inserted-{uuid.uuid4().hex}"
    batch.write.parquet(path)
    return table.spark.read.parquet(path)
