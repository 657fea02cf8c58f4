"""Contiguous shards of nearly equal bytes.

All rows get one global order; every partition adds up its own bytes; the prefix sums of these
totals (one row per partition) say where each partition begins; equal targets cut the line of
bytes into shards. One range shuffle of about 30 bytes a row; texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from keyweave.llm._common import checkpointed


def assign_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", overhead: int = 8, carry: bool = False) -> DataFrame:
    """One row per row of df: key, size, text_crc32, law, shard, slot, grown_shard.

    Rows are put in the order of (key, CRC of the text), nulls first. A row's size is the UTF-8
    bytes of its text plus overhead. A row whose bytes lie around the point p of all bytes B goes
    to shard floor(p * n_shards / B), p being its middle, so a shard is a contiguous run and
    differs from B / n_shards by at most the largest row. slot counts a shard's rows from 0.

    Null and empty texts have size overhead and CRC 0. A null key sorts first. Repeated rows
    and ties each keep a place of their own. A text larger than a shard's target leaves neighbouring
    shards short or empty. An empty table gives an empty result. Other columns are not looked at;
    carry adds the whole input row as the struct row.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        *([F.struct(*df.columns).alias("row")] if carry else []),
    )
    # The row's place in the input parts equal keys, so one key's rows need not meet in one task.
    order = ("doc_id", "text_crc32", "place")
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpointed(rows.drop("place"))

    totals = sorted(rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect())
    before_rows = dict(zip((t.part for t in totals), accumulate((t.n for t in totals), initial=0)))
    before_bytes = dict(zip((t.part for t in totals), accumulate((t.bytes for t in totals), initial=0)))
    total = sum(t.bytes for t in totals)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        n, done = before_rows.get(part, 0), before_bytes.get(part, 0)
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            ends = done + np.cumsum(sizes)
            shard = np.minimum((2 * ends - sizes) * n_shards // (2 * total), n_shards - 1)
            place = n + np.arange(len(sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(place)], names=[*batch.schema.names, "shard", "place"])
            if len(sizes):
                n, done = n + len(sizes), int(ends[-1])

    placed = rows.mapInArrow(cut, StructType([*rows.schema.fields, StructField("shard", IntegerType()), StructField("place", LongType())]))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows at most
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else [])
    )


def write_shards(df: DataFrame, n_shards: int, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes whole rows of df as Parquet under path/shard=N, in the shards of assign_shards.

    A column of df named shard gives way to the assigned one.
    """
    rows = assign_shards(df, n_shards, key, text, carry=True)
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c != "shard"]
    rows.select(*kept, "shard").write.partitionBy("shard").mode("errorifexists").parquet(path)
