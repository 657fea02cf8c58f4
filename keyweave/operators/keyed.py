"""KeyedTable: an append-only multimap from keys to payloads, probed by lookup and inner join.

A table is a lazy union of what was inserted. Joins are plain equi-joins, so the planner picks the
strategy, prunes columns down to the scans and splits skewed keys while running.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.operators.columns import combine, merge_tables
from keyweave.plans.frames import broadcast_if_small, checkpointed
from keyweave.plans.trace import traced
from keyweave.sources.arrow import data_width, ensure_compatible, record_batches, row_width, to_frame, to_spark_schema
from keyweave.sources.storage import parse_storage

Data = DataFrame | pa.Table | pa.RecordBatch

#: Unions deeper than this are cut by writing the rows out.
DEPTH = 64


def default_rows_per_batch(schema: T.StructType) -> int:
    """Rows of a joined batch: 16 MiB of values, at least 2048. Values without fixed width count 16 bytes."""

    def width(kind: T.DataType) -> int:
        try:
            return 0 if isinstance(kind, T.BooleanType) else data_width(kind)
        except NotImplementedError:
            return 16

    return max(2048, (16 << 20) // max(1, sum(width(f.dataType) for f in schema)))


class KeyedTable:
    """Rows of key and payload columns under a fixed schema; one key may have many rows.

    match="keys" asks all key columns to be equal; match="hash" the first only, and then the key
    columns of results are those of the table. null_keys="match" makes null equal null, "drop" lets
    null keys find nothing. Schemas are compared by position and type; names of results are those of
    the schemas given here, and must differ, unless suffixes (build, probe) part the payloads'.
    """

    def __init__(
        self,
        key_schema: pa.Schema | T.StructType,
        build_payload_schema: pa.Schema | T.StructType,
        probe_payload_schema: pa.Schema | T.StructType | None = None,
        storage_descriptor: str | None = None,
        *,
        spark: SparkSession | None = None,
        match: str = "keys",
        null_keys: str = "match",
        strict_capacity: bool = False,
        suffixes: tuple[str, str] | None = None,
    ):
        if match not in ("keys", "hash") or null_keys not in ("match", "drop"):
            raise ValueError("match is keys or hash, null_keys is match or drop")
        self.spark = spark or SparkSession.active()
        self.keys, self.build_payload = to_spark_schema(key_schema), to_spark_schema(build_payload_schema)
        self.probe_payload = None if probe_payload_schema is None else to_spark_schema(probe_payload_schema)
        if not len(self.keys):
            raise ValueError("a table needs a key column")
        self.storage = parse_storage(storage_descriptor)
        self.match, self.null_keys, self.strict_capacity = match, null_keys, strict_capacity
        self.build_schema = T.StructType([*self.keys, *self.build_payload])
        self.probe_schema = None if self.probe_payload is None else T.StructType([*self.keys, *self.probe_payload])
        b, p = suffixes or ("", "")
        self._names = [*self.keys.names, *(n + b for n in self.build_payload.names)], [n + p for n in (self.probe_payload or T.StructType()).names]
        named = self._names[0] + self._names[1]
        if twice := sorted({n for n in named if named.count(n) > 1}):
            raise ValueError(f"column {twice[0]!r} would appear twice; give suffixes")
        self._rows: DataFrame | None = None
        self._depth = 0
        self._kept = None

    @property
    def rows(self) -> DataFrame:
        """All rows inserted so far: keys, then build payload."""
        if self._rows is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField(n, f.dataType) for n, f in zip(self._names[0], self.build_schema)]))
        return self._rows.toDF(*self._names[0])

    def insert(self, key_values: Data) -> KeyedTable:
        """Appends rows of key and payload columns. Nothing runs until the table is probed, unless capacity is strict."""
        with traced("insert"):
            new = to_frame(self.spark, key_values)
            ensure_compatible(new.schema, self.build_schema)
            new = new.toDF(*[f"_kw_b{i}" for i in range(len(self.build_schema))])
            rows, depth = (new, 1) if self._rows is None else (self._rows.union(new), self._depth + 1)
            if depth > DEPTH:
                rows, depth = checkpointed(rows), 1
            if self.strict_capacity and self.storage.size_bytes is not None:
                needed = rows.count() * row_width(self.build_schema)
                if needed > self.storage.size_bytes:
                    raise RuntimeError(f"{needed} bytes do not fit the {self.storage.size_bytes} bytes of the storage")
            self.release()
            self._rows, self._depth = rows, depth
        return self

    def insert2(self, keys: Data, values: Data) -> KeyedTable:
        """Appends rows whose keys and payloads come as two frames, aligned by position."""
        return self.insert(self._beside(keys, values, self.build_payload))

    def _beside(self, keys: Data, values: Data, payload: T.StructType) -> DataFrame:
        """Keys and values as one frame; Arrow data meet before they leave the driver, frames by position."""
        if not isinstance(keys, DataFrame) and not isinstance(values, DataFrame):
            ensure_compatible(to_spark_schema(keys.schema), self.keys)
            ensure_compatible(to_spark_schema(values.schema), payload)
            return to_frame(self.spark, merge_tables(keys, values))
        keys, values = to_frame(self.spark, keys), to_frame(self.spark, values)
        ensure_compatible(keys.schema, self.keys)
        ensure_compatible(values.schema, payload)
        return combine(keys, values)

    def keep(self) -> KeyedTable:
        """Keeps the rows for further probes: in memory, spilling to disk, or written as Parquet under the storage's path.

        Written rows outlive the executors; their files are the caller's to remove.
        """
        if self._rows is None:
            return self
        if not self.storage.in_memory:
            path = f"{self.storage.path.rstrip('/')}/rows-{uuid.uuid4().hex}"
            self._rows.write.parquet(path)
            self._rows, self._depth = self.spark.read.parquet(path), 1
        elif self._kept is None:
            self._kept = self._rows.persist(self.storage.level)
        return self

    def release(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def _condition(self, build: list[Column], probe: list[Column]) -> Column:
        pairs = list(zip(build, probe))[: 1 if self.match == "hash" else len(self.keys)]
        out = None
        for b, p in pairs:
            same = b.eqNullSafe(p) if self.null_keys == "match" else b == p
            out = same if out is None else out & same
        return out

    def _joined(self, probe: DataFrame, n_payload: int, strategy: str | None, preserve_probe_order: bool) -> DataFrame:
        n_keys = len(self.keys)
        probe = probe.toDF(*[f"_kw_p{i}" for i in range(n_keys + n_payload)])
        order = "_kw_order"
        if preserve_probe_order:
            probe = probe.withColumn(order, F.monotonically_increasing_id())
        build = self._rows if self._rows is not None else self.rows.toDF(*[f"_kw_b{i}" for i in range(len(self.build_schema))])
        hinted = build
        if strategy == "broadcast":
            hinted = broadcast_if_small(build)
        elif strategy is not None:
            hinted = build.hint(strategy)
        on = self._condition([build[f"_kw_b{i}"] for i in range(n_keys)], [probe[f"_kw_p{i}"] for i in range(n_keys)])
        joined = hinted.join(probe, on, "inner")
        if preserve_probe_order:
            joined = joined.orderBy(order)
        build_columns = [F.col(f"_kw_b{i}").alias(n) for i, n in enumerate(self._names[0])]
        probe_columns = [F.col(f"_kw_p{n_keys + i}").alias(self._names[1][i]) for i in range(n_payload)]
        return joined.select(*build_columns, *probe_columns)

    def lookup(self, keys: Data, *, strategy: str | None = None, preserve_probe_order: bool = False) -> DataFrame:
        """Keys and build payload of every match of every probe row; repeated probe keys repeat their matches."""
        with traced("lookup"):
            probe = to_frame(self.spark, keys)
            ensure_compatible(probe.schema, self.keys)
            return self._joined(probe, 0, strategy, preserve_probe_order)

    def inner_join(
        self, key_values: Data, callback: Callable[[pa.RecordBatch], None] | None = None, rows_per_batch: int = -1, *, strategy: str | None = None, preserve_probe_order: bool = False
    ) -> DataFrame:
        """Keys, build payload, probe payload of every match. Lazy; a callback gets the rows as record batches at once.

        Batches have rows_per_batch rows, -1: default_rows_per_batch, the last one what is left; without
        a match there is none. strategy hints at a join: broadcast (only if the bytes of all values fit),
        shuffle_hash or merge.
        """
        if self.probe_schema is None:
            raise ValueError("the table has no probe payload schema, so it can be looked up but not joined")
        with traced("inner_join"):
            probe = to_frame(self.spark, key_values)
            ensure_compatible(probe.schema, self.probe_schema)
            joined = self._joined(probe, len(self.probe_payload), strategy, preserve_probe_order)
        if callback is not None:
            if rows_per_batch == 0 or rows_per_batch < -1:
                raise ValueError("rows_per_batch must be -1, or 1 or more")
            with traced("deliver"):
                for batch in record_batches(joined, default_rows_per_batch(joined.schema) if rows_per_batch == -1 else rows_per_batch):
                    callback(batch)
        return joined

    def inner_join2(self, keys: Data, values: Data, callback: Callable[[pa.RecordBatch], None] | None = None, rows_per_batch: int = -1, **options) -> DataFrame:
        """inner_join of keys and probe payloads that come as two frames, aligned by position."""
        if self.probe_payload is None:
            return self.inner_join(keys)
        return self.inner_join(self._beside(keys, values, self.probe_payload), callback, rows_per_batch, **options)

