"""Arrow schemas and data to Spark and back."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

#: What Spark does not read, and the type that holds all its values.
_WIDER = {
    pa.uint8(): pa.int16(),
    pa.uint16(): pa.int32(),
    pa.uint32(): pa.int64(),
    pa.uint64(): pa.decimal128(20, 0),
    pa.float16(): pa.float32(),
    pa.date64(): pa.date32(),
    pa.time32("s"): pa.time64("us"),
    pa.time32("ms"): pa.time64("us"),
}

#: Bytes of a value in a fixed-width row; None for types of no fixed width.
_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8, T.DayTimeIntervalType: 8, T.YearMonthIntervalType: 4,
}


def wider(kind: pa.DataType) -> pa.DataType:
    """The type as which Spark can read kind; raises TypeError where there is none."""
    if pa.types.is_dictionary(kind):
        return wider(kind.value_type)
    if pa.types.is_union(kind) or pa.types.is_run_end_encoded(kind) or kind == pa.month_day_nano_interval():
        raise TypeError(f"Arrow type {kind} has no Spark type")
    if pa.types.is_decimal(kind) and kind.precision > 38:
        raise TypeError(f"Arrow type {kind} has more than 38 digits")
    if pa.types.is_struct(kind):
        return pa.struct([f.with_type(wider(f.type)) for f in kind])
    if pa.types.is_fixed_size_list(kind) or pa.types.is_list(kind):
        return pa.list_(wider(kind.value_type))
    if pa.types.is_large_list(kind):
        return pa.large_list(wider(kind.value_type))
    if pa.types.is_string_view(kind):
        return pa.string()
    if pa.types.is_binary_view(kind):
        return pa.binary()
    return _WIDER.get(kind, kind)


def spark_type(kind: pa.DataType) -> T.DataType:
    known = wider(kind)
    if pa.types.is_timestamp(known) and known.tz is None:
        return T.TimestampNTZType()
    return from_arrow_type(known)


def to_spark_schema(schema: pa.Schema | T.StructType) -> T.StructType:
    """Names, types and nullability of an Arrow schema. Lengths of fixed-size types are kept as metadata."""
    if isinstance(schema, T.StructType):
        return schema
    if not isinstance(schema, pa.Schema):
        raise TypeError(f"expected a schema, got {type(schema).__name__}")
    fields = []
    for f in schema:
        length = {"length": f.type.byte_width} if pa.types.is_fixed_size_binary(f.type) and not pa.types.is_decimal(f.type) else {"length": f.type.list_size} if pa.types.is_fixed_size_list(f.type) else {}
        fields.append(T.StructField(f.name, spark_type(f.type), f.nullable, length))
    return T.StructType(fields)


def to_arrow(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def to_frame(spark: SparkSession, data: DataFrame | pa.Table | pa.RecordBatch) -> DataFrame:
    """A DataFrame of data. Arrow types that Spark does not read are cast to the next wider one first."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if not isinstance(data, pa.Table):
        raise TypeError(f"expected a DataFrame, Table or RecordBatch, got {type(data).__name__}")
    target = to_spark_schema(data.schema)
    names = [f"c{i}" for i in range(data.num_columns)]  # duplicate names are allowed in Arrow
    cast = pa.table([c.cast(wider(c.type)) for c in data.columns], names=names)
    if not data.num_columns:
        return spark.range(data.num_rows).select()
    made = spark.createDataFrame(cast, T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, target)]))
    return made.toDF(*data.column_names)


def record_batches(df: DataFrame, rows_per_batch: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of df in order, a partition at a time, as record batches; the driver holds few at once.

    Without rows_per_batch batches are as large as tasks make them; else all but the last have that many rows.
    """
    schema = to_arrow_schema(df.schema)

    def serialise(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    def arriving() -> Iterator[pa.RecordBatch]:
        for row in df.mapInArrow(serialise, "batch binary").toLocalIterator(prefetchPartitions=True):
            yield from pa.ipc.open_stream(bytes(row.batch))

    from keyweave.operators.batching import regrouped

    batches = (pa.RecordBatch.from_arrays(b.columns, names=schema.names) for b in arriving() if len(b))
    return batches if rows_per_batch is None else regrouped(batches, rows_per_batch)


def data_width(kind: T.DataType) -> int:
    """Bytes of a value of fixed width; raises NotImplementedError for others."""
    if isinstance(kind, T.DecimalType):
        return 16
    for known, width in _WIDTHS.items():
        if type(kind) is known:
            return width
    raise NotImplementedError(f"{kind.simpleString()} has no fixed width")


def row_width(schema: T.StructType, alignment: int = 8) -> int:
    """Bytes of an encoded row: values, a validity bit each, rounded up to the alignment."""
    width = sum(data_width(f.dataType) for f in schema) + -(-len(schema) // 8)
    return -(-width // alignment) * alignment


def ensure_compatible(item: T.StructType, desired: T.StructType) -> None:
    """Raises ValueError unless both have the same types by position; names and nullability don't matter."""
    given, wanted = [[f.dataType for f in schema] for schema in (item, desired)]
    if given == wanted:
        return
    differing = [str(i) for i, pair in enumerate(zip_longest(given, wanted)) if pair[0] != pair[1]]
    listed = lambda kinds: "(" + ", ".join(k.simpleString() for k in kinds) + ")"
    raise ValueError(f"Schema mismatch: {listed(given)} instead of {listed(wanted)}, apart at {', '.join(differing)}")


def num_bytes(df: DataFrame, validity: bool = True) -> DataFrame:
    """n_bytes: what the frame's fixed-width columns take in memory, with a validity bit for each value of a nullable column."""
    width = sum(data_width(f.dataType) for f in df.schema)
    nullable = sum(f.nullable for f in df.schema) if validity else 0
    return df.agg((F.count("*") * width + F.ceil(F.count("*") / 8) * nullable).cast("long").alias("n_bytes"))
