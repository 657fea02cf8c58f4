import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyweave import Accumulator, rebatch, rebatch_indexed, rebatch_partitions
from keyweave.operators.keyed import default_rows_per_batch
from keyweave.sources.arrow import to_spark_schema

SCHEMA = pa.schema([("x", pa.int32()), ("y", pa.int32())])
VALUES = [1, None, 2, None, 3, 4, None, 5, 6, 7]


def test_accumulator_keeps_order():
    got = []
    out = Accumulator(SCHEMA, 5000, got.append)
    one = pa.RecordBatch.from_arrays([pa.array(VALUES, pa.int32())] * 2, schema=SCHEMA)
    for _ in range(1200):
        out.insert(one)
    assert [len(b) for b in got] == [5000, 5000]
    out.finish()
    out.finish()
    assert [len(b) for b in got] == [5000, 5000, 2000]
    assert pa.Table.from_batches(got).column("x").to_pylist() == VALUES * 1200


def test_accumulator_ranges_indices_and_errors():
    got = []
    out = Accumulator(SCHEMA, 3, got.append)
    one = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int32())] * 2, schema=SCHEMA)
    out.insert_range(one, 8)
    out.insert_range(one, 1, 2)
    out.insert_indexed(one, pa.array([5, 5, 0]))
    out.finish()
    assert [b.column(0).to_pylist() for b in got] == [[8, 9, 1], [2, 5, 5], [0]]
    with pytest.raises(IndexError):
        out.insert_range(one, 11)
    with pytest.raises(ValueError, match="Schema mismatch"):
        out.insert(pa.table({"x": [1]}))
    with pytest.raises(ValueError):
        Accumulator(SCHEMA, 0, got.append)


@pytest.mark.parametrize(("n", "size", "counts"), [(12000, 5000, [5000, 5000, 2000]), (10000, 5000, [5000, 5000]), (0, 5000, []), (3, 1, [1, 1, 1])])
def test_rebatch(spark, n, size, counts):
    made = rebatch(spark.range(n).repartition(5), size, "id").groupBy("batch_id").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy("batch_id").collect()
    assert [r.n for r in made] == counts
    assert [r["first"] for r in made] == [i * size for i in range(len(counts))]


def test_accumulator_takes_frames(spark):
    got = []
    out = Accumulator(pa.schema([("id", pa.int64())]), 40, got.append)
    out.insert(spark.range(100))
    out.finish()
    assert [len(b) for b in got] == [40, 40, 20]
    assert [v for b in got for v in b.column(0).to_pylist()] == list(range(100))


def test_rebatch_indexed_and_partitions(spark):
    frame = spark.range(10).select((F.col("id") * 10).alias("v"))
    indices = spark.createDataFrame([(0, 3), (1, 3), (2, 9), (3, 99)], "pos long, row_id long")
    assert [tuple(r) for r in rebatch_indexed(frame, indices, 2, "v").orderBy("pos").collect()] == [(0, 30, 0), (1, 30, 0), (2, 90, 1)]
    assert rebatch_partitions(spark.range(100), 7).count() == 100


def test_default_rows_per_batch():
    joined = pa.schema([("key", pa.int64()), ("x", pa.int32()), ("y", pa.int16()), ("z", pa.int8())])
    assert default_rows_per_batch(to_spark_schema(joined)) == 1_118_481
    assert default_rows_per_batch(to_spark_schema(pa.schema([(f"c{i}", pa.int64()) for i in range(5000)]))) == 2048
