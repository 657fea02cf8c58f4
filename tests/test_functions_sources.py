import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import keyweave
from keyweave.functions import bits, equality, hashing
from keyweave.plans import trace
from keyweave.sources import arrow, datagen
from keyweave.sources.storage import BlockOptions, parse_storage


def flags(df):
    return [r.eq for r in df.collect()]


def test_column_equality(spark):
    df = spark.createDataFrame([(1, 1), (2, 100), (None, 1000), (1000, 1000), (None, None)] * 3, "a short, b short").coalesce(1)
    assert flags(equality.column_equality(df, "a", "b")) == [True, False, False, True, True] * 3
    assert flags(equality.column_equality(df.withColumn("b", F.col("b").cast("long")), "a", "b")) == [False] * 15
    assert not equality.all_equal(df, "a", "b").first().eq
    assert equality.all_equal(df.withColumn("s", F.col("b") != 100).where("a is not null"), "a", "b", "s").first().eq
    floats = spark.createDataFrame([(0.0, -0.0), (float("nan"), float("nan")), (None, None), (None, 0.0)], "a double, b double").coalesce(1)
    assert flags(equality.column_equality(floats, "a", "b")) == [True, True, True, False]
    assert flags(equality.column_equality(floats, "a", "b", bitwise=True)) == [False, True, True, False]


def test_frames_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "i int, s string")
    assert equality.frames_equal(a, a.orderBy(F.desc("i")).toDF("p", "q"))
    assert not equality.frames_equal(a, a.distinct())
    assert equality.frames_equal(a, a, ordered=True)
    assert not equality.frames_equal(a, a.orderBy(F.desc("i")), ordered=True)
    assert not equality.frames_equal(a, a.limit(2), ordered=True)
    assert not equality.frames_equal(a, a.select("s", "i"))
    assert equality.schemas_equal(a.schema, a.schema) and not equality.schemas_equal(a.schema, a.toDF("p", "q").schema)


def test_nulls_and_bits(spark):
    df = spark.createDataFrame([(True, True, 1), (True, False, None), (False, True, 3)], "a boolean, b boolean, v int").coalesce(1)
    assert equality.has_nulls(df, "v").first()[0] and not equality.has_nulls(df, "a").first()[0]
    assert not equality.all_set(df, "a").first()[0]
    a, b = F.col("a"), F.col("b")
    row = df.agg(bits.count_set(a), bits.count_both_set(a, b), bits.count_set(bits.left_only(a, b)), bits.count_set(bits.either(a, b)), bits.count_set(bits.left_or_not(a, b)), bits.count_set(bits.inverted(a))).first()
    assert tuple(row) == (2, 1, 1, 3, 2, 1)
    assert tuple(bits.validity_counts(df, "v", "a").first()) == (2, 2)
    assert [r.v for r in bits.reversed_rows(df).collect()] == [3, None, 1]
    assert bits.validity_equal(df, "a", "b").first()[0] and not bits.validity_equal(df, "a", "v").first()[0]
    assert bits.aligned(13, 8) == 16
    assert spark.range(1).select(bits.popcount(F.lit(7)), bits.aligned(F.lit(9), 8)).first()[:] == (3, 16)


def test_hashes(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (5, 1)], "k long, s short")
    assert [r[0] for r in df.select(hashing.identity_hash(df, ["k", "s"])).collect()] == [1, 2, 5]
    for keys in ([], ["s"]):
        with pytest.raises(ValueError):
            hashing.identity_hash(df, keys)
    assert df.select(hashing.key_hash("k", "s")).distinct().count() == 3
    build = spark.createDataFrame(list(zip([1, 5, 17, 17, 3, 0], range(6))), "hash long, row_id long")
    probe = spark.createDataFrame([(0, 17), (1, 5), (2, 100)], "probe_idx long, hash long")
    assert sorted(tuple(r) for r in hashing.probe_hashes(build, probe).collect()) == [(0, 2), (0, 3), (1, 1)]


ARROW = [
    (pa.uint8(), 200, "smallint"), (pa.uint16(), 60_000, "int"), (pa.uint32(), 4_000_000_000, "bigint"), (pa.uint64(), 1 << 63, "decimal(20,0)"), (pa.int8(), -1, "tinyint"),
    (pa.float16(), 1.5, "float"), (pa.date64(), dt.date(2020, 1, 2), "date"), (pa.time32("s"), dt.time(1, 2, 3), "time(6)"), (pa.bool_(), True, "boolean"),
    (pa.timestamp("us"), dt.datetime(2020, 1, 2), "timestamp_ntz"), (pa.timestamp("us", "UTC"), None, "timestamp"), (pa.decimal128(10, 2), None, "decimal(10,2)"),
    (pa.dictionary(pa.int8(), pa.string()), "a", "string"), (pa.list_(pa.uint8()), [1, 2], "array<smallint>"), (pa.binary(3), b"abc", "binary"), (pa.large_string(), "x", "string"),
]


@pytest.mark.parametrize(("kind", "value", "name"), ARROW, ids=[str(a[0]) for a in ARROW])
def test_arrow_types(spark, kind, value, name):
    data = pa.table({"v": pa.array([value, None], kind)})
    df = arrow.to_frame(spark, data)
    assert df.schema["v"].dataType.simpleString() == name
    assert arrow.to_spark_schema(data.schema)["v"].dataType == df.schema["v"].dataType
    assert df.count() == 2


def test_arrow_refusals():
    for kind in (pa.sparse_union([pa.field("a", pa.int8())]), pa.month_day_nano_interval(), pa.run_end_encoded(pa.int32(), pa.int8()), pa.decimal256(60, 2)):
        with pytest.raises(TypeError):
            arrow.spark_type(kind)
    with pytest.raises(TypeError):
        arrow.to_spark_schema([1])
    with pytest.raises(NotImplementedError):
        arrow.data_width(arrow.spark_type(pa.string()))
    assert arrow.to_spark_schema(pa.schema([("f", pa.binary(3))]))["f"].metadata == {"length": 3}


def test_round_trip_and_bytes(spark):
    data = pa.table({"x": pa.array([7, 42, None], pa.int32())})
    df = arrow.to_frame(spark, data)
    assert df.toArrow().column(0).to_pylist() == [7, 42, None]
    assert arrow.num_bytes(df).first()[0] == 13
    assert arrow.to_frame(spark, data.slice(1, 2).to_batches()[0]).count() == 2
    assert arrow.to_arrow(df.schema).names == ["x"]
    assert sum(len(b) for b in arrow.record_batches(spark.range(50).repartition(3))) == 50


def test_storage():
    assert parse_storage().size_bytes == 64 << 20 and parse_storage().in_memory and parse_storage().page_size == 1
    file = parse_storage("file:///tmp/x?direct=true")
    assert (file.kind, file.path, file.direct, file.page_size) == ("file", "/tmp/x", True, 4096)
    for wrong in ("ram:///", "ram:///?size_bytes=1&size_bytes=2", "ram:///?size_bytes=x", "mem:///", "file:///x?direct=maybe", "file:///x?size=1", "ram:///?size_bytes=1&x=2"):
        with pytest.raises(ValueError):
            parse_storage(wrong)
    assert BlockOptions().resolved().block_size_bytes == int(0.8 * (1 << 20))
    assert BlockOptions(total_size_bytes=1 << 30).resolved().total_size_bytes == 1 << 30
    for wrong in (BlockOptions(block_size_bytes=-1), BlockOptions(total_size_bytes=0), BlockOptions(10, 5)):
        with pytest.raises(ValueError):
            wrong.resolved()


def test_generator(spark):
    made = datagen.Generator(42).field(4, "a").n_fields(2, 3).field(8)
    df = made.rows(spark, 100)
    assert df.dtypes == [("a", "int"), ("f1", "binary"), ("f2", "binary"), ("f3", "bigint")]
    again = made.rows(spark, 100, 7)
    assert equality.frames_equal(df, again)
    assert {len(r.f1) for r in df.collect()} == {3}
    assert sum(w for _, w in datagen.Generator(1).fields_of_total_width(64).fields) == 64
    build, probe = datagen.join_inputs(spark, 1000, 5000, keys=2, overlap=0.6)
    assert 2800 < build.join(probe, ["key0", "key1"]).count() < 3200
    assert sorted(r.id for r in datagen.shuffled(spark.range(20), 1, "id").collect()) == list(range(20))


def test_trace(spark, capsys):
    trace.clear_tracing()
    with trace.traced("outer"), trace.traced("inner"):
        pass
    assert set(trace.tracing()) == {"outer", "inner"}
    keyweave.print_tracing()
    keyweave.print_tracing_histogram(10)
    assert "Duration(ns)" in (out := capsys.readouterr().out) and "#" in out
    assert "keyweave" in keyweave.info(spark)
    keyweave.set_log_level(spark, "warn")
    with pytest.raises(ValueError):
        keyweave.set_log_level(spark, "loud")
    spark.sparkContext.setLogLevel("ERROR")
