import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyweave.operators import columns, sorting
from keyweave.operators.rows import RowTable
from keyweave.plans.frames import with_position
from keyweave.sources.arrow import row_width, to_spark_schema


def test_select_and_concatenate(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b long, a2 string".replace("string", "int"))
    assert columns.select_view(df, [2, 0, 0]).collect()[0] == (3, 1, 1)
    assert columns.select_schema(df.schema, [0, 2]).names == ["a", "a2"]
    assert columns.all_columns_from(df.schema, df.schema).names == ["a", "b", "a2"] * 2
    with pytest.raises(IndexError):
        columns.select_view(df, [3])


def test_positions_are_dense_and_stable(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id").repartition(13)
    placed = with_position(df, "p", "k", F.desc("id")).orderBy("p").collect()
    assert [r.p for r in placed] == list(range(1000))
    assert [(r.k, -r.id) for r in placed] == sorted((r.k, -r.id) for r in placed)
    assert with_position(spark.range(0), "p", "id").count() == 0


def test_slice_take_zip(spark):
    df = spark.range(1024).select((F.col("id") * 2).alias("v"))
    assert [r.v for r in columns.slice_view(df, 9, 10, "v").collect()] == list(range(18, 38, 2))
    assert columns.slice_view(df, 1020, 10, "v").count() == 4
    wanted = spark.createDataFrame([(0, 5), (1, 5), (2, 0), (3, 5000)], "pos long, row_id long")
    assert [tuple(r) for r in columns.take(df, wanted, "v").orderBy("pos").collect()] == [(0, 10), (1, 10), (2, 0)]
    other = spark.range(1024).select((-F.col("id")).alias("w"))
    zipped = columns.combine(df, other, ["v"], [F.desc("w")]).collect()
    assert len(zipped) == 1024 and all(r.v == -2 * r.w for r in zipped)
    with pytest.raises(ValueError):
        columns.combine(df, spark.range(3))
    assert spark.createDataFrame([([1, 2, 3, 4],)], "a array<int>").select(columns.slice_array("a", 1, 2)).first()[0] == [2, 3]


def test_merge_tables():
    left, right = pa.table({"a": [1, 2]}), pa.RecordBatch.from_pydict({"a": [3, 4]})
    assert columns.merge_tables(left, right).column_names == ["a", "a"]
    with pytest.raises(ValueError):
        columns.merge_tables(left, pa.table({"b": [1]}))


def test_row_table(spark):
    df = spark.createDataFrame([(1, None, None), (2, 100, None), (None, 1000, None)], "a byte, b long, c float")
    table = RowTable(df.schema)
    assert table.append(df) == 0
    assert table.append(df) == 3
    wanted = spark.createDataFrame([(0, 2), (1, 0), (2, 4), (3, 4)], "pos int, row_id long")
    assert [tuple(r)[1:] for r in table.take(wanted).orderBy("pos").collect()] == [(None, 1000, None), (1, None, None), (2, 100, None), (2, 100, None)]
    table.reset()
    assert table.n_rows == 0
    wide = spark.createDataFrame([(None,) * 50, tuple(range(50)), (None,) * 50, (2,) * 50], ", ".join(f"c{i} byte" for i in range(50)))
    many = RowTable(wide.schema)
    many.append(wide)
    assert many.take(spark.createDataFrame([(0, 1)], "pos int, row_id int")).first()[1:] == tuple(range(50))


def test_row_width():
    assert row_width(to_spark_schema(pa.schema([("k", pa.int64()), ("x", pa.int32()), ("y", pa.int16())]))) == 16
    assert row_width(to_spark_schema(pa.schema([("k", pa.int64()), ("b", pa.bool_())])), 4096) == 4096


def test_sorts(spark):
    rows = [(1, 1), (2, 100), (0, 1000), (1000, 57), (0, 500), (0, None)]
    orders = [[tuple(r) for r in sorting.sort_all(spark.createDataFrame(p, "a long, b short")).collect()] for p in (rows, rows[::-1], rows[3:] + rows[:3])]
    assert orders[0] == orders[1] == orders[2] == sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1]))
    binary = [r[0] for r in sorting.sort_all_binary(spark.createDataFrame([(v,) for v in (1, 256, -1, 0, 1000, None)], "a long")).collect()]
    assert binary == [None, 0, 256, 1, 1000, -1]
    doubles = [1.0, -0.0, 0.0, 2.5]
    expected = sorted(doubles, key=lambda v: __import__("struct").pack("<d", v))
    got = [r[0] for r in sorting.sort_all_binary(spark.createDataFrame([(v,) for v in doubles], "a double")).collect()]
    assert list(map(str, got)) == list(map(str, expected))
