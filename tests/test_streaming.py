import pyarrow as pa

from keyweave import Accumulator, KeyedTable
from keyweave.streaming.micro_batches import accumulate_stream, insert_stream, probe_stream


def test_streams(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "cast(id * 2 AS int) AS v").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = KeyedTable(pa.schema([("k", pa.int64())]), pa.schema([("b", pa.int32())]), pa.schema([("v", pa.int32())]), spark=spark)
    insert_stream(table, stream).option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start().awaitTermination()
    assert table.rows.count() == 100
    joined = probe_stream(table, stream).writeStream.format("memory").queryName("joined").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    joined.awaitTermination()
    assert spark.sql("SELECT count(*), count_if(b = v) FROM joined").first()[:] == (100, 100)
    got = []
    out = Accumulator(pa.schema([("k", pa.int64()), ("v", pa.int32())]), 30, got.append)
    accumulate_stream(out, stream).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    out.finish()
    assert [len(b) for b in got] == [30, 30, 30, 10]
