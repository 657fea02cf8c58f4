import zlib

from pyspark.sql import functions as F

from keyweave.llm.sharding import assign_shards, write_shards
from tests.llm.conftest import ODD


def brute(rows, n):
    rows = sorted(((r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())), r[0], len((r[1] or "").encode()) + 8) for r in rows)
    total, done, slots, out = sum(r[2] for r in rows), 0, {}, []
    for (_, _, crc), key, size in rows:
        shard = min(n - 1, (2 * done + size) * n // (2 * total))
        out.append((key, size, crc, "bytes", shard, slots.setdefault(shard, 0), None))
        slots[shard] += 1
        done += size
    return sorted(out, key=str)


def test_against_plain_python(spark, documents, document_rows):
    made = assign_shards(documents.repartition(5), 24)
    assert made.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted((tuple(r) for r in made.collect()), key=str) == brute(document_rows, 24)
    sizes = [r.s for r in made.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 2 * max(len((r.text or "").encode()) + 8 for r in document_rows)


def test_odd_rows(odd, no_documents):
    assert sorted((tuple(r) for r in assign_shards(odd, 4).collect()), key=str) == brute(ODD, 4)
    assert assign_shards(no_documents, 4).count() == 0


def test_a_third_of_the_rows_have_one_key(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    made = assign_shards(df, 3).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert [(r.n, r.m, r.d) for r in made] == [(300, 299, 300)] * 3


def test_written_shards(spark, odd, tmp_path):
    write_shards(odd, 3, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(ODD) and set(back.columns) == set(odd.columns)
    assert [r[0] for r in back.select("text").distinct().collect()].count(None) == 1
