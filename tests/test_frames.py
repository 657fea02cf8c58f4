import math

import pytest
from pyspark.sql import functions as F

from keyweave import KeyedTable
from keyweave.functions import bits, hashing
from keyweave.operators import columns
from keyweave.plans import frames
from keyweave.plans.api_queries import QUERIES
from keyweave.plans.frames import measured_bytes, with_position
from keyweave.plans.trace import rows_as_text
from keyweave.sources import datagen


def positions(df, *order):
    return [tuple(r) for r in with_position(df, "p", *order).orderBy("p").collect()]


def test_copies_of_a_row_get_the_positions_of_all(spark, monkeypatch):
    monkeypatch.setattr(frames, "COPIES", 16)  # pieces of a hot row
    rows = [(i % 3, None if i % 3 == 1 else "x") for i in range(300)] + [(9, "once")]
    got = positions(spark.createDataFrame(rows, "k int, s string").repartition(7), "k")
    assert [r[-1] for r in got] == list(range(301))
    assert [r[:2] for r in got] == sorted(rows, key=lambda r: r[0])


def test_positions_tell_odd_values_apart(spark):
    df = spark.createDataFrame([(1, 0.0), (1, -0.0), (1, None), (1, math.nan), (1, 0.0)], "k int, v double")
    assert sorted(str(r[1]) for r in positions(df, "k")) == ["-0.0", "0.0", "0.0", "None", "nan"]
    nulls = spark.createDataFrame([(1, None, 5), (1, 5, None), (1, None, None)], "k int, a int, b int")
    assert sorted(str(r[1:3]) for r in positions(nulls, "k")) == ["(5, None)", "(None, 5)", "(None, None)"]


def test_positions_of_rows_that_change_or_have_no_hash(spark):
    changing = spark.range(50).withColumn("r", F.rand())
    assert [r[-1] for r in positions(changing, "r")] == list(range(50))
    maps = spark.range(5).select("id", F.create_map(F.lit("a"), "id").alias("m"))
    assert [(r[0], r[1], r[2]) for r in positions(maps, F.desc("id"))] == [(4 - i, {"a": 4 - i}, i) for i in range(5)]
    clashing = spark.range(3).select(F.col("id").alias("_id.x"), F.col("id").alias("other"))
    assert [r[-1] for r in positions(clashing, "other")] == [0, 1, 2]


def test_wide_rows_are_not_kept(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("wide"))
    plan = with_position(df, "p", "id")._jdf.queryExecution().optimizedPlan().toString()
    kept = [line for line in plan.splitlines() if "LogicalRDD" in line]
    assert kept and not any("wide" in line for line in kept)


def shuffles(spark, run):
    """Rows that the tasks of run() wrote to shuffles, from the status store."""
    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    before = {(s.stageId(), s.attemptId()) for s in stages()}
    run()
    return sum(s.shuffleWriteRecords() for s in stages() if (s.stageId(), s.attemptId()) not in before)


@pytest.mark.parametrize("names", [["k", "id"], ["k"], ["-k"]])
def test_narrow_rows_move_once(spark, names):
    """Rows of a few numbers are sorted themselves: one row in a shuffle for each, not one each for hash, position and row."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 5000).alias("k"), "id")
    order = [F.desc(n[1:]) if n.startswith("-") else n for n in names]
    assert shuffles(spark, lambda: with_position(df, "p", *order).write.format("noop").mode("overwrite").save()) < 20_500
    assert [r[-1] for r in positions(df, *order)] == list(range(20_000)) and positions(df, *order) == positions(df.repartition(7), *order)


def test_slices_far_out_go_by_positions(spark, monkeypatch):
    df = spark.range(1000)
    near = [r.id for r in columns.slice_view(df, 990, 20, "id").collect()]
    monkeypatch.setattr(columns, "FIRST", 10)
    assert near == sorted(r.id for r in columns.slice_view(df, 990, 20, "id").collect()) == list(range(990, 1000))
    assert [r.id for r in columns.slice_view(df.coalesce(1), 3, 2).collect()] == [3, 4]


def test_reversed_by_name_is_one_sort(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    made = bits.reversed_rows(df, "v")
    assert made._jdf.queryExecution().executedPlan().toString().count("Sort ") == 1
    assert [r.v for r in made.collect()] == [2, 1, None]
    assert [r.v for r in bits.reversed_rows(df, F.desc("v")).collect()] == [None, 1, 2]


def test_bytes_are_measured(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2], ["y" * 500], {"k": "z" * 300}, (1, "w" * 200))] * 10, "s string, a array<int>, b array<string>, m map<string,string>, t struct<i:int,s:string>")
    assert 20_000 < measured_bytes(df) < 23_000
    assert measured_bytes(df.limit(0)) == 0
    assert measured_bytes(spark.createDataFrame([(None, None)], "s string, a array<string>")) == 32


def test_only_small_sides_are_broadcast(spark):
    keys = spark.createDataFrame([], "k long")
    payload = spark.createDataFrame([], "s string")
    probe = spark.range(10).select(F.col("id").alias("k"))
    plans = []
    for length in (20, 20_000):
        table = KeyedTable(keys.schema, payload.schema, spark=spark)
        table.insert(spark.range(2000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), length).alias("s")))
        plans.append(table.lookup(probe, strategy="broadcast")._jdf.queryExecution().analyzed().toString())
    assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        frames.shared_dir(Session())


def test_pages_go_on_where_the_last_ended(spark):
    build = spark.createDataFrame([(7, i) for i in range(5)] + [(8, 9)], "hash long, row_id long")
    probe = spark.createDataFrame([(0, 7), (1, 6), (2, 8), (3, 7)], "probe_idx long, hash long")
    matches = hashing.probe_hashes(build, probe)
    pages, last = [], None
    while page := [tuple(r) for r in hashing.next_page(matches, 3, last).collect()]:
        pages.append(page)
        last = page[-1]
    want = [(0, i) for i in range(5)] + [(2, 9)] + [(3, i) for i in range(5)]
    assert sum(pages, []) == want and [len(p) for p in pages] == [3, 3, 3, 2]
    assert [tuple(r) for r in hashing.probe_pages(matches, 3).orderBy("page", "probe_idx", "row_id").select("probe_idx", "row_id").collect()] == want


def test_pages_of_a_probe_are_those_of_all_its_matches(spark, monkeypatch):
    """Repeated and absent places, null and unmatched hashes, hashes of more rows than a page; by turns, and all at once."""
    build = spark.createDataFrame([(i % 5 if i % 11 else None, i) for i in range(60)], "hash long, row_id long")
    probe = spark.createDataFrame([(i // 2 if i > 1 else None, [7, 3, None, 9, 9, 9, 9, 1][i % 8]) for i in range(64)], "probe_idx long, hash long")
    matches = hashing.probe_hashes(build, probe)
    asked = [(3, None), (3, (3, 11)), (3, (8, 0)), (3, (31, 56)), (1000, (20, 11))]
    want = [hashing.next_page(matches, *a).collect() for a in asked]
    assert [len(w) for w in want[:3]] == [3, 3, 3]
    for most, more in ((1 << 20, 2), (0, 2)):
        monkeypatch.setattr(hashing, "MOST_PROBES", most)
        monkeypatch.setattr(hashing, "MORE_PROBES", more)
        assert [hashing.probe_page(build, probe, *a).collect() for a in asked] == want
    with pytest.raises(ValueError):
        hashing.probe_page(build, probe, 0)


def test_resumed_pages_do_not_move_all_probes(spark, tmp_path):
    """Beside the positions of orders, a page moves few rows: 60 matches don't take a shuffle of events, or of orders, for each page."""
    spark.range(40_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 900).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(30_000).select(F.col("id").alias("event_id"), (F.col("id") % 1000).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles(spark, lambda: QUERIES["hash_probe_resumed"](spark, str(tmp_path)).collect()) < 42_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stacked_joins_have_tasks_of_their_own(spark, sf_dir):
    """A task of the kept tables' union sorts for one of its two joins, not for both."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert QUERIES["storage_kept"](spark, sf_dir).rdd.getNumPartitions() == 8
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_bits_and_draws(spark):
    v = F.lit(-1).cast("long")
    row = spark.range(1).select(bits.with_bit(v, 63, False), bits.bit_is_set(v, 63), bits.with_bit(F.lit(0).cast("long"), 63), bits.aligned_down(F.lit(-9), 8)).first()
    assert tuple(row) == ((1 << 63) - 1, True, -(1 << 63), -16)
    assert bits.aligned_down(13, 8) == 8
    drawn = [r.value for r in datagen.random_ints(spark, 10_000, 5, -3, 3).collect()]
    assert set(drawn) == set(range(-3, 3)) and abs(sum(drawn) / 10_000 + 0.5) < 0.1
    assert drawn == [r.value for r in datagen.random_ints(spark, 10_000, 5, -3, 3, 9).orderBy("id").collect()]
    assert datagen.Generator(1).field(4, "a").field(3).schema == datagen.Generator(1).field(4, "a").field(3).rows(spark, 1).schema
    for total in (1, 7, 64, 1000):
        widths = [w for _, w in datagen.Generator(total).fields_of_total_width(total, 5).fields]
        assert sum(widths) == total and max(widths) <= 5
    assert rows_as_text(spark.createDataFrame([(1, None), (2, "x" * 100)], "i int, s string").coalesce(1)).split("\n")[:2] == ["i, s", "1, -"]
