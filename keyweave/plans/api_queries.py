"""Registered queries for what callers see of the library beside joins: schemas, Arrow data, batches, flags, storage, traces.

What describes a schema, a descriptor or a trace has a row for each thing described.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import keyweave
from keyweave.functions import bits, equality, hashing
from keyweave.operators import batching, columns, rows
from keyweave.operators.keyed import KeyedTable, default_rows_per_batch
from keyweave.plans import trace
from keyweave.plans.frames import shared_dir, stacked, with_position
from keyweave.plans.queries import _read, _table, _types, mixed_sql
from keyweave.sources import arrow, datagen
from keyweave.sources.storage import BlockOptions, parse_storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _all(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(spark: SparkSession, made: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(made), schema)


# Schemas


def _described(table: str, **names: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"SELECT (row_number() OVER () - 1)::INT AS position, column_name AS name, CASE column_type {cases} ELSE column_type END AS type FROM (DESCRIBE SELECT * FROM {table})"


_SPARK_NAMES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "FLOAT[]": "array<float>"}
_ARROW_NAMES = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "double", "VARCHAR": "string"}


@query(_described("embeddings", **_SPARK_NAMES))
def schema_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arrow.to_spark_schema(arrow.to_arrow(_all(spark, sf_dir, "embeddings").schema))
    return _made(spark, ((i, f.name, f.dataType.simpleString()) for i, f in enumerate(found)), "position int, name string, type string")


@query(_described("part", **_ARROW_NAMES))
def schema_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arrow.to_arrow(_all(spark, sf_dir, "part").schema)
    return _made(spark, ((i, f.name, str(f.type)) for i, f in enumerate(found)), "position int, name string, type string")


@query(f"SELECT (position - position // 3 * 2)::INT AS position, name, type FROM ({_described('part', **_SPARK_NAMES)}) WHERE position IN (0, 1, 5) ORDER BY position")
def schema_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.select_schema(_all(spark, sf_dir, "part").schema, [0, 1, 5])
    return _made(spark, ((i if i < 2 else 3, f.name, f.dataType.simpleString()) for i, f in enumerate(found)), "position int, name string, type string")


@query(f"{_described('nation', **_SPARK_NAMES)} UNION ALL SELECT position + 3, name, type FROM ({_described('region', **_SPARK_NAMES)})")
def schema_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.all_columns_from(_all(spark, sf_dir, "nation").schema, _all(spark, sf_dir, "region").schema)
    return _made(spark, ((i, f.name, f.dataType.simpleString()) for i, f in enumerate(found)), "position int, name string, type string")


@query("SELECT * FROM (VALUES ('same', true, true), ('renamed', false, true), ('retyped', false, false), ('shorter', false, false)) v(change, equal, compatible)")
def schema_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _all(spark, sf_dir, "nation")
    changed = {"same": nation, "renamed": nation.toDF("a", "b", "c"), "retyped": nation.withColumn("n_nationkey", F.col("n_nationkey").cast("long")), "shorter": nation.drop("n_name")}

    def compatible(df: DataFrame) -> bool:
        try:
            arrow.ensure_compatible(df.schema, nation.schema)
        except ValueError:
            return False
        return True

    return _made(spark, ((k, equality.schemas_equal(df.schema, nation.schema), compatible(df)) for k, df in changed.items()), "change string, equal boolean, compatible boolean")


# Arrow data in and out


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def arrow_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and a record batch of the same rows."""
    data = _all(spark, sf_dir, "nation").toArrow()
    return arrow.to_frame(spark, data).unionAll(arrow.to_frame(spark, data.combine_chunks().to_batches()[0]))


_BATCHES = "SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 400 AS batch, c_custkey FROM customer"


@query(f"SELECT batch, count(*) AS n_rows, min(c_custkey) AS first, max(c_custkey) AS last FROM ({_BATCHES}) GROUP BY batch")
def batches_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer", "c_custkey").orderBy("c_custkey")
    got = ((i, len(b), b.column(0)[0].as_py(), b.column(0)[-1].as_py()) for i, b in enumerate(arrow.record_batches(customers, 400)))
    return _made(spark, got, "batch long, n_rows long, first long, last long")


@query(f"SELECT batch, count(*) AS n_rows, min(c_custkey) AS first, max(c_custkey) AS last FROM ({_BATCHES}) GROUP BY batch")
def accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    got: list[tuple] = []
    out = batching.Accumulator(pa.schema([("c_custkey", pa.int64())]), 400, lambda b: got.append((len(got), len(b), b.column(0)[0].as_py(), b.column(0)[-1].as_py())))
    out.insert(_read(spark, sf_dir, "customer", "c_custkey").orderBy("c_custkey"))
    out.finish()
    return _made(spark, got, "batch long, n_rows long, first long, last long")


@query("SELECT (row_number() OVER (ORDER BY piece, n_nationkey) - 1) // 7 AS batch, n_nationkey FROM (SELECT 0 AS piece, n_nationkey FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 1, n_nationkey FROM nation WHERE n_nationkey BETWEEN 3 AND 12)")
def accumulator_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 20 to the end, then ten from row 3 on."""
    nation = _read(spark, sf_dir, "nation", "n_nationkey").orderBy("n_nationkey").toArrow().combine_chunks().to_batches()[0]
    got: list[pa.RecordBatch] = []
    out = batching.Accumulator(nation.schema, 7, got.append)
    out.insert_range(nation, 20)
    out.insert_range(nation, 3, 10)
    out.finish()
    return _made(spark, ((i, v) for i, b in enumerate(got) for v in b.column(0).to_pylist()), "batch long, n_nationkey int")


@query("SELECT n_nationkey, n_name, r_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)")
def merge_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _read(spark, sf_dir, "nation", "n_nationkey", "n_name").orderBy("n_nationkey").limit(5).toArrow()
    right = _read(spark, sf_dir, "region", "r_name", "r_regionkey").orderBy("r_regionkey").select("r_name").toArrow()
    return arrow.to_frame(spark, columns.merge_tables(left, right.combine_chunks().to_batches()[0]))


_DELIVERED = "SELECT (row_number() OVER () - 1) // 1000 AS batch FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"SELECT batch, count(*) AS n_rows FROM ({_DELIVERED}) GROUP BY batch")
def delivered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the record batches in which a join hands its rows to a callback."""
    build, probe = _read(spark, sf_dir, "nation", "n_nationkey", "n_name"), _read(spark, sf_dir, "customer", "c_nationkey", "c_custkey")
    got: list[int] = []
    _table(build, 1, probe).inner_join(probe, lambda b: got.append(len(b)), 1000)
    return _made(spark, enumerate(got), "batch long, n_rows long")


_WIDTH = "CASE column_type WHEN 'BIGINT' THEN 8 WHEN 'DOUBLE' THEN 8 WHEN 'TIMESTAMP' THEN 8 WHEN 'INTEGER' THEN 4 ELSE 16 END"


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, (16777216 // sum({_WIDTH}))::BIGINT AS n_rows FROM (DESCRIBE SELECT * FROM {t})" for t in ("orders", "customer", "nation")))
def batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch where none are asked for: 16 MiB over the widths of the columns."""
    found = {t: default_rows_per_batch(_all(spark, sf_dir, t).schema) for t in ("orders", "customer", "nation")}
    return _made(spark, found.items(), "name string, n_rows long")


# Joins in order, separate keys


@query("SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS at, l_orderkey AS o_orderkey, o_custkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def ordered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined rows in the order of the probe side."""
    build = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    probe = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").orderBy("l_shipdate", "l_orderkey", "l_linenumber").drop("l_shipdate")
    return with_position(_table(build, 1, probe).inner_join(probe, preserve_probe_order=True), "at")


@query("SELECT n_nationkey AS key, n_name, c_name FROM nation JOIN (SELECT * FROM customer WHERE c_custkey <= 200) ON c_nationkey = n_nationkey")
def arrow_insert2_join2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and payloads as Arrow data of their own, into the table and against it."""
    build, probe = _all(spark, sf_dir, "nation").toArrow(), _all(spark, sf_dir, "customer").where("c_custkey <= 200").toArrow()
    table = KeyedTable(pa.schema([("key", pa.int32())]), pa.schema([("n_name", pa.string())]), pa.schema([("c_name", pa.string())]), spark=spark)
    table.insert2(build.select(["n_nationkey"]), build.select(["n_name"]))
    return table.inner_join2(probe.select(["c_nationkey"]), probe.select(["c_name"]))


@query(
    "SELECT page, probe_idx, row_id FROM (SELECT (row_number() OVER (ORDER BY event_id, row_id) - 1) // 1000 AS page, event_id AS probe_idx, row_id FROM events"
    " JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_custkey FROM orders) ON user_id = o_custkey)"
)
def hash_probe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of hashes in probe order, by pages."""
    orders = with_position(_read(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), "row_id", "o_orderkey")
    events = _read(spark, sf_dir, "events", F.col("event_id").alias("probe_idx"), F.col("user_id").alias("hash"))
    return hashing.probe_pages(hashing.probe_hashes(orders.select(F.col("o_custkey").alias("hash"), "row_id"), events), 1000)


@query("SELECT event_id AS probe_idx, row_id FROM events JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_custkey FROM orders) ON user_id = o_custkey ORDER BY 1, 2 LIMIT 60 OFFSET 20")
def hash_probe_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of 20 matches, each going on from the end of the one before; the first page, which starts them, is left out."""
    orders = with_position(_read(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), "row_id", "o_orderkey")
    events = _read(spark, sf_dir, "events", F.col("event_id").alias("probe_idx"), F.col("user_id").alias("hash"))
    build = orders.select(F.col("o_custkey").alias("hash"), "row_id")
    last, got = None, []
    for _ in range(4):
        page = [tuple(r) for r in hashing.probe_page(build, events, 20, last).collect()]
        got, last = got + page, page[-1] if page else last
    return _made(spark, got[20:], "probe_idx long, row_id long")


@query("SELECT 8 AS width_bytes, count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct FROM orders")
def hash_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders", "o_orderkey")
    hashed = orders.select(hashing.identity_hash(orders, ["o_orderkey"]).alias("h"))
    return hashed.agg(F.lit(hashing.HASH_WIDTH_BYTES).alias("width_bytes"), F.count("*").alias("n"), F.countDistinct("h").alias("n_distinct"))


# Slices


@query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET (SELECT count(*) - 5 FROM customer)")
def slice_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _read(spark, sf_dir, "customer", "c_custkey")
    return columns.slice_view(customers, customers.count() - 5, 100, "c_custkey")


@query("SELECT vec_id, embedding[4:9] AS part FROM embeddings")
def array_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "embeddings").select("vec_id", columns.slice_array("embedding", 3, 6).alias("part"))


# Equality and flags

_FLAGS = "SELECT event_id, event_id % 3 = 0 AS a, event_id % 5 < 2 AS b, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS v, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS w FROM events"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "events").selectExpr("event_id", "event_id % 3 = 0 AS a", "event_id % 5 < 2 AS b", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS v", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS w")


@query(f"SELECT bool_and(a IS NOT DISTINCT FROM b) FILTER (WHERE event_id % 15 IN (0, 2, 4)) AS picked, bool_and(a IS NOT DISTINCT FROM b) AS every FROM ({_FLAGS})")
def equality_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir).withColumn("s", (F.col("event_id") % 15).isin(0, 2, 4))
    return equality.all_equal(flags, "a", "b", "s").select(F.col("eq").alias("picked")).crossJoin(equality.all_equal(flags, "a", "b").select(F.col("eq").alias("every")))  # one row beside one


@query(f"SELECT bool_or(v IS NULL) AS v_nulls, bool_or(a IS NULL) AS a_nulls, bool_and(a) AS a_all, bool_and(a OR NOT a) AS any_all FROM ({_FLAGS})")
def null_and_set_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir).withColumn("any", F.col("a") | ~F.col("a"))
    found = (equality.has_nulls(flags, "v").first()[0], equality.has_nulls(flags, "a").first()[0], equality.all_set(flags, "a").first()[0], equality.all_set(flags, "any").first()[0])
    return _made(spark, [found], "v_nulls boolean, a_nulls boolean, a_all boolean, any_all boolean")


@query("SELECT true AS same, false AS turned, count(*) <= 1 AS shifted FROM orders")
def frame_equality_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    compare = lambda other, order: equality.frames_equal(orders, other, True, ["o_orderkey"], [order])
    found = (compare(orders, "o_orderkey"), compare(orders, F.desc("o_orderkey")), compare(orders.withColumn("o_orderkey", F.col("o_orderkey") + 1), "o_orderkey"))
    return _made(spark, [found], "same boolean, turned boolean, shifted boolean")


@query(f"SELECT event_id, NOT a AS not_a, a AND b AS a_and_b, a AND NOT b AS a_and_not_b, a OR b AS a_or_b, a OR NOT b AS a_or_not_b FROM ({_FLAGS})")
def flag_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    made = {"not_a": bits.inverted(a), "a_and_b": bits.both(a, b), "a_and_not_b": bits.left_only(a, b), "a_or_b": bits.either(a, b), "a_or_not_b": bits.left_or_not(a, b)}
    return _flags(spark, sf_dir).select("event_id", *[c.alias(k) for k, c in made.items()])


@query(f"SELECT bool_and((v IS NULL) = (w IS NULL)) AS v_w, bool_and((v IS NULL) = (a IS NULL)) AS v_a FROM ({_FLAGS})")
def validity_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir)
    return _made(spark, [(bits.validity_equal(flags, "v", "w").first()[0], bits.validity_equal(flags, "v", "a").first()[0])], "v_w boolean, v_a boolean")


@query("SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS at, o_orderkey FROM orders")
def rows_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(bits.reversed_rows(_read(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey"), "at").select("at", "o_orderkey")


@query("SELECT pos, flag FROM (SELECT event_id AS pos, user_id AS row_id FROM events) JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, o_custkey % 2 = 0 AS flag FROM orders) ON row_id = id")
def flag_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders", (F.col("o_custkey") % 2 == 0).alias("flag"), "o_orderkey")
    return bits.indexed_copy(orders, "flag", _read(spark, sf_dir, "events", F.col("event_id").alias("pos"), F.col("user_id").alias("row_id")), "o_orderkey")


@query("SELECT o_orderkey, bit_count(o_orderkey)::INT AS ones, (o_orderkey + 7) // 8 * 8 AS up, o_orderkey // 8 * 8 AS down, o_orderkey & 4 <> 0 AS third, o_orderkey | 4 AS third_set, o_orderkey & ~4::BIGINT AS third_cleared FROM orders")
def bit_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    made = {"ones": bits.popcount(k), "up": bits.aligned(k, 8), "down": bits.aligned_down(k, 8), "third": bits.bit_is_set(k, 2), "third_set": bits.with_bit(k, 2), "third_cleared": bits.with_bit(k, 2, False)}
    return _read(spark, sf_dir, "orders", "o_orderkey").select(k, *[c.alias(n) for n, c in made.items()])


# Storage, row tables


@query("SELECT * FROM (VALUES (0, 'ram', 67108864::BIGINT, NULL, false, 1), (1, 'ram', 1024::BIGINT, NULL, false, 1), (2, 'file', NULL, '/data/x', true, 4096), (3, 'error', NULL, NULL, NULL, NULL), (4, 'error', NULL, NULL, NULL, NULL)) v(i, kind, size_bytes, path, direct, page_size)")
def storage_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parsed(descriptor: str | None) -> tuple:
        try:
            s = parse_storage(descriptor)
        except ValueError:
            return "error", None, None, None, None
        return s.kind, s.size_bytes, s.path, s.direct, s.page_size

    given = (None, "ram:///?size_bytes=1024", "file:///data/x?direct=true", "ram:///?size_bytes=1&size_bytes=2", "tape:///")
    return _made(spark, ((i, *parsed(d)) for i, d in enumerate(given)), "i int, kind string, size_bytes long, path string, direct boolean, page_size int")


@query("SELECT o_orderkey, o_custkey, 'file' AS kept FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT o_orderkey, o_custkey, 'ram' FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def storage_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that keep their rows in files of the shared folder, or in memory."""
    build, keys = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), _read(spark, sf_dir, "lineitem", "l_orderkey")
    folder = shared_dir(spark).removeprefix("file:").rstrip("/")
    found = [_table(build, 1, storage_descriptor=d).keep().lookup(keys).withColumn("kept", F.lit(k)) for k, d in (("file", f"file://{folder}/kept-rows"), ("ram", "ram:///?size_bytes=2147483647"))]
    return stacked(*found)


@query("SELECT * FROM (VALUES ('both', 4096::BIGINT, 8192::BIGINT), ('block', 838860::BIGINT, 1073741824::BIGINT), ('error', NULL, NULL)) v(given, block, total)")
def block_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    def resolved(options: BlockOptions) -> tuple:
        try:
            found = options.resolved()
        except ValueError:
            return None, None
        return found.block_size_bytes, found.total_size_bytes

    given = {"both": BlockOptions(4096, 8192), "block": BlockOptions(total_size_bytes=1 << 30), "error": BlockOptions(8192, 4096)}
    return _made(spark, ((k, *resolved(o)) for k, o in given.items()), "given string, block long, total long")


@query("SELECT * FROM (VALUES ('packed', 8::BIGINT, 16::BIGINT), ('page', 4096::BIGINT, 4096::BIGINT)) v(alignment, flags, numbers)")
def row_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a row of two flags, and of a long, a short and an int."""
    flags, numbers = (spark.createDataFrame([], s).schema for s in ("a boolean, b boolean", "k long, s short, i int"))
    return _made(spark, ((n, arrow.row_width(flags, a), arrow.row_width(numbers, a)) for n, a in (("packed", 8), ("page", 4096))), "alignment string, flags long, numbers long")


@query("SELECT count(*) AS first_id, 0::BIGINT AS first_after_reset, 2 * count(*) AS n_rows FROM nation")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First id of a second batch, and of one after a reset."""
    nation = _all(spark, sf_dir, "nation")
    table = rows.RowTable(nation.schema)
    table.append(nation, "n_nationkey")
    second, n = table.append(nation, "n_nationkey"), table.n_rows
    table.reset()
    return _made(spark, [(second, table.append(nation, "n_nationkey"), n)], "first_id long, first_after_reset long, n_rows long")


# Generated data, traces

_MIXED = mixed_sql("id", 42, 0, 0), mixed_sql("id", 42, 1, 0), mixed_sql("id", 42, 2, 0), mixed_sql("id", 42, 2, 1), mixed_sql("id", 42, 3, 0)


@query(
    f"SELECT ({_MIXED[0]} % 256 - 128)::TINYINT AS a, ({_MIXED[1]} - 1073741824)::INT AS b, ({_MIXED[2]} << 32) | {_MIXED[3]} AS c, unhex(printf('%06x', {_MIXED[4]} % 16777216)) AS d"
    " FROM range((SELECT count(*) FROM lineitem)) r(id)"
)
def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = datagen.Generator(42).field(1, "a").field(4, "b").field(8, "c").field(3, "d")
    return made.rows(spark, _read(spark, sf_dir, "lineitem", "l_orderkey").count())


@query(f"SELECT id, -100 + {mixed_sql('id', 7)} % 1100 AS value FROM range((SELECT count(*) FROM orders)) r(id)")
def random_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datagen.random_ints(spark, _read(spark, sf_dir, "orders", "o_orderkey").count(), 7, -100, 1000)


@query("SELECT o_orderkey, o_custkey FROM orders")
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datagen.shuffled(_read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), 3, "o_orderkey")


@query("SELECT * FROM (VALUES ('inner', true), ('lookup', true), ('outer', true)) v(category, timed)")
def traced_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that took time between two clearings."""
    trace.clear_tracing()
    with trace.traced("outer"), trace.traced("inner"):
        nation = _read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    _table(nation, 1).lookup(nation.select("n_nationkey"))
    found = [(k, v > 0) for k, v in trace.tracing().items() if k != "insert"]
    trace.clear_tracing()
    return _made(spark, found, "category string, timed boolean")


@query("SELECT * FROM (VALUES ('info', 'keyweave'), ('levels', 'trace debug info warn'), ('text', 'n_nationkey, n_name')) v(what, shown)")
def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    shown = {"info": keyweave.info(spark).split()[0], "levels": " ".join(trace.LOG_LEVELS), "text": trace.rows_as_text(nation).split("\n")[0]}
    return _made(spark, shown.items(), "what string, shown string")
