import pyarrow as pa
import pytest

from keyweave import KeyedTable

KEY = pa.schema([("key", pa.int64())])
BUILD = pa.schema([("x", pa.int32()), ("y", pa.int16())])
PROBE = pa.schema([("z", pa.int8())])


def batch(schema, *rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def joined(*schemas):
    return pa.schema([f for s in schemas for f in s])


BUILD_ROWS, PROBE_ROWS = joined(KEY, BUILD), joined(KEY, PROBE)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(spark, *build, **options):
    return KeyedTable(KEY, BUILD, PROBE, spark=spark, **options).insert(batch(BUILD_ROWS, *build))


def test_lookup_and_join(spark):
    table = made(spark, (5, None, 7), (4, 1, None), (1, 17, 12), (2, 0, 13))
    assert rows(table.lookup(batch(KEY, (1,), (5,)))) == [(1, 17, 12), (5, None, 7)]
    got = []
    out = table.inner_join(batch(PROBE_ROWS, (1, 100), (5, None)), got.append, preserve_probe_order=True)
    assert out.columns == ["key", "x", "y", "z"]
    assert len(got) == 1 and got[0].to_pylist() == [{"key": 1, "x": 17, "y": 12, "z": 100}, {"key": 5, "x": None, "y": 7, "z": None}]
    assert got[0].schema.names == ["key", "x", "y", "z"]


DUPLICATES = ((1, 1, 10), (2, 2, 20), (2, 3, 30))
PROBES = ((2, -1), (1, -2), (3, -3))
MATCHES = [(1, 1, 10, -2), (2, 2, 20, -1), (2, 3, 30, -1)]


def test_duplicates_misses_and_tiny_batches(spark):
    table = made(spark, *DUPLICATES)
    got = []
    assert rows(table.inner_join(batch(PROBE_ROWS, *PROBES), got.append, rows_per_batch=1)) == MATCHES
    assert [len(b) for b in got] == [1, 1, 1]
    ordered = [tuple(r) for r in table.inner_join(batch(PROBE_ROWS, *PROBES), preserve_probe_order=True).collect()]
    assert [r[0] for r in ordered] == [2, 2, 1]
    for strategy in ("broadcast", "shuffle_hash", "merge"):
        assert rows(table.inner_join(batch(PROBE_ROWS, *PROBES), strategy=strategy)) == MATCHES


def test_no_match_calls_nobody(spark):
    got = []
    assert made(spark, *DUPLICATES).inner_join(batch(PROBE_ROWS, (99, 1)), got.append).count() == 0
    assert got == []


def test_append_and_separate_frames(spark):
    table = made(spark, *DUPLICATES[:2]).insert(batch(BUILD_ROWS, *DUPLICATES[2:]))
    assert rows(table.inner_join(batch(PROBE_ROWS, *PROBES))) == MATCHES
    two = KeyedTable(KEY, BUILD, PROBE, spark=spark)
    two.insert2(batch(KEY, *[r[:1] for r in DUPLICATES]), batch(BUILD, *[r[1:] for r in DUPLICATES]))
    assert rows(two.inner_join2(batch(KEY, *[r[:1] for r in PROBES]), batch(PROBE, *[r[1:] for r in PROBES]))) == MATCHES
    with pytest.raises(ValueError, match="combine"):
        two.insert2(batch(KEY, (1,)), batch(BUILD, (1, 1), (2, 2)))


def test_many_matches(spark):
    probe = pa.table({"k": pa.array([1] * 5000, pa.int64()), "p": pa.array(range(5000), pa.int32())})
    table = KeyedTable(KEY, pa.schema([("b", pa.int32())]), pa.schema([("p", pa.int32())]), spark=spark)
    table.insert(batch(joined(KEY, pa.schema([("b", pa.int32())])), (1, 7)))
    assert sorted(r.p for r in table.inner_join(probe).collect()) == list(range(5000))
    got = []
    table.inner_join(probe, got.append, rows_per_batch=1200)
    assert [len(b) for b in got] == [1200, 1200, 1200, 1200, 200]


def test_lookup_fan_out_has_no_limit(spark):
    table = made(spark, (1, 1, 1), (1, 2, 2), (1, 3, 3))
    assert rows(table.lookup(batch(KEY, (1,)))) == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    assert table.lookup(batch(KEY, (1,), (1,))).count() == 6


TWO_KEYS = pa.schema([("k0", pa.int64()), ("k1", pa.int16())])
TWO_BUILD = pa.schema([("b0", pa.int32()), ("b1", pa.int16())])
TWO_PROBE = pa.schema([("p0", pa.int16())])
TWO_ROWS = ((1, 1, 1, 1), (2, 100, 2, 1), (0, 1000, 3, 1), (1000, 57, 4, 2), (0, None, 5, 2))


def two(spark, **options):
    return KeyedTable(TWO_KEYS, TWO_BUILD, TWO_PROBE, spark=spark, **options).insert(batch(joined(TWO_KEYS, TWO_BUILD), *TWO_ROWS))


def test_two_keys(spark):
    table = two(spark)
    assert rows(table.lookup(batch(TWO_KEYS, (1000, 57), (1, 1)))) == [(1, 1, 1, 1), (1000, 57, 4, 2)]
    probe = joined(TWO_KEYS, TWO_PROBE)
    assert rows(table.inner_join(batch(probe, (1000, 57, 80), (1, 1, 81)))) == [(1, 1, 1, 1, 81), (1000, 57, 4, 2, 80)]
    assert rows(table.inner_join(batch(probe, (0, 1000, 80)))) == [(0, 1000, 3, 1, 80)]
    assert rows(two(spark, match="hash").inner_join(batch(probe, (0, 1000, 80)))) == [(0, 1000, 3, 1, 80), (0, None, 5, 2, 80)]
    assert rows(table.inner_join(batch(probe, (0, None, 81)))) == [(0, None, 5, 2, 81)]
    assert two(spark, null_keys="drop").inner_join(batch(probe, (0, None, 81))).count() == 0


@pytest.mark.parametrize(("null_keys", "n"), [("match", 1), ("drop", 0)])
def test_null_first_key(spark, null_keys, n):
    table = made(spark, (None, 10, 1), null_keys=null_keys)
    assert table.inner_join(batch(PROBE_ROWS, (None, 100))).count() == n


def test_schema_rules(spark):
    table = made(spark, *DUPLICATES)
    with pytest.raises(ValueError, match="Schema mismatch"):
        table.insert(batch(KEY, (1,)))
    with pytest.raises(ValueError, match="Schema mismatch"):
        table.lookup(pa.table({"key": pa.array([1], pa.int32())}))
    other = pa.RecordBatch.from_arrays(batch(BUILD_ROWS, (9, 9, 9)).columns, names=["a", "b", "c"])
    table.insert(other)
    assert rows(table.lookup(batch(KEY, (9,)))) == [(9, 9, 9)]
    with pytest.raises(TypeError):
        table.insert([1, 2])
    with pytest.raises(ValueError, match="twice"):
        KeyedTable(KEY, pa.schema([("key", pa.int32())]), spark=spark)
    assert KeyedTable(KEY, BUILD, BUILD, spark=spark, suffixes=("_b", "_p")).rows.columns == ["key", "x_b", "y_b"]


def test_without_probe_schema(spark):
    table = KeyedTable(KEY, BUILD, spark=spark).insert(batch(BUILD_ROWS, *DUPLICATES))
    with pytest.raises(ValueError, match="probe payload schema"):
        table.inner_join(batch(PROBE_ROWS, *PROBES))
    assert table.lookup(batch(KEY, (2,))).count() == 2


def test_empty_table_and_strings(spark):
    assert KeyedTable(KEY, BUILD, PROBE, spark=spark).inner_join(batch(PROBE_ROWS, *PROBES)).count() == 0
    text, values = pa.schema([("k", pa.string())]), pa.schema([("v", pa.list_(pa.int32()))])
    table = KeyedTable(text, values, spark=spark).insert(batch(joined(text, values), ("a", [1, 2]), ("b", None)))
    assert [tuple(r) for r in table.lookup(batch(text, ("a",))).collect()] == [("a", [1, 2])]


def test_storage_and_depth(spark, tmp_path):
    table = made(spark, *DUPLICATES, storage_descriptor=f"file://{tmp_path}/kept?direct=true")
    assert table.keep().lookup(batch(KEY, (2,))).count() == 2
    assert "rows-" in table.rows.inputFiles()[0]
    assert table.insert(batch(BUILD_ROWS, (2, 9, 9))).lookup(batch(KEY, (2,))).count() == 3
    table = made(spark, *DUPLICATES)
    assert table.keep().lookup(batch(KEY, (2,))).count() == 2
    table.release()
    with pytest.raises(RuntimeError, match="do not fit"):
        made(spark, *DUPLICATES, storage_descriptor="ram:///?size_bytes=20", strict_capacity=True)
    for _ in range(66):
        table.insert(batch(BUILD_ROWS, (7, 7, 7)))
    assert table.lookup(batch(KEY, (7,))).count() == 66
