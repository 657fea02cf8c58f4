"""Materialised frames, dense row positions, measured sizes."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A broadcast is asked for only below this many bytes, measured on the frame itself.
BROADCAST_BYTES = 32 << 20
#: monotonically_increasing_id keeps the partition above these bits and the place in it below.
PLACE_BITS = 33
#: Copies of one row that a task places at most.
COPIES = 1 << 20
#: Rows of a few numbers that a checkpoint keeps in a file at least.
FILE_ROWS = 50_000
#: Rows of at most so many columns, all of fixed width, are sorted and kept themselves where positions are asked for.
NARROW_COLUMNS = 8
#: More parts than a frame has.
MOST_PARTS = (1 << 31) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session on one machine, as in tests, gets a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def in_few_parts(df: DataFrame, rows: int) -> DataFrame:
    """df, whose last stage reads or makes at most so many short rows, with only as many tasks in that stage as these fill."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df computed once, without lineage, in the shared folder.

    rows: at most so many short rows go into its last stage or come out of it. That stage then has only as many tasks,
    each with a file, as these rows fill: for every file a local file system starts processes, and every later reader has a task.

    A checkpoint keeps the planner's estimate of the frame's size, which every join multiplies: over the rounds of
    an iteration it grows to numbers of millions of digits, which take longer to multiply than the rows. So
    the kept rows become a frame of unknown size; joins are decided by measured sizes.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if rows is not None:
        df = in_few_parts(df, rows)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def stacked(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, each task with those of one frame.

    A plain union of frames that are partitioned alike, such as two joins on one key, gives a task a partition of each,
    and so the memory for all their sorts. coalesce to more parts than there are leaves them as they are, but unlike.
    """
    out = frames[0]
    for df in frames[1:]:
        out = out.unionAll(df.coalesce(MOST_PARTS))
    return out


def _value_bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory; null takes 8."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        found = F.octet_length(column).cast("long") + 8
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DatetimeType)):
        found = F.size(column).cast("long") * 8 + 24
    elif isinstance(kind, T.ArrayType):
        found = F.aggregate(column, F.lit(24).cast("long"), lambda total, x: total + _value_bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        found = _value_bytes(F.map_keys(column), T.ArrayType(kind.keyType)) + _value_bytes(F.map_values(column), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        found = F.lit(8).cast("long")
        for f in kind:
            found += _value_bytes(column.getField(f.name), f.dataType)
    elif isinstance(kind, T.VariantType):
        found = F.octet_length(column.cast("string")).cast("long") + 16
    else:
        return F.lit(8).cast("long")
    return F.coalesce(found, F.lit(8).cast("long"))


def measured_bytes(df: DataFrame) -> int:
    """What the rows of df take in memory, from the lengths of all values, in one pass that returns one number."""
    names = [f"c{i}" for i in range(len(df.columns))]
    width = F.lit(16).cast("long")
    for name, f in zip(names, df.schema):
        width += _value_bytes(F.col(name), f.dataType)
    return df.toDF(*names).agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()[0]


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its measured bytes fit BROADCAST_BYTES; else the planner decides."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """df, which is checkpointed, with its dense position as it is stored: the count of the partitions before, found by partition, plus the place within."""
    part = F.spark_partition_id().alias("_kw_part")
    counts = df.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("_kw_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    firsts = checkpointed(counts.select("_kw_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_kw_first")))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    rows = df.select("*", part, within.alias("_kw_within"))
    return rows.join(F.broadcast(firsts), "_kw_part").withColumn(name, F.col("_kw_first") + F.col("_kw_within")).drop("_kw_part", "_kw_first", "_kw_within")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType, T.UserDefinedType))


def _handle(df: DataFrame) -> list[Column]:
    """128 bits that tell rows of different values apart; floats go by their text, in which 0.0 and -0.0 differ."""
    columns = [F.col(f"`{f.name}`").cast("string") if re.search("float|double", f.dataType.simpleString()) else F.col(f"`{f.name}`") for f in df.schema]
    none = [F.col(f"`{f.name}`").isNull() for f in df.schema]  # a null leaves the hash as it was
    return [F.xxhash64(*columns, *none).alias("_kw_h1"), F.xxhash64(F.lit("2"), *none, *columns).alias("_kw_h2")]


def _narrow(df: DataFrame) -> bool:
    """Whether the rows are no wider than what else would be kept, sorted and joined for them."""
    fixed = T.NumericType, T.BooleanType, T.DatetimeType, T.DayTimeIntervalType, T.YearMonthIntervalType
    return len(df.columns) <= NARROW_COLUMNS and all(isinstance(f.dataType, fixed) for f in df.schema)


def _whole_order(df: DataFrame, order_by: Sequence[str | Column]) -> bool:
    """Whether rows equal in the order are alike: all columns are in it, and none has different values that sort as equal, as 0.0 and -0.0."""
    return {*df.columns} <= {c for c in order_by if isinstance(c, str)} and not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema)


def with_position(df: DataFrame, name: str, *order_by: str | Column) -> DataFrame:
    """df with its dense position from 0 as long column name, in the given order, or as the rows come.

    In a given order only the order's columns and a 128-bit hash of each row are sorted, by range over
    all tasks, and kept in the shared folder; the rows themselves move once, to meet their positions.
    Rows of a few numbers, which are no wider than that, are sorted and kept themselves and meet nothing.
    Equal rows of the order go by that hash, so a rerun gives the same positions; a frame is read twice and must
    have the same rows both times. Copies of one row, which are alike, get the positions of all of them.

    Without an order, and for columns that have no hash (maps) or rows that may change from one reading to
    the next, the rows as they come are kept in the shared folder.
    """
    deterministic = df._jdf.queryExecution().analyzed().deterministic()
    if not order_by:
        return _numbered(checkpointed(df), name)
    if not deterministic or not all(_hashable(f.dataType) for f in df.schema):
        place = "_kw_place"
        order = [*order_by, F.col(place)]
        df = df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop(place)
        return _numbered(checkpointed(df), name)

    if _narrow(df) and _whole_order(df, order_by):
        return _numbered(checkpointed(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)), name)
    handled, both = df.select("*", *_handle(df)), ["_kw_h1", "_kw_h2"]
    order = [*order_by, *map(F.col, both)]
    ordered = handled.repartitionByRange(*order).sortWithinPartitions(*order)
    if _narrow(df):
        return _numbered(checkpointed(ordered.drop(*both)), name)
    placed = checkpointed(_numbered(checkpointed(ordered.select(*both)), "_kw_at"))
    repeated = checkpointed(placed.groupBy(*both).agg(F.count("*").alias("n"), F.min("_kw_at").alias("low"), F.max("_kw_at").alias("high")).where("n > 1").drop("n"))
    if repeated.isEmpty():
        return handled.join(placed, both).drop(*both).withColumnRenamed("_kw_at", name)
    # One of all copies meets the positions of all, in pieces of COPIES, so that no task gets all of a hot row.
    keys = broadcast_if_small(repeated)
    single = handled.join(keys.select(*both), both, "left_anti").join(placed, both)
    piece = F.floor(F.col("_kw_at") / COPIES).alias("_kw_piece")
    pieces = F.explode(F.sequence(F.floor(F.col("low") / COPIES), F.floor(F.col("high") / COPIES))).alias("_kw_piece")
    content = handled.join(keys.select(*both), both, "left_semi").dropDuplicates(both)
    content = content.join(repeated, both).select(*[f"`{c}`" for c in content.columns], pieces)
    copies = placed.select(*both, "_kw_at", piece).join(content, [*both, "_kw_piece"])
    columns = [*[f"`{c}`" for c in df.columns], F.col("_kw_at").alias(name)]
    return single.select(*columns).unionAll(copies.select(*columns))
