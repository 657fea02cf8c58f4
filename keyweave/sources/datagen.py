"""Seeded data: the same seed and number of rows give the same values on any cluster, and in any SQL engine.

All values come from one rule over whole numbers below 2**31 - 1 (mixed), without wrap-around or
hash functions, so that the same numbers can be written in plain SQL.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = {1: "tinyint", 2: "smallint", 4: "int", 8: "bigint"}
#: The modulus and factor of mixed.
PRIME, FACTOR = (1 << 31) - 1, 48271


def mixed(value: Column, *salts: int) -> Column:
    """A number from 0 to PRIME - 1 that depends on value and all salts.

    x is value mod PRIME; each salt makes it (x * FACTOR + salt) mod PRIME; last, twice, x becomes
    ((x xor x >> 15) * FACTOR + 1) mod PRIME.
    """
    x = F.pmod(value, F.lit(PRIME))
    for salt in salts:
        x = (x * FACTOR + salt % PRIME) % PRIME
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 15)) * FACTOR + 1) % PRIME
    return x


def flat_schema(*fields: tuple[str, int]) -> T.StructType:
    """A schema from names and widths in bytes: 1, 2, 4 and 8 are integers, other widths binary."""
    kinds = {1: T.ByteType(), 2: T.ShortType(), 4: T.IntegerType(), 8: T.LongType()}
    out = T.StructType()
    for name, width in fields:
        out = out.add(name, kinds.get(width, T.BinaryType()))
    return out


class Generator:
    """Fields of fixed width without nulls: 1, 2, 4 and 8 bytes are integers, other widths binary."""

    def __init__(self, seed: int = 42):
        self.seed = seed
        self.fields: list[tuple[str, int]] = []

    def field(self, width: int, name: str | None = None) -> Generator:
        if width < 1:
            raise ValueError("width must be 1 or more")
        self.fields.append((name or f"f{len(self.fields)}", width))
        return self

    def n_fields(self, n: int, width: int) -> Generator:
        for _ in range(n):
            self.field(width)
        return self

    def fields_of_total_width(self, total: int, most: int = 8) -> Generator:
        """Fields of 1 to most bytes that add up to total: the row is cut at places drawn by the seed, and pieces that are too wide again."""
        drawn = random.Random(self.seed).sample(range(1, total), (total - 1) // most) if total > 1 else []
        edges = sorted({0, total, *drawn})
        for start, end in zip(edges, edges[1:]):
            for at in range(start, end, most):
                self.field(min(most, end - at))
        return self

    @property
    def schema(self) -> T.StructType:
        return flat_schema(*self.fields)

    def _value(self, i: int, width: int) -> Column:
        draw = lambda k: mixed(F.col("id"), self.seed, i, k)
        if width == 8:
            return F.shiftleft(draw(0), 32).bitwiseOR(draw(1))
        if width in _INTEGERS:
            return ((draw(0) - (1 << 30)) if width == 4 else F.pmod(draw(0), F.lit(1 << 8 * width)) - (1 << 8 * width - 1)).cast(_INTEGERS[width])
        digits = F.concat(*[F.lpad(F.hex(F.pmod(draw(k), F.lit(1 << 24))), 6, "0") for k in range(-(-width // 3))])
        return F.unhex(F.substring(digits, 1, 2 * width))

    def rows(self, spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
        base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
        return base.select(*[self._value(i, w).alias(name) for i, (name, w) in enumerate(self.fields)])


def random_ints(spark: SparkSession, n: int, seed: int, low: int, high: int, partitions: int | None = None) -> DataFrame:
    """id from 0 to n - 1 and value, drawn by the seed from low to high - 1 (at most PRIME apart)."""
    if not 0 < high - low <= PRIME:
        raise ValueError("low must be below high, and no more than PRIME apart")
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return base.select("id", (F.lit(low) + mixed(F.col("id"), seed) % (high - low)).cast("long").alias("value"))


def shuffled(df: DataFrame, seed: int, *unique: str) -> DataFrame:
    """The rows in a random order that depends on the seed and the unique columns only."""
    return df.orderBy(F.xxhash64(*unique, F.lit(seed)), *unique)


def join_inputs(spark: SparkSession, build_rows: int, probe_rows: int, keys: int = 1, overlap: float = 1.0, payload: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Build rows with unique keys and probe rows of which the share overlap finds one."""
    value = lambda column, *salts: mixed(F.col(column), seed, *salts)
    key = [value("k", 0, i).alias(f"key{i}") for i in range(1, keys)]
    build = spark.range(build_rows).withColumn("k", F.col("id"))
    build = build.select(F.col("k").alias("key0"), *key, *[value("id", 1, i).alias(f"b{i}") for i in range(payload)])
    hit = value("id", 2) % 10_000 < int(overlap * 10_000)
    probe = spark.range(probe_rows).withColumn("k", value("id", 3) % build_rows + F.when(hit, 0).otherwise(build_rows))
    probe = probe.select(F.col("k").alias("key0"), *key, *[value("id", 4, i).alias(f"p{i}") for i in range(payload)])
    return build, probe
