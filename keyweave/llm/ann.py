"""Approximate nearest neighbours from shifted space-filling curves.

Each curve rotates the vectors at random, keeps a few coordinates, shifts the grid and orders the
vectors along a Hilbert curve; a range sort and the partitions' totals turn keys into places. A
query looks at the blocks of places around its own on every curve. What lies there are short codes, a byte for each
coordinate of one more rotation; the best REFINE by code of all curves are merged, and only these meet
the query with their vectors, which decide exactly.

How far to look is measured, not guessed: some points, chosen by hash whether they are queries or not, are compared with all rows, and the window
is wide enough that the wanted share of their true neighbours lies in it on some curve. Data with
structure gets short windows; data without any gets windows that grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm._common import broadcast_if_small, checkpointed

CURVES, DIMS, BITS = 12, 8, 5
#: Rows that fit a grid to the data; points that measure the window, and of how many points one does.
SAMPLE, MEASURED, ONE_OF = 4096, 128, 8
#: Bytes in a code, and candidates by code whose vectors are fetched for each query (at least 4 k).
CODE, REFINE = 128, 64
#: Share of the measured queries' true neighbours that the windows must hold.
SHARE = 0.96
#: The most vectors in one block.
BLOCK = 2048


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (unsigned integers under 2**bits), one row at a time in parallel."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        at, low = np.uint64(level), np.uint64((1 << level) - 1)
        for i in range(len(x)):
            high = (x[i] >> at) & one == one
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> np.uint64(level)) & one == one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flips
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(level)) & one)
    return key.astype(np.int64)


class Grid:
    """Rotations, scales and shifts of all curves, fitted to a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, dim: int, curves: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        kept = min(DIMS, dim)
        self.axes = np.stack([np.linalg.qr(rng.normal(size=(dim, dim)) if dim <= 256 else rng.normal(size=(dim, kept)))[0][:, :kept] for _ in range(curves)])
        self.mean = sample.mean(axis=0)
        self.scale = np.maximum(np.einsum("nd,cdk->cnk", sample - self.mean, self.axes).std(axis=1), 1e-12)
        self.shift = rng.uniform(-0.7, 0.7, (curves, kept))
        self.turn = np.linalg.qr(rng.normal(size=(dim, min(CODE, dim))))[0]
        self.step = max(float(np.abs(sample @ self.turn).max()), 1e-12) / 127

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """A row of bytes per vector, whose products are nearly those of the vectors."""
        return np.clip(np.rint(unit @ self.turn / self.step), -127, 127).astype(np.int8)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A row per vector, a column per curve."""
        out = []
        for axes, scale, shift in zip(self.axes, self.scale, self.shift):
            spread = ((unit - self.mean) @ axes / scale + 3 + shift) / 6
            out.append(hilbert_keys(np.clip(spread * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS))
        return np.stack(out, axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision. Length is taken out by the largest component first, so no square overflows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = np.where((largest > 1e100) | (largest < 1e-100), x / largest, x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _best(scores: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller least."""
    if len(scores) > k:
        among = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((least[among], -scores[among]))][:k]


def _whole(vector: np.ndarray) -> list[int]:
    """The components times one power of two, as whole numbers."""
    ratios = [x.as_integer_ratio() for x in vector.tolist()]
    most = max(d for _, d in ratios)
    return [n * (most // d) for n, d in ratios]


def exact_cosine(a: list[int], b: list[int]) -> float:
    """The cosine of two whole-number vectors from exact sums, to double precision; equal for all multiples of the same vectors."""
    dot, norms = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a) * sum(y * y for y in b)
    size = isqrt((dot * dot << 256) // norms) / (1 << 128)
    return -size if dot < 0 else size


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1).astype(np.float32)


def _top(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("_kw_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_kw_rank") <= k)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec of the rows that take part: finite, not zero, of the table's most common length."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).where("id is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (length.n if length else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other rows found, by cosine.

    is_query is a condition on the column id, the row's key. Equal vectors are one point of the index,
    which keeps the k + 1 least keys; no more can be among the k nearest. So copies neither crowd the
    windows nor lose ties, which go to the smaller key. score is computed from exact sums of the original components'
    products and rounded to double once, so vectors that are multiples of each other tie. With fewer than k other rows all come.

    Null, zero or non-finite vectors, null keys and vectors of another than the table's most common
    length take no part. A key that stands at several vectors is a candidate with each, and repeated rows
    are one; own rows of a query, by key, are left out. Empty tables give an empty result; other columns
    are not looked at.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    by_vec = Window.partitionBy("vec").orderBy("id")
    least = rows.distinct().withColumn("_kw_rank", F.row_number().over(by_vec)).where(F.col("_kw_rank") <= k + 1)
    points = least.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    points = checkpointed(points.withColumn("point", F.monotonically_increasing_id()))
    n = points.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    dim = len(points.select("vec").first().vec)

    sample = points.select("vec").orderBy(F.xxhash64("vec")).limit(max(64, min(SAMPLE, (1 << 22) // dim))).collect()
    grid = spark.sparkContext.broadcast(Grid(_matrix(pa.array([r.vec for r in sample])), dim, curves))

    def place_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = grid.value.keys(_matrix(batch.column(1)))
                columns = [np.tile(np.arange(curves, dtype=np.int32), len(batch)), keys.ravel(), np.repeat(batch.column(0).to_numpy(), curves)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["curve", "at", "point"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = grid.value.codes(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["point", "least", "code"])

    coded = checkpointed(points.select("point", F.col("ids")[0].alias("least"), "vec").mapInArrow(encode, "point long, least long, code binary"))
    keyed = points.select("point", "vec").mapInArrow(place_keys, "curve int, at long, point long")
    line = checkpointed(keyed.repartitionByRange("curve", "at", "point").sortWithinPartitions("curve", "at", "point").select("curve", "point"))
    totals = sorted(line.groupBy(F.spark_partition_id().alias("part")).count().collect())
    before = dict(zip((t.part for t in totals), accumulate((t[1] for t in totals), initial=0)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            place = done + np.arange(len(batch)) - batch.column(0).to_numpy().astype(np.int64) * n  # each curve has every point
            done += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=["curve", "point", "place"])

    placed = line.mapInArrow(number, "curve int, point long, place long")
    placed = checkpointed(placed.groupBy("point").agg(F.sort_array(F.collect_list(F.struct("curve", "place"))).alias("places")))

    queries = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")).distinct()
    queries = checkpointed(queries.join(points, queries["qvec"] == points["vec"]).select("query_id", "point"))
    asked = checkpointed(queries.select("point").distinct())
    window = _measure(points, placed, k, share, n)
    block = max(1, min(BLOCK, window))

    at = coded.join(placed, "point").select("point", "code", "least", F.explode("places").alias("x"))
    at = at.select("point", "code", "least", F.col("x.curve").alias("curve"), F.floor(F.col("x.place") / block).alias("block"))
    looks = coded.join(asked, "point", "left_semi").join(placed, "point").select(F.col("point").alias("query"), F.col("code").alias("asked"), F.explode("places").alias("x"))
    low, high = F.greatest(F.col("x.place") - window, F.lit(0)), F.least(F.col("x.place") + window, F.lit(n - 1))
    looks = looks.select("query", "asked", F.col("x.curve").alias("curve"), F.explode(F.sequence(F.floor(low / block), F.floor(high / block))).alias("block"))
    wanted = max(REFINE, 4 * k)

    def compare(points: pa.Table, queries: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        if len(points) and len(queries):
            point, least_id = points.column("point").to_numpy(), points.column("least").to_numpy()
            scores = _codes(queries.column("asked")) @ _codes(points.column("code")).T
            best = [_best(row, least_id, wanted) for row in scores]
            rows, places = np.repeat(np.arange(len(best)), [len(b) for b in best]), np.concatenate(best)
            found = [queries.column("query").to_numpy()[rows], point[places], scores[rows, places].astype(np.int64)]
        return pa.table([pa.array(f) for f in found], names=["query", "point", "near"])

    found = at.groupBy("curve", "block").cogroup(looks.groupBy("curve", "block")).applyInArrow(compare, "query long, point long, near long")
    merged = found.groupBy("query", "point").agg(F.max("near").alias("near"))
    merged = _top(merged, "query", wanted, F.desc("near"), F.col("point")).select("query", "point")
    pairs = merged.join(points.select("point", "vec", F.col("ids")[0].alias("least")), "point")
    pairs = pairs.join(points.join(asked, "point", "left_semi").select(F.col("point").alias("query"), F.col("vec").alias("qvec")), "query")

    def decide(rows: pa.Table) -> pa.Table:
        """The k + 1 nearest of a query's candidates: those that may be among them by floating point, exactly."""
        least_id, point = rows.column("least").to_numpy(), rows.column("point").to_numpy()
        own, vectors = rows.column("qvec").combine_chunks()[:1], rows.column("vec").combine_chunks()
        near = (_matrix(own) @ _matrix(vectors).T)[0]
        among = np.flatnonzero(near >= np.sort(near)[::-1][: k + 1][-1] - 1e-9)
        asked = _whole(np.array(own[0].as_py(), np.float64))
        scores = np.array([exact_cosine(asked, _whole(np.array(vectors[int(i)].as_py(), np.float64))) for i in among])
        best = _best(scores, least_id[among], k + 1)
        return pa.table([rows.column("query").to_numpy()[: len(best)], point[among[best]], scores[best]], names=["query", "point", "score"])

    best = checkpointed(pairs.groupBy("query").applyInArrow(decide, "query long, point long, score double"))
    ids = best.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    ids = _top(ids, "query", k + 1, F.desc("score"), F.col("vec_id")).select("query", "score", "vec_id")
    answers = queries.join(ids, queries["point"] == ids["query"]).where("query_id != vec_id")
    # A key with several vectors asks with each; a candidate counts once, with its best score.
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    answers = _top(answers, "query_id", k, F.desc("score"), F.col("vec_id"))
    return answers.select("query_id", F.col("_kw_rank").cast("int").alias("rank"), "vec_id", "score")


def _measure(points: DataFrame, placed: DataFrame, k: int, share: float, n: int) -> int:
    """The window that holds the share of true neighbours on their best curve, of MEASURED points, or one of ONE_OF if these are fewer."""
    some = points.orderBy(F.xxhash64("vec", "point")).limit(max(1, min(MEASURED, n // ONE_OF))).select("point", "vec").collect()
    names, asked_vecs = [r.point for r in some], _matrix(pa.array([r.vec for r in some]))

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            point = batch.column(0).to_numpy()
            out = []
            for name, row in zip(names, asked_vecs @ _matrix(batch.column(1)).T):
                out += [(name, int(point[i]), float(row[i])) for i in _best(row, point, k + 1) if point[i] != name]
            kinds = (("query", pa.int64()), ("point", pa.int64()), ("score", pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(kinds)], names=[x for x, _ in kinds])

    true = points.select("point", "vec").mapInArrow(against, "query long, point long, score double")
    true = checkpointed(_top(true, "query", k, F.desc("score"), F.col("point")).select("query", "point"))  # MEASURED * k rows at most
    mine = placed.withColumnsRenamed({"point": "query", "places": "mine"})
    pairs = placed.join(F.broadcast(true), "point").select("query", "places").join(broadcast_if_small(mine.join(F.broadcast(true.select("query").distinct()), "query", "left_semi")), "query")
    apart = F.array_min(F.zip_with("places", "mine", lambda a, b: F.abs(a["place"] - b["place"])))
    row = pairs.select(apart.alias("d")).agg(F.percentile("d", F.lit(float(share))).alias("w")).first()
    return max(1, min(n, int(np.ceil(row.w or 1))))
