import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyweave.llm import ann
from tests.llm.conftest import with_extra

VECTOR = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k=5):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    cos = lambda a, b: float(np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)))
    out = []
    for q in sorted({i for i, _ in ok if is_query(i)}):
        best = {}
        for own, v in ok:
            if own == q:
                for i, w in ok:
                    if i != q:
                        best[i] = max(best.get(i, -2), round(cos(np.array(v, np.float64), np.array(w, np.float64)), 12))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, rank, i, s))
    return out


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in df.collect())


def test_recall(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = vectors.collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    made = ann.nearest(vectors, F.col("id") % 10 == 0).collect()
    found = {}
    for r in made:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 10 == 0):
        scores = x @ x[q]
        scores[q] = -2
        mine = sorted(found[int(ids[q])])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s - scores[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in mine)
        assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        hits += len({m[1] for m in mine} & set(ids[np.argsort(-scores)[:5]].tolist()))
    assert hits >= 0.9 * 5 * (ids % 10 == 0).sum()


ODD = [
    (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("inf"), 0.0, 1.0]), (7, []),
    (8, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (10, [0.0, 1.0, 0.0]), (10, [0.0, 1.0, 0.0]), (20, [0.0, 0.0, 1.0]), (20, [1.0, 1.0, 0.0]), (30, [-1.0, 0.0, 0.0]), (31, [2.0**-100, 2.0**-100, 0.0]),
] + [(100 + i, [0.6, 0.8, 0.0]) for i in range(12)]


def test_odd_rows(spark):
    df = with_extra(spark.createDataFrame([(i, v, 1) for i, v in ODD], VECTOR)).repartition(3)
    as_float = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in ODD]
    got, want = rows(ann.nearest(df, F.col("id") % 10 == 0)), brute(as_float, lambda i: i % 10 == 0)
    assert got == want


def test_few_rows_and_none(spark):
    made = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1)], VECTOR)
    assert rows(ann.nearest(made, F.lit(True))) == [(0, 1, 1, 0.0), (1, 1, 0, 0.0)]
    assert ann.nearest(made.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(made, F.lit(False)).count() == 0
    assert ann.nearest(made.limit(1), F.lit(True)).count() == 0


def test_copies_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(0)
    data = [(i, (np.ones(8) if i % 3 == 0 else rng.normal(size=8)).tolist(), 1) for i in range(600)]
    made = ann.nearest(spark.createDataFrame(data, VECTOR), F.col("id") % 60 == 0)
    got = {}
    for q, _, v, s in rows(made):
        got.setdefault(q, []).append((v, s))
    for q, found in got.items():
        assert [v for v, _ in found] == [i for i in range(0, 18, 3) if i != q][:5] and all(s == 1.0 for _, s in found)


def test_multiples_tie(spark):
    """Vectors that are multiples of each other score alike, whatever their lengths, so the smaller key comes first."""
    rng, data = np.random.default_rng(2), []
    for i in range(40):
        v = rng.integers(-9, 10, 16).astype(float)
        data += [(10 * i + j, (v * m).tolist(), 1) for j, m in enumerate((3, 1, 7, 5, 11))]
    made = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), F.col("id") % 10 == 4)
    got = {}
    for r in made.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert len(got) == 40
    for q, found in got.items():
        assert [v for _, v, _ in sorted(found)][:4] == [q - 4, q - 3, q - 2, q - 1] and {s for _, _, s in sorted(found)[:4]} == {1.0}
    a, b = rng.integers(-99, 99, 64).tolist(), rng.integers(-99, 99, 64).tolist()
    assert len({ann.exact_cosine(a, [m * x for x in b]) for m in range(1, 200)}) == 1
    assert math.isclose(ann.exact_cosine(a, b), np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)), rel_tol=1e-15)


def test_few_vectors_are_fetched_for_a_query(spark, monkeypatch):
    """Beyond the codes, a query meets REFINE vectors, however wide the windows."""
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=24).tolist(), 1) for i in range(1500)]
    whole, x = ann.nearest(spark.createDataFrame(data, VECTOR), F.col("id") % 50 == 0).collect(), np.array([v for _, v, _ in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = sum(r.vec_id in np.argsort(-(x @ x[r.query_id]))[1:6] for r in whole)
    assert ann.REFINE <= 0.05 * len(data) and hits >= 0.9 * 5 * 30


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (8, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = ann.hilbert_keys(cells, bits)
    order = np.argsort(keys)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()
