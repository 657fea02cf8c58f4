import math
import re
from collections import defaultdict

import pytest

from keyweave.llm import mixing
from keyweave.llm.queries import op9_mixing
from tests.llm.conftest import DOCUMENT, ODD, with_extra

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = total / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not above:
            return target | {s: weight[s] * level for s in free}
        target |= {s: cap * sizes[s] for s in above}
        total -= sum(target[s] for s in above)
        free -= above
    return target


def checked(rows, made):
    sizes, largest = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for key, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
        largest[source][key, text] += len(WORD.findall(text or ""))
    target = plain_targets(sizes)
    by_key = defaultdict(list)
    for r in made:
        by_key[r.doc_id].append(r)
    taken = defaultdict(int)
    for key, text, _, source, _ in rows:
        size = len(WORD.findall(text or ""))
        r = next(r for r in by_key[key] if r["size"] == size and math.isclose(r.source_size, sizes[source]) and math.isclose(r.target, target[source], rel_tol=1e-9, abs_tol=1e-9))
        assert r.taken <= 2 * size and (size == 0 or r.taken % size == 0)
        taken[source] += r.taken
    for source in sizes:
        assert abs(taken[source] - target[source]) <= max(largest[source].values()) / 2 + 1e-6 * sizes[source]


def test_test_table(spark, sf_dir, documents, document_rows):
    made = op9_mixing(spark, sf_dir).collect()
    checked([tuple(r) for r in document_rows], made)
    again = mixing.mix_documents(documents.repartition(7)).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))


def test_odd_rows(odd, no_documents):
    made = mixing.mix_documents(odd).collect()
    assert len(made) == len(ODD)
    checked(ODD, made)
    assert mixing.mix_documents(no_documents).count() == mixing.repeat_documents(no_documents).count() == 0


def test_documents_of_a_source_are_tilted_by_length(spark):
    """Rates against a bisection of each source's dual over all its documents."""
    rows = [(i, "w " * (3 + (i * 7919) % 1500), "en", f"s{i % 4}", 1) for i in range(600)]
    sizes = {r[0]: len(r[1].split()) for r in rows}
    of = {r[0]: r[3] for r in rows}
    base = {k: 4 / (4 + abs(n.bit_length() - 1 - 8)) for k, n in sizes.items()}
    totals = defaultdict(int)
    for k, n in sizes.items():
        totals[of[k]] += n
    target, rate = plain_targets(totals), {}
    for source in totals:
        low, high, own = -50.0, 50.0, [k for k in sizes if of[k] == source]
        for _ in range(200):
            middle = (low + high) / 2
            takes = sum(sizes[k] * min(2.0, base[k] * math.exp(middle)) for k in own)
            low, high = (middle, high) if takes < target[source] else (low, middle)
        rate |= {k: min(2.0, base[k] * math.exp(low)) for k in own}
    made = mixing.mix_documents(spark.createDataFrame(rows, DOCUMENT)).collect()
    assert all(math.floor(rate[r.doc_id] + 1e-6) >= r.copies - 1 and r.copies >= math.floor(rate[r.doc_id] - 1e-6) for r in made)
    source = next(s for s in totals if target[s] < 1.5 * totals[s])
    assert len({round(rate[k], 6) for k in sizes if of[k] == source}) > 5
    checked(rows, made)


def test_hot_source_and_repeats(spark):
    rows = [(i, "a b c " * (1 + i % 5), "en", "hot" if i % 3 == 0 else f"s{i % 17}", 1) for i in range(900)] + [(5000, "x y z", "en", "s1", 1)] * 20
    df = with_extra(spark.createDataFrame(rows, DOCUMENT))
    checked(rows, mixing.mix_documents(df).collect())
    made = mixing.repeat_documents(df)
    assert made.columns == df.columns
    want = {(r.doc_id, r["size"]): r.copies for r in mixing.mix_documents(df).collect()}
    got = defaultdict(int)
    for r in made.collect():
        got[r.doc_id] += 1
    for (key, _), copies in want.items():
        assert got[key] == copies * (20 if key == 5000 else 1)


def test_base_rates_are_tilted(spark):
    """Newton's solution takes the targets, keeps ratios of base rates below the cap, and never exceeds it."""
    cells = spark.createDataFrame([("a", 1.0, 100), ("a", 3.0, 100), ("b", 0.001, 50), ("b", 5.0, 10), ("c", 1.0, 70), (None, 1.0, 0)], "source string, base double, size long")
    targets = spark.createDataFrame([("a", 200, 250.0), ("b", 60, 60.0), ("c", 70, 140.0), (None, 0, 0.0)], "source string, source_size long, target double")
    solved = {r.source: r.lambda_ for r in mixing.solve(cells, targets, 2.0).collect()}
    rate = lambda base, s: min(2.0, base * math.exp(solved[s]))
    assert math.isclose(100 * rate(1, "a") + 100 * rate(3, "a"), 250, rel_tol=1e-9)
    assert math.isclose(50 * rate(0.001, "b") + 10 * rate(5, "b"), 60, rel_tol=1e-9)
    assert rate(1, "c") == 2.0


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 500, "d": 1, None: 7}, {"x": 5}, {"a": 0, "b": 10}, {f"s{i:02}": (i * 37) % 101 for i in range(40)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-12, abs_tol=1e-9) for s in want)


def test_only_dataframe_operations(spark, documents):
    for df in (mixing.mix_documents(documents), mixing.repeat_documents(documents)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
