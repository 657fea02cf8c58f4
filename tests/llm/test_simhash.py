import os

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keyweave.llm import simhash
from keyweave.llm.graph import components
from keyweave.llm.simhash import BKTree, fingerprint, jaccard, keep_one_of_each, link_fingerprints, near_duplicates, similar_texts
from tests.llm.conftest import DOCUMENT, ODD, with_extra


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=3):
    values, label = list(values), {v: v for v in values}
    near = {v: [w for w in values if (v ^ w).bit_count() <= radius] for v in values}
    for v in values:
        seen, stack = {v}, [v]
        while stack:
            for w in near[stack.pop()]:
                if w not in seen:
                    seen.add(w)
                    stack.append(w)
        label[v] = frozenset(seen)
    return label


def brute(rows):
    rows = [(r[0], plain_fingerprint(r[1])) for r in rows]
    groups = plain_components({f for _, f in rows})
    least = {g: min((k for k, f in rows if f in g and k is not None), default=None) for g in set(groups.values())}
    return sorted(((k, f"{f:016x}", least[groups[f]]) for k, f in rows), key=str)


def test_against_plain_python(documents, document_rows):
    assert sorted((tuple(r) for r in near_duplicates(documents).collect()), key=str) == brute(document_rows)


def test_odd_rows(spark, odd, no_documents):
    small = [r for r in ODD if r[0] != 6]
    assert sorted((tuple(r) for r in near_duplicates(with_extra(spark.createDataFrame(small, DOCUMENT))).collect()), key=str) == brute(small)
    assert near_duplicates(odd).count() == len(ODD)
    assert near_duplicates(no_documents).count() == 0
    assert fingerprint("word " * 200_000) == fingerprint("word word word")


@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_masks_cover_all_pairs(n):
    masks, rng = simhash.band_masks(n, 3), np.random.default_rng(2)
    for _ in range(500):
        a = int(rng.integers(0, 1 << 63)) * 2
        b = a ^ sum(1 << int(bit) for bit in rng.choice(64, 3, replace=False))
        assert any((a ^ b) & m == 0 for m in masks)
    assert len(masks) == {10: 4, 10**7: 10, 10**10: 20}[n]


@pytest.mark.parametrize(("tree", "few"), [(2048, 64), (3, 64), (2048, 0)])
def test_links_connect_like_all_pairs(spark, tree, few, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(5)
    values = {0, (1 << 64) - 1}
    for _ in range(40):  # chains in which each step flips up to four bits
        v = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(8):
            values.add(v)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(bit)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = link_fingerprints(df, tree=tree)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in edges.collect())
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
    groups = plain_components(values)
    for v in values:
        assert (v in found) == (len(groups[v]) > 1)
        if v in found:
            assert found[v] in groups[v] and {w for w in groups[v]} == {w for w in found if found[w] == found[v]}


def test_tree_follows_the_edges_it_must():
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(0, 1 << 12, 500)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.range(n).select(((F.col("id") * 7919) % 1000003).alias("a"), (((F.col("id") + 1) * 7919) % 1000003).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0}
    star = spark.range(1, 500).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(star).where("root = 0").count() == 500
    assert components(edges.limit(0)).count() == 0


def test_one_of_each_stays(spark, odd, no_documents):
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(str(r.doc_id) for r in rows if r.text is None or not r.text.split()) == ["1"]
    assert [r.doc_id for r in rows if r.text == "One two three four five."] == [4]
    assert keep_one_of_each(no_documents).count() == 0
    nobody = spark.createDataFrame([(None, "a b c", "x", "y", 1), (None, "a b c", "x", "y", 1), (None, "d e f", "x", "y", 1)], DOCUMENT)
    assert sorted(r.text for r in keep_one_of_each(nobody).collect()) == ["a b c", "d e f"]
    keys = [(1, "a b c d", "x", "y", 1), (1, "p q r s", "x", "y", 1), (2, "p q r s", "x", "y", 1), (0, "a b c d", "x", "y", 1)]
    assert sorted((r.doc_id, r.text) for r in keep_one_of_each(spark.createDataFrame(keys, DOCUMENT)).collect()) == [(0, "a b c d"), (1, "p q r s")]


def shingles(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").encode().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def plain_similar(rows, similarity=0.8):
    """The least key reached over texts with similar sets of shingles."""
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= similarity * (len(a) + len(sets[j]) - both):
                label[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r[0])
    return sorted(((r[0], min((k for k in groups[top(i)] if k is not None), default=None)) for i, r in enumerate(rows)), key=str)


def near_copies(n, families=12, words=150):
    """Texts of families: each is its family's text with some words replaced."""
    rng, rows = np.random.default_rng(3), []
    for i in range(n):
        family = i % families if i % 3 else 0
        base = [f"w{family}x{j}" for j in range(words + 40 * family)]
        for at in rng.integers(0, len(base), rng.integers(0, 4 + family)):
            base[at] = f"new{i}y{at}"
        rows.append((i, " ".join(base).capitalize(), "en", "a", 1))
    return rows


@pytest.mark.parametrize("tree", [simhash.SIMILAR_TREE, 20])
def test_similar_texts_against_all_pairs(spark, document_rows, tree, monkeypatch):
    monkeypatch.setattr(simhash, "SIMILAR_TREE", tree)
    rows = near_copies(300) + [(1000 + r.doc_id, r.text, r.lang, r.source, 1) for r in document_rows]
    made = similar_texts(with_extra(spark.createDataFrame(rows, DOCUMENT)).repartition(3))
    got, want = sorted((tuple(r) for r in made.collect()), key=str), plain_similar(rows)
    assert sum(a != b for a, b in zip(got, want)) == 0
    assert 12 < len({c for _, c in want}) - len({r.text for r in document_rows}) < 300


@pytest.mark.parametrize("tree", [simhash.SIMILAR_TREE, 100])
def test_links_among_many_siblings(spark, tree, monkeypatch):
    """Copies that are similar to their base, not to each other: estimates of some siblings top the true link."""
    monkeypatch.setattr(simhash, "SIMILAR_TREE", tree)
    rng, base = np.random.default_rng(11), [f"w{j}" for j in range(200)]
    rows = [(0, " ".join(base), "en", "a", 1)]
    for i in range(1, 500):
        words = list(base)
        for at in rng.choice(39, 4, replace=False) * 5 + 4:
            words[at] = f"new{i}y{at}"
        rows.append((i, " ".join(words), "en", "a", 1))
    made = similar_texts(spark.createDataFrame(rows, DOCUMENT).repartition(3))
    got, want = sorted((tuple(r) for r in made.collect()), key=str), plain_similar(rows)
    assert {c for _, c in want} == {0}
    assert [a for a, b in zip(got, want) if a != b] == []


def test_pairs_at_the_similarity_pass_every_filter():
    lost = dict.fromkeys(("shard", "radius", "estimate"), 0)
    for i in range(5000):
        shared = " ".join(f"w{i}x{j}" for j in range(160))
        texts = [shared + "".join(f" {side}{i}x{j}" for j in range(20)) for side in "ab"]
        (fp, keys, minima), (fp2, keys2, minima2) = (simhash.signature(t, 1) for t in texts)
        lost["shard"] += not set(keys) & set(keys2)
        lost["radius"] += ((fp ^ fp2) & (1 << 64) - 1).bit_count() > simhash.SIMILAR_RADIUS
        lost["estimate"] += np.mean(np.frombuffer(minima, np.uint8) == np.frombuffer(minima2, np.uint8)) < 0.8 - simhash.SLACK
    assert jaccard(*texts, 1) == 0.8 and not any(lost.values()), lost


def test_forest_connects_what_all_similar_pairs_connect():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(150)]
    in_tree = rng.random(150) < 0.5
    for same in (True, False):
        similar = {(i, j) for i in range(150) for j in range(i) if (same or in_tree[i] != in_tree[j]) and len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.6}
        links = simhash._similar_forest(sets, in_tree, same, 0.6)
        assert {(max(x), min(x)) for x in links} <= similar
        joined, all_joined = simhash._Sets(), simhash._Sets()
        assert all(joined.join(*x) for x in links)
        assert sum(all_joined.join(*x) for x in similar) == len(links) > 0


def test_similarity_is_exact():
    assert jaccard(None, " ", 5) == jaccard("a b c d e f", "A B  C\nd e f", 5) == 1.0
    assert jaccard("a b c d e f", "a b c d e g", 5) == 1 / 3 and jaccard("a b", "a c", 5) == 0.0


def test_similar_odd_rows(odd, no_documents):
    assert sorted((tuple(r) for r in similar_texts(odd).collect()), key=str) == plain_similar(ODD)
    assert similar_texts(no_documents).count() == 0


@pytest.mark.parametrize(("seed", "tree"), [(1, 512), (2, 512), (3, 512), (1, 64)])
def test_borderline_families(spark, seed, tree, monkeypatch):
    """400 texts of one family, two or three edits each: most pairs lie around the similarity."""
    monkeypatch.setattr(simhash, "SIMILAR_TREE", tree)
    rng, rows = np.random.default_rng(seed), []
    for i in range(400):
        words = [f"w{j}" for j in range(120)]
        for at in rng.choice(120, rng.integers(2, 4), replace=False):
            words[at] = f"new{i}y{at}"
        rows.append((i, " ".join(words), "en", "a", 1))
    made = similar_texts(spark.createDataFrame(rows, DOCUMENT).repartition(3))
    got, want = sorted((tuple(r) for r in made.collect()), key=str), plain_similar(rows)
    assert 100 < len({c for _, c in want}) < 390
    assert [x for x in zip(got, want) if x[0] != x[1]] == []


def test_rows_of_a_large_family_grow_in_proportion(spark, tmp_path):
    """A family that hangs together costs a row for each member and turn, not one for each pair of blocks."""
    n, log = 4000, str(tmp_path)
    rng = np.random.default_rng(8)
    near = {0}
    while len(near) < n:  # numbers of up to three bits are three steps from zero
        near.add(sum(1 << int(b) for b in rng.choice(62, 3, replace=False)))
    members = spark.createDataFrame([(7, v, n) for v in near], "shard long, node long, n long")

    def search(batches):
        import uuid

        held = list(batches)
        with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
            out.write(str(sum(map(len, held))))
        yield from simhash._search(iter(held), 3)

    links = simhash.link_members(members, None, search, 64)
    rows = sum(int(open(f"{log}/{f}").read()) for f in __import__("os").listdir(log))
    joined = plain_components(near)
    assert len({c.root for c in components(links).collect()}) == len({g for g in joined.values() if len(g) > 1}) == 1
    assert n <= rows < 12 * n  # the pairs of its 63 blocks would have 64 * n


def test_small_frames_are_kept_in_few_files(spark, document_rows):
    """However many the shuffle partitions: each file costs processes when written and a task when read."""
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    files = lambda: sum(f.startswith("part-") for _, _, some in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")) for f in some)
    rows, had = spark.createDataFrame(document_rows, DOCUMENT), files()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert sorted((tuple(r) for r in near_duplicates(rows.repartition(3)).collect()), key=str) == brute(document_rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < files() - had < 2 * 48  # a file for each partition of each frame made 195


def test_small_graphs_take_few_tasks(spark):
    """However many the shuffle partitions, also between the frames that are kept."""
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, context = {k: spark.conf.get(k) for k in held}, spark.sparkContext
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("small graph", "")
        assert {r.root for r in components(edges).collect()} == {0}
        said = context.statusTracker()
        stages = {s for j in said.getJobIdsForGroup("small graph") for s in said.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(said.getStageInfo, stages) if i)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < tasks < 2000  # 1658; with stages of all partitions between them 3088
