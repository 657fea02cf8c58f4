"""SimHash near-duplicates: 64-bit fingerprints linked by BK-trees, within a radius or by similarity.

By radius (near_duplicates):

Fingerprints that differ in at most 3 of 64 bits agree in one of four 16-bit bands, or in two of five
bands, three of six and so on. So distinct fingerprints are dealt out by (bands, their bits), longer ones
the more fingerprints there are, and each such shard has a BK-tree of its own;
the sum of all trees grows with the corpus, so a tree goes to the queries of its shard, never to
all executors. Links leave a task as a spanning forest, at most one per fingerprint, which keeps all that connects.

By similarity (similar_texts): texts whose sets of word shingles have a Jaccard similarity of 0.8
differ in some 10 bits, too many for bands. There the shards are made of texts that share two
minima of their shingles' hashes, in any of TABLES pairs; each shard's tree is asked with SIMILAR_RADIUS,
a signature of 128 minima thins out what it finds, and the sets of shingles decide. Trees and signatures come alone
first: what they connect is a group of candidates, outside which no pair is a link. Only texts of such a group send their sets, by
which a task decides exactly: once, if a tree holds the whole group, else with each shard, split by these groups. Shards with the same
members are one. Three pairs of minima come first; of the other pairs' shards only those follow whose members are not one group by then.

Large shards: a tree holds TREE (or SIMILAR_TREE) members, so a larger shard is cut into blocks by hash, each a
task. What is linked within blocks is one group from then on; one member of each group, dealt into blocks
anew, goes on while that at least halves the groups. What still lies apart is compared exactly: the members outside
each shard's largest group, in blocks that make the trees, with all members of the shard. So a family of near copies costs
a row for each member, and only members that have no link to it meet the others block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm._common import broadcast_if_small, checkpointed, small_batches
from keyweave.llm.graph import components
from keyweave.plans.frames import FILE_ROWS

#: The most fingerprints in one tree.
TREE = 2048
#: Numbers that should share a shard by chance.
FEW = 64
RADIUS = 3


def fingerprint(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text, 0 if it has no word. ASCII letters are lower-cased, words are runs without ASCII spaces."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each)))) if len(words) >= words_each else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], np.uint64)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))


def fingerprints_of(text: str):
    """Column of fingerprints as signed longs."""
    return F.pandas_udf(_fingerprints, "long")(F.col(text))


class BKTree:
    """Numbers under Hamming distance; a child hangs at its distance from the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def hits(self, value: int, radius: int) -> Iterator[int]:
        """Places of the numbers within the radius; only edges that can lead to one are followed."""
        stack = [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            stack += [child for edge, child in children[at].items() if d - radius <= edge <= d + radius]
            if d <= radius:
                yield at

    def within(self, value: int, radius: int) -> list[int]:
        return list(self.hits(value, radius))


class _Sets:
    """Disjoint sets of any values."""

    def __init__(self):
        self.parent: dict = {}

    def top(self, x):
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, a, b) -> bool:
        """Whether a and b were apart."""
        a, b = self.top(a), self.top(b)
        self.parent[a] = b
        return a != b


def _forest(values: list[int], labels: list, in_tree, same: bool, radius: int, alike: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Places (i, j) of links that connect what all pairs within the radius, of which alike accepts those that count, connect.

    Equal labels are connected already. same: pairs of any two; else of one in the tree and one not. A search ends when
    the tree has no other group left to be found.
    """
    tree, places, links, sets = BKTree(), [], [], _Sets()
    groups = set()  # those with a value in the tree
    for i in range(len(values)) if same else sorted(range(len(values)), key=lambda i: not in_tree[i]):
        own = sets.top(labels[i])
        if (same or not in_tree[i]) and groups - {own}:
            for at in tree.hits(values[i], radius):
                j = places[at]
                other = sets.top(labels[j])
                if other != own and (alike is None or alike(i, j)):
                    sets.join(other, own)
                    groups.discard(other)
                    groups.add(own)
                    links.append((int(i), int(j)))
                    if len(groups) == 1:
                        break
        if same or in_tree[i]:
            groups.add(own)
            tree.add(values[i])
            places.append(i)
    return links


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with the same first column, by which they are sorted; runs of one row are left out."""

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [c.to_numpy(zero_copy_only=False) for c in batch.columns]

    held: list[np.ndarray] | None = None
    for batch in chain((b for b in batches if len(b)), [None]):
        if batch is not None:
            rows = arrays(batch)
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last run may go on
            held = [x[cut:] for x in rows]
        elif held is not None:
            rows, cut = held, len(held[0])
        else:
            return
        edges = np.flatnonzero(np.diff(rows[0][:cut])) + 1
        starts, ends = np.r_[0, edges], np.r_[edges, cut]
        for i in np.flatnonzero(ends - starts > 1):
            yield [x[starts[i] : ends[i]] for x in rows]


def _link_batches(links: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for some in links:
        held += some
        if len(held) >= 10_000:
            yield _as_batch(held)
            held = []
    yield _as_batch(held)


def _as_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows (task, in_tree, same, label, node); a node is its fingerprint."""

    def links() -> Iterator[list[tuple[int, int]]]:
        for _, in_tree, same, label, node in _runs(batches):
            found = _forest(node.astype(np.uint64).tolist(), label.tolist(), in_tree, bool(same[0]), radius)
            yield [(int(node[i]), int(node[j])) for i, j in found]

    return _link_batches(links())


def _many(df: DataFrame) -> int:
    """The session's shuffle partitions; said outright, as few bytes mean much work here."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _blocks(n, block: int):
    return F.greatest(F.ceil(n / block), F.lit(1))


def link_members(members: DataFrame, payload: DataFrame | None, search: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], block: int, known: DataFrame | None = None, count: int | None = None) -> DataFrame:
    """Links a, b that connect the nodes as the links of all pairs in any shard would, known ones included.

    members: shard, node, n (the shard's members; null: few), and label, equal for nodes that known connects, if known is given. payload: node and what search gets of it after task, in_tree, same,
    label, node. search solves a task of about block rows, or of two blocks that meet. count: of members, if known.
    """
    parts, count = _many(members), members.count() if count is None else count

    def solved(tasks: DataFrame) -> DataFrame:
        columns = ["task", "in_tree", "same", "label", "node"]
        rows = tasks.select(*columns) if payload is None else tasks.join(payload, "node").select(*columns, *[c for c in payload.columns if c != "node"])
        rows = rows.repartition(parts, "task").sortWithinPartitions("task", "node")
        found = rows.mapInArrow(search, "a long, b long")  # in many tasks, of which few have much to keep
        return checkpointed(found.repartition(max(1, -(-count // FILE_ROWS))))

    def dealt(rows: DataFrame, n, turn: int) -> DataFrame:
        """Rows with shard, node, label, cut into blocks by hash, another one each turn."""
        at = F.pmod(F.xxhash64("node", F.lit(turn)), _blocks(n, block))
        return rows.select(F.xxhash64("shard", at).alias("task"), F.lit(True).alias("in_tree"), F.lit(True).alias("same"), "label", "node")

    links = solved(dealt(members if known is not None else members.withColumn("label", F.col("node")), F.coalesce("n", F.lit(1)), 0))
    links = links if known is None else known.unionAll(links)
    large = checkpointed(members.where(F.col("n") > block).select("shard", "node", "n"), count)
    if not (rows := large.count()):
        return links
    before = None
    for turn in range(1, 64):
        named = checkpointed(components(links), count).withColumnRenamed("node", "_kw_node")
        current = checkpointed(large.join(named, F.col("node") == F.col("_kw_node"), "left").select("shard", "node", "n", F.coalesce("root", "node").alias("label")), rows)
        groups = checkpointed(current.groupBy("shard", "label").agg(F.min("node").alias("node"), F.count("*").alias("size")), rows)
        largest = F.max(F.struct("size", "label")).alias("most")
        shards = checkpointed(groups.groupBy(F.col("shard").alias("_kw_shard")).agg(F.count("*").alias("groups"), largest).where("groups > 1"), rows)
        shards = broadcast_if_small(shards)
        now = groups.join(shards, F.col("shard") == F.col("_kw_shard"))
        apart = now.count()
        if not apart:
            return links
        if before is not None and 2 * apart > before:
            break
        before = apart
        links = links.unionAll(solved(dealt(now, F.col("groups"), turn)))
    rows = current.join(shards, F.col("shard") == F.col("_kw_shard")).withColumn("others", F.col("n") - F.col("most.size"))
    of_others, of_all = _blocks(F.col("others"), block), _blocks(F.col("n"), block)
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    sides = []
    for in_tree in (True, False):
        some = rows.where(F.col("label") != F.col("most.label")) if in_tree else rows
        own = F.pmod(F.xxhash64("node"), of_others if in_tree else of_all)
        some = some.withColumn("own", own).withColumn("met", all_of(of_all if in_tree else of_others))
        task = F.xxhash64("shard", *(("own", "met") if in_tree else ("met", "own")))
        sides.append(some.select(task.alias("task"), F.lit(in_tree).alias("in_tree"), F.lit(False).alias("same"), "label", "node"))
    return links.unionAll(solved(sides[0].unionAll(sides[1])))


def band_masks(n: int, radius: int) -> list[int]:
    """Masks over 64 bits, on one of which at least two numbers within the radius agree.

    The bits are cut into pieces, more than the radius, and a mask is all but radius of the pieces. More
    pieces make longer and more masks; as few are taken as leave FEW of n numbers on a mask's value.
    """
    for pieces in range(radius + 1, 2 * radius + 3):
        if n >> (64 * (pieces - radius) // pieces) <= FEW:
            break
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    return [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen) for chosen in combinations(range(pieces), pieces - radius)]


def link_fingerprints(values: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links a, b that connect all numbers of values (one long column fp, distinct) at radius or fewer differing bits.

    The links are a forest per task, not all pairs. Every pair within the radius agrees on one of the band
    masks at least. values are counted, so they should be materialised.
    """
    masks = band_masks(n := values.count(), radius)
    part, n = F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)) for m in masks]), n * len(masks)
    rows = values.select(F.col("fp").alias("node"), F.posexplode(part).alias("band", "part")).select("node", F.xxhash64("band", "part").alias("shard"))
    large = broadcast_if_small(checkpointed(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tree), n))
    return link_members(rows.join(large, "shard", "left"), None, lambda batches: _search(batches, radius), tree, count=n)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of df: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id reached over fingerprints that differ in radius or fewer bits.
    Null, empty and blank texts have fingerprint zero and are linked like others. Long texts are read
    whole. Equal fingerprints are one node, so copies cost nothing. Null keys are passed over for
    component_id, which is null only if all keys of the component are. Repeated rows keep a row each;
    an empty table gives an empty result; other columns are not looked at.
    """
    with small_batches(df.sparkSession):
        rows = checkpointed(df.select(F.col(key).alias("doc_id"), fingerprints_of(text).alias("fp")))
    return _grouped_by_radius(rows, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(nodes: DataFrame, node: str, links: DataFrame, n: int) -> DataFrame:
    """nodes (n, with node and least) with group, the least node reached, and component_id, the least key reached."""
    found = checkpointed(components(links), n)
    linked = nodes.join(found, nodes[node] == found["node"])
    roots = checkpointed(linked.groupBy("root").agg(F.min("least").alias("root_least")), n)
    named = found.join(broadcast_if_small(roots), "root").select(F.col("node").alias("_kw_node"), "root", "root_least")
    joined = nodes.join(named, nodes[node] == named["_kw_node"], "left")
    component = F.when(F.col("root").isNotNull(), F.col("root_least")).otherwise(F.col("least"))
    return joined.withColumn("component_id", component).withColumn("group", F.coalesce("root", node)).drop("_kw_node", "root", "root_least")


def _grouped_by_radius(rows: DataFrame, radius: int) -> DataFrame:
    """rows (with doc_id and fp) with component_id and group."""
    n = rows.count()
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), n)
    named = checkpointed(_named(nodes, "fp", link_fingerprints(nodes.select("fp"), radius), n).select(F.col("fp").alias("_kw_fp"), "component_id", "group"), n)
    return rows.join(named, rows["fp"] == named["_kw_fp"]).drop("_kw_fp")


#: Minima in a signature, pairs of them that make shards, and bits within which trees look. Of pairs at a similarity
#: of 0.8, 8e-8 share no shard and at most 4e-9 differ in more bits.
MINIMA, TABLES, SIMILAR_RADIUS = 128, 16, 32
#: How far the signature's estimate may lie below the similarity: six standard deviations, beyond which 8e-9 of pairs at 0.8 are.
SLACK = 0.22
#: The most sets of shingles in one tree.
SIMILAR_TREE = 512
#: Pairs of minima whose shards are solved first; of the others' shards only those follow whose members are not yet one group.
FIRST_TABLES = 3

_RANDOM = np.random.default_rng(42)
_MULTIPLY = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_hashes(text: str | None, words_each: int) -> np.ndarray:
    """Distinct hashes of a whole text's shingles, sorted; a text of fewer words is one shingle, one without words a single zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each)))) if len(words) >= words_each else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in shingles], np.uint64))


def jaccard(left: str | None, right: str | None, words_each: int) -> float:
    a, b = shingle_hashes(left, words_each), shingle_hashes(right, words_each)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signature(text: str | None, words_each: int) -> tuple[int, list[int], bytes]:
    """Fingerprint of the set of shingles, shard keys, and a byte of each minimum."""
    hashes = shingle_hashes(text, words_each)
    counts, least = np.zeros(64, np.int64), np.full(MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (some[:, None] * _MULTIPLY + _ADD).min(axis=0))
    fp = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0]
    first, second = least[: 2 * TABLES : 2], least[1 : 2 * TABLES : 2]
    keys = ((first * _MULTIPLY[:TABLES]) ^ (second >> np.uint64(7))) * _MULTIPLY[TABLES : 2 * TABLES] + second
    return int(fp), keys.view(np.int64).tolist(), (least >> np.uint64(40)).astype(np.uint8).tobytes()


def _signatures(words_each: int):
    def signatures(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signature(t, words_each) for t in texts], columns=["fp", "keys", "minima"])

    return F.pandas_udf(signatures, "fp long, keys array<long>, minima binary").asNondeterministic()


def _shingle_bytes(words_each: int):
    def shingle_bytes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, words_each).tobytes() for t in texts], dtype="object")

    return F.pandas_udf(shingle_bytes, "binary").asNondeterministic()


def _estimate(signs: np.ndarray, i: int, j: int) -> float:
    return np.count_nonzero(signs[i] == signs[j]) / signs.shape[1]


def _similar_forest(shingles: list[np.ndarray], in_tree, same: bool, similarity: float, values: list[int] | None = None, minima: list[bytes] | None = None, labels: list | None = None) -> list[tuple[int, int]]:
    """_forest of sets that are similar, among what the tree of values finds and the minima leave; without these, among all."""
    sizes = np.array([len(x) for x in shingles])
    known, flat = np.unique(np.concatenate(shingles), return_inverse=True)
    ids = np.split(flat, np.cumsum(sizes)[:-1])
    signs = None if minima is None else np.frombuffer(b"".join(minima), np.uint8).reshape(len(sizes), -1)
    marked, of = np.zeros(len(known), bool), -1

    def alike(i: int, j: int) -> bool:
        nonlocal of
        if min(sizes[i], sizes[j]) < similarity * max(sizes[i], sizes[j]) - 1:
            return False
        if signs is not None and _estimate(signs, i, j) < similarity - SLACK:
            return False
        if of != i:
            marked[:] = False
            marked[ids[i]] = True
            of = i
        both = np.count_nonzero(marked[ids[j]])
        return both / (sizes[i] + sizes[j] - both) >= similarity

    places = range(len(sizes))
    return _forest(values or [0 for _ in places], labels or list(places), in_tree, same, SIMILAR_RADIUS, alike)


def _search_similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of rows (task, in_tree, same, label, node, fp, minima, shingles)."""

    def links() -> Iterator[list[tuple[int, int]]]:
        for _, in_tree, same, label, node, fp, minima, shingles in _runs(batches):
            sets = [np.frombuffer(x, np.uint64) for x in shingles]
            found = _similar_forest(sets, in_tree, bool(same[0]), similarity, fp.astype(np.uint64).tolist(), list(minima), label.tolist())
            yield [(int(node[i]), int(node[j])) for i, j in found]

    return _link_batches(links())


def _search_candidates(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of rows (task, in_tree, same, label, node, fp, minima) between all that _search_similar would compare by their sets."""

    def links() -> Iterator[list[tuple[int, int]]]:
        for _, in_tree, same, label, node, fp, minima in _runs(batches):
            signs = np.frombuffer(b"".join(minima), np.uint8).reshape(len(node), -1)
            alike = lambda i, j: _estimate(signs, i, j) >= similarity - SLACK  # noqa: B023, E731
            found = _forest(fp.astype(np.uint64).tolist(), label.tolist(), in_tree, bool(same[0]), SIMILAR_RADIUS, alike)
            yield [(int(node[i]), int(node[j])) for i, j in found]

    return _link_batches(links())


def _texts_of(df: DataFrame, text: str, some: DataFrame) -> DataFrame:
    """node and text for each of some (node, hash), a checkpointed frame; other texts are not moved."""
    some = some.select("node", F.col("hash").alias("_kw_hash"))
    texts = df.select(F.xxhash64(F.col(text)).alias("hash"), F.col(text).cast("string").alias("text"))
    return texts.join(broadcast_if_small(some), F.col("hash") == F.col("_kw_hash")).groupBy("node").agg(F.first("text").alias("text"))


def link_similar(nodes: DataFrame, df: DataFrame, text: str, words_each: int, similarity: float, tree: int | None = None) -> DataFrame:
    """Links a, b that connect similar nodes (node, hash, fp, keys, minima), whose texts are in df."""
    n = nodes.count()
    most = n * TABLES
    rows = nodes.select("node", F.posexplode("keys").alias("table", "key"))
    rows = rows.select("node", "table", F.xxhash64("table", "key").alias("shard"))

    def members(rows: DataFrame, label) -> DataFrame:
        """shard, node, n, label of shards with several groups. Near copies share many shards; of those with the same members one will do, told by their number and two hashes of all."""
        marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
        rows = rows.withColumn("label", label)
        shards = rows.groupBy("shard").agg(F.count("*").alias("n"), *marks, F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        shards = checkpointed(shards.groupBy("n", "x0", "x1").agg(F.min("shard").alias("shard")).select("shard", "n"), most)
        return checkpointed(rows.join(broadcast_if_small(shards), "shard").select("shard", "node", "n", "label"), most)

    def with_sets(members: DataFrame) -> DataFrame:
        several = checkpointed(members.select("node").distinct().join(nodes.select("node", "hash"), "node"), n)
        sets = _texts_of(df, text, several).select("node", _shingle_bytes(words_each)("text").alias("shingles"))
        return checkpointed(nodes.select("node", "fp", "minima").join(sets, "node"))

    search, tree = lambda batches: _search_similar(batches, similarity), tree or SIMILAR_TREE
    every = members(rows, F.col("node")).drop("label")
    signs = checkpointed(nodes.select("node", "fp", "minima").join(every.select("node").distinct(), "node"), n)
    near = checkpointed(components(link_members(every, signs, lambda batches: _search_candidates(batches, similarity), tree)), n)
    sizes = broadcast_if_small(checkpointed(near.groupBy("root").agg(F.count("*").alias("n")), n))
    near = checkpointed(near.join(sizes, "root").select("node", F.col("root").alias("candidates"), "n"), n)
    whole = near.where(F.col("n") <= tree).select(F.xxhash64("candidates").alias("shard"), "node", "n", F.col("node").alias("label"))
    split = broadcast_if_small(checkpointed(near.where(F.col("n") > tree).select(F.col("node").alias("_kw_near"), "candidates"), n))
    rows = rows.join(split, F.col("node") == F.col("_kw_near"))
    rows = checkpointed(rows.select("node", "table", F.xxhash64("shard", "candidates").alias("shard")), most)
    first = checkpointed(whole.unionByName(members(rows.where(F.col("table") < FIRST_TABLES), F.col("node"))), n + most)
    links = link_members(first.drop("label"), with_sets(first), search, tree)
    named = checkpointed(components(links), n).withColumnRenamed("node", "_kw_node")
    rest = rows.where(F.col("table") >= FIRST_TABLES).join(broadcast_if_small(named), F.col("node") == F.col("_kw_node"), "left")
    rest = members(rest, F.coalesce("root", "node")).select("shard", "node", "n", "label")
    if rest.isEmpty():
        return links
    return link_members(rest, with_sets(rest), search, tree, links)


def _grouped_by_similarity(df: DataFrame, key: str, text: str, words_each: int, similarity: float) -> tuple[DataFrame, int]:
    """doc_id, hash (of the text), component_id and group of each row of df, and how many these are."""
    made = df.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), _signatures(words_each)(F.col(text)).alias("s"))
    with small_batches(df.sparkSession):
        rows = checkpointed(made.select("doc_id", "hash", "s.*"))
        n = rows.count()
        nodes = rows.groupBy("hash", "fp", "keys", "minima").agg(F.min("doc_id").alias("least"))
        nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()), n * TABLES)
        links = link_similar(nodes, df, text, words_each, similarity)
    named = checkpointed(_named(nodes.select("node", "hash", "fp", "least"), "node", links, n).select(F.col("hash").alias("_kw_hash"), F.col("fp").alias("_kw_fp"), "component_id", "group"), n)
    return rows.select("doc_id", "hash", "fp").join(named, (F.col("hash") == F.col("_kw_hash")) & (F.col("fp") == F.col("_kw_fp"))).select("doc_id", "hash", "component_id", "group"), n


def similar_texts(df: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of df: doc_id, component_id.

    Texts are linked if the sets of their shingles of words_each words have a Jaccard similarity of at
    least similarity; component_id is the least doc_id reached. No pair below the similarity is linked. A
    pair at 0.8 is missed by shard, radius or estimate with a probability of 1e-7 in all, a closer one
    with less, whatever the size of its group.

    Null, empty and blank texts are alike; a text of fewer words is one shingle. Long texts are read whole.
    Null keys are passed over for component_id. Repeated rows keep a row each; an empty table gives an
    empty result; other columns are not looked at.
    """
    return _grouped_by_similarity(df, key, text, words_each, similarity)[0].select("doc_id", "component_id")


def keep_one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words_each: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of df with all columns, of each component of similar_texts only that with the least key (null keys last).

    If several rows of a component share that key, one of them stays, that with the least hash of its text.
    Only the dropped keys and text hashes are joined back, as an anti join, so texts are not shuffled
    while these are few, and keys need not be unique.
    """
    found, n = _grouped_by_similarity(df, key, text, words_each, similarity)
    grouped = checkpointed(found.groupBy("group", "doc_id", "hash").agg(F.count("*").alias("n")), n)
    best = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("best"))
    joined = grouped.join(checkpointed(best, n), "group")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("hash") == F.col("best.hash"))
    fates = checkpointed(joined.select(F.col("doc_id").alias("_kw_key"), F.col("hash").alias("_kw_hash"), stays.alias("stays"), "n"), n)
    gone = broadcast_if_small(checkpointed(fates.where("not stays").select("_kw_key", "_kw_hash"), n))
    same = F.col(key).eqNullSafe(F.col("_kw_key")) & (F.xxhash64(F.col(text)) == F.col("_kw_hash"))
    kept = df.join(gone, same, "left_anti")
    # Equal key and text more than once: rare, and only then rows must meet.
    repeated = fates.where("stays and n > 1").select("_kw_key", "_kw_hash")
    if not repeated.limit(1).count():
        return kept
    repeated = broadcast_if_small(checkpointed(repeated, n))
    once = kept.join(repeated, same, "left_anti")
    return once.unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([key, text]))
