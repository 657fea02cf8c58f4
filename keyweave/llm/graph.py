"""Connected components of a graph given by edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm._common import checkpointed, in_few_parts


def _toward_least(edges: DataFrame, larger_only: bool, n: int) -> DataFrame:
    """For each node u of the n edges its least neighbour or itself, m; every neighbour v counted is tied to m instead of u.

    larger_only: neighbours above u are moved; else those below, and u itself. The least neighbours
    are kept in the shared folder first, so both sides of the join are plain shuffles, of which
    adaptive execution can split a hub's part.
    """
    if larger_only:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = checkpointed(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), 2 * n)
    moved = pairs.where("v > u") if larger_only else pairs
    out = in_few_parts(moved.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")), 2 * n)
    if not larger_only:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return in_few_parts(out.where("a != b").distinct(), 2 * n)


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of an edge (a, b) with the least node that it reaches.

    Alternates the two star operations until nothing changes; each round halves distances at least,
    so rounds grow with the logarithm of the longest path. Every round is kept in the shared folder.
    The edges are counted first, so they should be materialised; no round has more.
    """
    print_of = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    edges = checkpointed(edges.where("a != b").distinct(), edges.count())
    before = print_of(edges)
    while before.n:
        edges = checkpointed(_toward_least(_toward_least(edges, True, before.n), False, before.n), 2 * before.n)
        now = print_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
