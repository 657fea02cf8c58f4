"""Hashes of keys and the multimap from hashes to row ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.plans.frames import broadcast_if_small, with_position
from keyweave.sources.arrow import data_width

HASH_WIDTH_BYTES = 8
#: A turn of probe_page takes so many times more probes than the one before; above MOST_PROBES it takes all that are left.
MORE_PROBES, MOST_PROBES = 32, 1 << 20


def identity_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """The first key column taken as the hash; it must be 8 bytes wide."""
    if not keys:
        raise ValueError("no key column to hash")
    if data_width(df.schema[keys[0]].dataType) != HASH_WIDTH_BYTES:
        raise ValueError(f"the first key column must be {HASH_WIDTH_BYTES} bytes wide")
    return F.col(keys[0]).cast("long")


def key_hash(*keys: str) -> Column:
    return F.xxhash64(*keys)


def probe_hashes(build: DataFrame, probe: DataFrame, hash_name: str = "hash", row_id: str = "row_id", probe_idx: str = "probe_idx") -> DataFrame:
    """probe_idx and row_id of every match of hashes, as a bag; a hash finds all its rows. Null hashes find nothing."""
    build = build.select(F.col(hash_name).alias("_kw_build"), F.col(row_id).alias("row_id"))
    probe = probe.select(F.col(probe_idx).alias("probe_idx"), F.col(hash_name).alias("_kw_probe"))
    return build.join(probe, F.col("_kw_build") == F.col("_kw_probe")).select("probe_idx", "row_id")


def probe_pages(matches: DataFrame, rows_per_page: int) -> DataFrame:
    """matches of probe_hashes with page: in the order of probe_idx, then row_id, every rows_per_page of them are one."""
    if rows_per_page < 1:
        raise ValueError("rows_per_page must be 1 or more")
    placed = with_position(matches, "_kw_match", "probe_idx", "row_id")
    return placed.withColumn("page", F.floor(F.col("_kw_match") / rows_per_page).cast("long")).drop("_kw_match")


def next_page(matches: DataFrame, rows_per_page: int, after: tuple[int, int] | None = None) -> DataFrame:
    """The first matches, in the order of probe_idx, then row_id, beyond the match after, with which the page before ended; with None, from the start.

    To go on, pass the last row of a page; an empty page is the end. Each task sorts no more than a page.
    """
    if after is not None:
        probe, row = after
        matches = matches.where((F.col("probe_idx") > probe) | ((F.col("probe_idx") == probe) & (F.col("row_id") > row)))
    return matches.orderBy("probe_idx", "row_id").limit(rows_per_page)


def probe_page(build: DataFrame, probe: DataFrame, rows_per_page: int, after: tuple[int, int] | None = None, hash_name: str = "hash", row_id: str = "row_id", probe_idx: str = "probe_idx") -> DataFrame:
    """The rows of next_page(probe_hashes(build, probe), ...), without a join of all probes for each page.

    The first probes from after on meet build, as many as the page has rows, then more at each turn, until the page is full or
    no probe is left. Few probes are broadcast, so build doesn't move. All probes of one probe_idx go together.
    """
    if rows_per_page < 1:
        raise ValueError("rows_per_page must be 1 or more")
    probe = probe.select(F.col(probe_idx).alias("probe_idx"), F.col(hash_name).alias(hash_name)).where(F.col(hash_name).isNotNull())
    if after is not None:
        probe = probe.where(F.col("probe_idx") >= after[0])
    n = rows_per_page
    while n <= MOST_PROBES:
        taken, last = probe.select("probe_idx").orderBy("probe_idx").limit(n).agg(F.count("*"), F.max("probe_idx")).first()
        none = F.col("probe_idx").isNull()  # first in the order
        first = probe.where(none if last is None else none | (F.col("probe_idx") <= last))
        page = next_page(probe_hashes(build, broadcast_if_small(first), hash_name, row_id), rows_per_page, after)
        if taken < n or page.count() == rows_per_page:
            return page
        n *= MORE_PROBES
    return next_page(probe_hashes(build, probe, hash_name, row_id), rows_per_page, after)
