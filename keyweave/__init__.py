"""Batch collections for keyed data on Spark: multimap joins, re-batching, row tables."""

__version__ = "0.1.0"

from keyweave.operators.batching import Accumulator, rebatch, rebatch_indexed, rebatch_partitions
from keyweave.operators.keyed import KeyedTable
from keyweave.operators.rows import RowTable
from keyweave.plans.trace import clear_tracing, info, print_tracing, print_tracing_histogram, set_log_level

__all__ = [
    "Accumulator", "KeyedTable", "RowTable", "clear_tracing", "info", "print_tracing", "print_tracing_histogram",
    "rebatch", "rebatch_indexed", "rebatch_partitions", "set_log_level",
]
