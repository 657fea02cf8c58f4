"""Wall time by category, and what describes the running engine."""

from __future__ import annotations

import time
from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_spent: dict[str, int] = defaultdict(int)
_open: list[list] = []

LOG_LEVELS = ("trace", "debug", "info", "warn")


@contextmanager
def traced(category: str):
    """Adds the nanoseconds inside to category. Categories within count for themselves only."""
    now = time.perf_counter_ns()
    if _open:
        _spent[_open[-1][0]] += now - _open[-1][1]
    _open.append([category, now])
    try:
        yield
    finally:
        now = time.perf_counter_ns()
        name, since = _open.pop()
        _spent[name] += now - since
        if _open:
            _open[-1][1] = now


def tracing() -> dict[str, int]:
    return {k: v for k, v in _spent.items() if v}


def clear_tracing() -> None:
    _spent.clear()


def print_tracing() -> None:
    print(f"{'Category':<24}{'Duration(ns)':>16}")
    for category, spent in tracing().items():
        print(f"{category:<24}{spent:>16}")


def print_tracing_histogram(width: int = 40) -> None:
    total = sum(_spent.values())
    for category, spent in tracing().items():
        print(f"{category:<24}{'#' * round(width * spent / total)}")


def info(spark: SparkSession | None = None) -> str:
    import pyspark

    from keyweave import __version__

    return f"keyweave {__version__}, Spark {spark.version if spark else pyspark.__version__}"


def set_log_level(spark: SparkSession, level: str) -> None:
    if level not in LOG_LEVELS:
        raise ValueError(f"log level must be one of {', '.join(LOG_LEVELS)}")
    spark.sparkContext.setLogLevel(level.upper())


def rows_as_text(df: DataFrame, n: int = 20, width: int = 80) -> str:
    """The first n rows as text for a debugger: a line each, nulls as -, binary values in hex, cut to width characters."""

    def show(value) -> str:
        return "-" if value is None else bytes(value).hex() if isinstance(value, (bytes, bytearray)) else str(value)

    lines = [", ".join(df.columns)] + [", ".join(map(show, row)) for row in df.limit(n).collect()]
    return "\n".join(x if len(x) <= width else x[: width - 3] + "..." for x in lines)
