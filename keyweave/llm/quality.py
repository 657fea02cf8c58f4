"""Quality rules whose thresholds follow the data.

Counts of every whole text become four rates. Quantile sketches of these rates per language and
source give fences; documents outside the fences of their group are rejected by a join.

The sketch keeps, for every value cut to its six leading bits, how often it occurs: a bounded
number of bins, a relative error of at most 1/32, and merging is adding counts. A group's sketch is
merged with its language's at the weight of PRIOR documents, that with the sketch of all documents at the same
weight; so the fewer documents a group has, the more it follows its language, by one rule for all sizes.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm._common import broadcast_if_small, checkpointed, small_batches

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Scaled integers: symbols per 10,000 word characters, repeated lines per 10,000 lines with a
#: word, words in repeated windows per 10,000 words, characters per 100 words.
RATES = {
    "symbols": "n_symbols * 10000 div greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 10000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 10000 div greatest(n_words, 1)",
    "word_length": "word_chars * 100 div greatest(n_words, 1)",
}
#: A fence lies REACH spreads beyond the upper of two quantiles (and below the lower, if being low is odd as well); the
#: spread is their distance, but at least a few units, so that groups without any variation don't reject their first
#: odd document. Symbols and long words are rare in all but odd documents, so the quartiles tell what is usual; some repetition
#: is usual in a few good documents of each group, so there the far tail does.
class Fence(NamedTuple):
    low: float
    high: float
    least: int
    two_sided: bool = False


FENCES = {
    "symbols": Fence(0.25, 0.75, 20),
    "dup_lines": Fence(0.5, 0.99, 100),
    "repeats": Fence(0.5, 0.99, 100),
    "word_length": Fence(0.25, 0.75, 50, two_sided=True),
}
REACH = 3
#: The weight, in documents, at which a parent's sketch is merged into its child's.
PRIOR = 30
#: The base rules, by which a document fails however usual its like are.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of COUNTS over one whole text; all zero for null."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        found, upto = Counter(windows), 0
        for i, window in enumerate(windows):
            if found[window] > 1:
                repeats += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def _count(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_text(t) for t in texts], columns=[c.split()[0] for c in COUNTS.split(", ")], dtype="int64")


def _leading(value: Column) -> Column:
    """A sketch's bin: the value with all but its six leading bits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, rate, bin, n: the sketch of each language and source, over the documents that pass the base rules."""
    rates = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), F.expr(v).alias("value")) for k, v in RATES.items()]))
    bins = counted.where(f"not ({BASE_FAILED})").select("lang", "source", rates.alias("x"))
    return bins.groupBy("lang", "source", F.col("x.rate").alias("rate"), _leading(F.col("x.value")).alias("bin")).agg(F.count("*").alias("n"))


def _running(bins: DataFrame, every: DataFrame, of: list[str], suffix: str) -> DataFrame:
    """of, rate, bin for every bin of the rate in any sketch, with upto and all, the counts up to the bin and in all."""
    empty = bins.select(*of, "rate").distinct().join(F.broadcast(every.select("rate", "bin")), "rate")  # bins of four rates: some 2000 rows
    full = bins.select(*of, "rate", "bin", "n").unionByName(empty.withColumn("n", F.lit(0).cast("long")))
    full = full.groupBy(*of, "rate", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*of, "rate")
    return full.select(*of, "rate", "bin", F.sum("n").over(group.orderBy("bin")).alias(f"upto{suffix}"), F.sum("n").over(group).alias(f"all{suffix}"))


def fences(counted: DataFrame) -> DataFrame:
    """Per language and source: the columns lo_<rate> and hi_<rate>."""
    finest = checkpointed(sketches(counted), len(RATES) * counted.count())
    n = finest.count()
    langs = checkpointed(finest.groupBy("lang", "rate", "bin").agg(F.sum("n").alias("n")), n)
    every = checkpointed(langs.groupBy("rate", "bin").agg(F.sum("n").alias("n")), n)
    overall = _running(every, every, [], "2")
    langs = _running(langs, every, ["lang"], "1").join(F.broadcast(checkpointed(overall, n)), ["rate", "bin"])
    langs = langs.select(F.col("lang").alias("lang1"), F.col("rate").alias("rate1"), F.col("bin").alias("bin1"), ((F.col("upto1") + PRIOR * (F.col("upto2") / F.col("all2"))) / (F.col("all1") + PRIOR)).alias("share"))
    langs = broadcast_if_small(checkpointed(langs))
    merged = _running(finest, every, ["lang", "source"], "0")
    merged = merged.join(langs, merged["lang"].eqNullSafe(langs["lang1"]) & (F.col("rate") == F.col("rate1")) & (F.col("bin") == F.col("bin1")))
    upto, everything = F.col("upto0") + PRIOR * F.col("share"), F.col("all0") + PRIOR
    at = lambda k, p: F.min(F.when((F.col("rate") == k) & (upto >= p * everything), F.col("bin")))
    found = merged.groupBy("lang", "source").agg(*[at(k, p).alias(f"{side}_{k}") for k, f in FENCES.items() for side, p in (("low", f.low), ("high", f.high))])
    sides = []
    for k, f in FENCES.items():
        spread = F.greatest(F.col(f"high_{k}") - F.col(f"low_{k}"), F.lit(f.least)) * REACH
        sides += [(F.col(f"high_{k}") + spread).alias(f"hi_{k}"), (F.col(f"low_{k}") - spread if f.two_sided else F.lit(None).cast("long")).alias(f"lo_{k}")]
    return found.select("lang", "source", *sides)


def _judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with base_failed and kept; limits are joined on language and source, nulls as values."""
    limits = limits.withColumnsRenamed({"lang": "_kw_lang", "source": "_kw_source"})
    on = counted["lang"].eqNullSafe(limits["_kw_lang"]) & counted["source"].eqNullSafe(limits["_kw_source"])
    inside = F.lit(True)
    for rate, value in RATES.items():
        inside &= F.coalesce(F.expr(value) <= F.col(f"hi_{rate}"), F.lit(True))
        if FENCES[rate].two_sided:
            inside &= F.coalesce(F.expr(value) >= F.col(f"lo_{rate}"), F.lit(True))
    return counted.join(limits, on, "left").withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & inside)


def _counted(df: DataFrame, carry: dict[str, Column], text: str, lang: str, source: str) -> DataFrame:
    """carry, lang, source and the counts of COUNTS."""
    # Not marked as deterministic, or a filter on the counts would have them computed once more for itself.
    counts = F.pandas_udf(_count, COUNTS).asNondeterministic()(F.col(text)).alias("counts")
    kept = [c.alias(name) for name, c in carry.items()]
    return df.select(*kept, F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), counts).select(*carry, "lang", "source", "counts.*")


def judge_quality(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of df: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines.

    Words are runs without ASCII spaces. base_failed: under 50 words, or over half of the words in
    repeated 3-word windows. kept is false for these; else it says whether all four rates lie within
    the fences of the document's language and source. Documents that fail add to no sketch.

    Null and empty texts count zero and fail. Null language or source is a value like any other.
    Long texts are counted whole. Equal rows get equal verdicts, each its row; an empty table gives
    an empty result. Columns beyond the four named are not looked at.
    """
    with small_batches(df.sparkSession):
        counted = checkpointed(_counted(df, {"doc_id": F.col(key)}, text, lang, source))
    limits = broadcast_if_small(checkpointed(fences(counted)))
    return _judged(counted, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


def keep_quality(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of df that judge_quality keeps, with all their columns.

    Texts are counted once; their counts and two hashes of the text are kept. Rows of equal text, language and
    source have one fate, so the rejected ones are joined back by hash, as an anti join: texts are not shuffled while these are few.
    """
    hashes = {"h1": F.xxhash64(F.col(text)), "h2": F.xxhash64(F.lit(2), F.col(text))}
    with small_batches(df.sparkSession):
        rows = checkpointed(_counted(df, hashes, text, lang, source))
    limits = broadcast_if_small(checkpointed(fences(rows)))
    gone = _judged(rows, limits).where("not kept").groupBy("h1", "h2", F.col("lang").alias("_kw_lang"), F.col("source").alias("_kw_source")).agg(F.count("*").alias("n"))
    gone = broadcast_if_small(checkpointed(gone.select(F.col("h1").alias("_kw_h1"), F.col("h2").alias("_kw_h2"), "_kw_lang", "_kw_source")))
    same = (hashes["h1"] == F.col("_kw_h1")) & (hashes["h2"] == F.col("_kw_h2"))
    same &= F.col(lang).cast("string").eqNullSafe(F.col("_kw_lang")) & F.col(source).cast("string").eqNullSafe(F.col("_kw_source"))
    return df.join(gone, same, "left_anti")
