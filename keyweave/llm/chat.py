"""Preference pairs in a chat template: the shared prompt once, two completions with their masks.

Only DataFrame operations. A pair meets in one row, which holds its two conversations; pairs are
formed by key, so popular first turns or repeated conversations are spread like all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def _render(turns: Column) -> Column:
    text = F.transform(turns, lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit("\n"), t["text"], F.lit(TURN_END)))
    return F.array_join(text, "")


def _mask(turns: Column) -> Column:
    """[start, length] in code points of what is learned in _render(turns): assistant texts with their end marker."""
    head = lambda t: F.length(t["role"]) + len(TURN_START) + 1
    body = lambda t: F.length(t["text"]) + len(TURN_END) - 1  # noqa: E731  the marker without its line end
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("spans"))

    def add(state: Column, t: Column) -> Column:
        span = F.array(F.array(state["at"] + head(t), body(t)))
        learned = F.when(t["role"] == LEARNED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + head(t) + body(t) + 1).alias("at"), learned.alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def common_prefix(left: Column, right: Column) -> Column:
    """How many leading elements two arrays share; nulls are equal to nulls."""
    differs = F.zip_with(left, right, lambda a, b: ~a.eqNullSafe(b))
    return F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, F.least(F.size(left), F.size(right))).cast("int")


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    turns has a row per turn; pair says which pair it belongs to and chosen which side. Each side is
    ordered by turn (ties by role, then text). The longest common prefix of both, compared by role and
    text, is the prompt; what follows is rendered as completions. A mask lists [start, length] in code
    points of a completion's assistant texts, end marker included; all else is not learned. If one
    conversation is a prefix of the other, all of it is prompt and its completion is empty.

    A turn of a null pair belongs to no other, however many there are: each is a pair of its own. A null role is written as "unknown", a null text as "", so they equal these. A side without turns
    has an empty prompt and a null completion and mask. Repeated rows are turns of their own. Null turn
    numbers come first. Markers inside texts stay as they are; masks don't depend
    on them. Empty tables give an empty result; other columns are not looked at.
    """
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = turns.select(pair.alias("pair_id"), F.coalesce(chosen, F.lit(False)).alias("is_chosen"), item.alias("t"))
    rows = rows.withColumn("alone", F.when(F.col("pair_id").isNull(), F.monotonically_increasing_id()))
    side = lambda wanted: F.transform(F.sort_array(F.collect_list(F.when(wanted, F.col("t")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    pairs = rows.groupBy("pair_id", "alone").agg(side(F.col("is_chosen")).alias("c"), side(~F.col("is_chosen")).alias("r"))
    pairs = pairs.withColumn("n_prompt_turns", common_prefix(F.col("c"), F.col("r")))
    n = F.col("n_prompt_turns")
    rest = lambda side: F.slice(F.col(side), n + 1, F.greatest(F.size(side) - n, F.lit(0)))
    given = lambda side, made: F.when(F.size(side) > 0, made(rest(side)))
    return pairs.select(
        "pair_id", "n_prompt_turns", _render(F.slice(F.col("c"), F.lit(1), n)).alias("prompt"),
        given("c", _render).alias("chosen"), given("r", _render).alias("rejected"), given("c", _mask).alias("chosen_mask"), given("r", _mask).alias("rejected_mask"),
    )


def pair_conversations(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """format_preferences of conversations stored side by side: key 2k is the chosen one, 2k + 1 the rejected one of pair k."""
    number = F.col(key).cast("long")  # bits, not division: doubles don't hold all longs
    return format_preferences(conversations, F.shiftright(number, 1), number.bitwiseAND(F.lit(1)) == 0)
