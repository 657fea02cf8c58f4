"""Mixing sources to target weights by entropy balancing.

Of all document rates that take each source's target of words and none above a cap, the ones
closest to the base rates in (word-weighted) relative entropy are tilted exponentially:
rate = min(cap, base * exp(lambda of the source)). The lambdas solve the convex dual; each Newton
iteration is one aggregation over cells of equal source and base rate, of which there are few. Rates are then rounded to
copies: a document's fixed hash decides the fraction, against a threshold per source at which the
taken words meet the target. Only DataFrame operations; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm._common import WORD, broadcast_if_small, checkpointed
from keyweave.plans.frames import with_position

#: Histogram cells of the rounding threshold between 0 and 1, and how often a cell is cut again.
CELLS, LEVELS = 512, 2
#: Newton steps stop at this relative distance of every source from its target.
CLOSE = 1e-12
MOST_STEPS = 100


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(key: str, text: str) -> Column:
    """A fixed number in [0, 1) for each key and text."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.col(text)), 11) / F.lit(float(1 << 53))


def length_preference(size: Column) -> Column:
    """Base rates by length: 1 for documents of 256 to 511 words, and with each doubling away from these the next of 4/5, 4/6, 4/7 ...

    Whole powers of two tell the lengths apart, so a source has 64 different base rates at most.
    """
    power = F.length(F.bin(F.greatest(size, F.lit(1)))) - 1
    return 4 / (4 + F.abs(power - 8)).cast("double")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size -> with target: weights repeat over the sources by code point, null last.

    Targets are min(cap * size, weight * level), the level being such that they add up to share of
    all sizes: what a capped source can't take goes to the others by weight. The level is found by rounds: it is what is left
    for the sources not capped yet, over their weights; it only rises, and with it the capped ones, until none is added. Each
    round adds up a row per source; sources are numbered by a range sort, so there may be many.
    """
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = with_position(sizes, "at", F.col("source").asc_nulls_last())
    rows = rows.withColumn("weight", F.element_at(kinds, (F.col("at") % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rows = checkpointed(rows.drop("at"))
    total = (rows.agg(F.sum("source_size").alias("n")).first().n or 0) * float(min(share, cap))
    level, capped = 0.0, -1
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        sums = rows.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("most"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if sums.n == capped or not sums.weight:
            break
        level, capped = (total - sums.most) / sums.weight, sums.n
    target = F.least("most", F.col("weight") * F.lit(level)) if sums.weight else F.col("most")
    return rows.withColumn("target", target).select("source", "source_size", "target")


def solve(cells: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """targets with lambda_, from Newton steps on the dual, kept within a bracket by bisection.

    cells: source, base, size (words of the documents of that source and base rate).
    """
    state = checkpointed(targets.withColumns({"lambda_": F.lit(0.0), "low": F.lit(-700.0), "high": F.lit(700.0)}), n := cells.count())
    # A source with target 0 needs no lambda: its rate is 0.
    for _ in range(MOST_STEPS):
        here = broadcast_if_small(state.withColumnRenamed("source", "_kw_source"))
        tilted = F.col("base") * F.exp("lambda_")
        sums = (
            cells.join(here, cells["source"].eqNullSafe(here["_kw_source"]))
            .groupBy("source")
            .agg(
                F.sum(F.col("size") * F.least(F.lit(cap), tilted)).alias("takes"),
                F.sum(F.when(tilted < cap, F.col("size") * tilted).otherwise(0.0)).alias("slope"),
                *[F.max(c).alias(c) for c in ("source_size", "target", "lambda_", "low", "high")],
            )
        )
        over = F.col("takes") - F.col("target")
        sums = sums.withColumn("open", (F.abs(over) > F.col("target") * CLOSE) & (F.col("target") > 0) & (F.col("high") - F.col("low") > 1e-13))
        sums = sums.withColumn("low", F.when(over < 0, F.col("lambda_")).otherwise(F.col("low"))).withColumn("high", F.when(over > 0, F.col("lambda_")).otherwise(F.col("high")))
        newton = F.when(F.col("slope") > 0, F.col("lambda_") - over / F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        stepped = F.when(~F.col("open"), F.col("lambda_")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = checkpointed(sums.withColumn("lambda_", stepped).select("source", "source_size", "target", "lambda_", "low", "high", "open"), n)
        if not state.where("open").limit(1).count():
            break
        state = state.drop("open")
    return state.select("source", "source_size", "target", "lambda_")


def _rated(rows: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """rows (_kw_source, _kw_base, _kw_draw, _kw_size) joined to their source's plan, with _kw_whole, _kw_part, and _kw_at."""
    rows = rows.join(plan, rows["_kw_source"].eqNullSafe(plan["_kw_of"]), "left").drop("_kw_of")
    rate = F.when(F.col("_kw_target") > 0, F.round(F.least(F.lit(float(cap)), F.col("_kw_base") * F.exp("_kw_lambda")), 9)).otherwise(0.0)
    rows = rows.withColumn("_kw_rate", rate).withColumn("_kw_whole", F.floor("_kw_rate")).withColumn("_kw_part", F.col("_kw_rate") - F.col("_kw_whole"))
    # Documents whose hash, over their fraction, lies below the source's threshold get one copy more.
    return rows.withColumn("_kw_at", F.when(F.col("_kw_part") > 0, F.col("_kw_draw") / F.col("_kw_part")))


def _cell(level: int) -> Column:
    n = CELLS**level
    return F.least(F.floor(F.col("_kw_at") * float(n)), F.lit(4 * n + CELLS - 1 if level > 1 else 4 * n))


def _inside(rated: DataFrame, met: DataFrame, level: int) -> DataFrame:
    """The documents in the cell where their source meets its need."""
    return rated.join(met, rated["_kw_source"].eqNullSafe(met["_kw_of2"]) & (_cell(level) == met["_kw_met"]))


def plan_mix(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Per source: _kw_of, _kw_source_size, _kw_target, _kw_lambda and the rounding threshold _kw_last.

    rows: _kw_source, _kw_base, _kw_draw, _kw_size, cheap to read again.
    """
    n = rows.count()
    cells = checkpointed(rows.groupBy(F.col("_kw_source").alias("source"), F.col("_kw_base").alias("base")).agg(F.sum("_kw_size").alias("size")), n)
    sizes = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    solved = solve(cells, source_targets(sizes, weights, share, cap), cap)
    plan = solved.select(F.col("source").alias("_kw_of"), F.col("source_size").alias("_kw_source_size"), F.col("target").alias("_kw_target"), F.col("lambda_").alias("_kw_lambda"))

    rated = _rated(rows, broadcast_if_small(plan), cap)
    # Where the running sum of words, in order of the hash, meets what the fractions are to take:
    # first the cell, then the cell within it, then the document. No step sorts more than the cells of a source.
    met = None
    for level in range(1, LEVELS + 1):
        inside = rated.where("_kw_at is not null").withColumn("left", F.col("_kw_size") * F.col("_kw_part")) if met is None else _inside(rated, met, level - 1)
        total = F.sum("left") if met is None else F.first("left")
        cells = inside.groupBy(F.col("_kw_source").alias("of2"), _cell(level).alias("cell")).agg(F.sum("_kw_size").alias("words"), total.alias("left"))
        whole = Window.partitionBy("of2")
        cells = cells.withColumn("upto", F.sum("words").over(whole.orderBy("cell"))).withColumn("left", (F.sum if met is None else F.max)("left").over(whole))
        meets = F.min_by(F.struct("cell", (F.col("left") - F.col("upto") + F.col("words")).alias("left")), F.when(F.col("upto") >= F.col("left"), F.col("cell")))
        met = checkpointed(cells.groupBy("of2").agg(meets.alias("m")).select(F.col("of2").alias("_kw_of2"), F.col("m.cell").alias("_kw_met"), F.col("m.left").alias("left")), n)
        met = broadcast_if_small(met)
    inside = _inside(rated, met, LEVELS)
    inside = inside.groupBy("_kw_of2", "_kw_at").agg(F.sum("_kw_size").alias("words"), F.first("left").alias("left"))
    inside = inside.withColumn("upto", F.sum("words").over(Window.partitionBy("_kw_of2").orderBy("_kw_at")))
    last = inside.groupBy("_kw_of2").agg(F.max(F.when(F.col("upto") - F.col("words") / 2 <= F.col("left"), F.col("_kw_at"))).alias("last"))
    last = met.select(F.col("_kw_of2").alias("of3"), "_kw_met").join(last, F.col("of3").eqNullSafe(F.col("_kw_of2")), "left")
    # Without a document to be taken in its cell, the threshold lies just below the cell.
    last = last.select("of3", F.coalesce("last", F.col("_kw_met") / F.lit(float(CELLS**LEVELS)) - F.lit(2.0**-60)).alias("_kw_last"))
    return checkpointed(plan.join(last, plan["_kw_of"].eqNullSafe(last["of3"]), "left").drop("of3"), n)


def _with_copies(rows: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    below = F.coalesce(F.col("_kw_at") <= F.col("_kw_last"), F.lit(False)).cast("long")
    return _rated(rows, broadcast_if_small(plan), cap).withColumn("_kw_copies", F.col("_kw_whole") + below)


Base = str | Callable[[Column], Column] | None


def _inputs(df: DataFrame, key: str, text: str, source: str, base: Base) -> DataFrame:
    """df's columns in the struct _kw_row, and _kw_key, _kw_source, _kw_draw, _kw_size, _kw_base."""
    given = F.col(base) if isinstance(base, str) else F.lit(None)
    rows = df.select(F.struct(*df.columns).alias("_kw_row"), F.col(key).alias("_kw_key"), F.col(source).cast("string").alias("_kw_source"), draw_of(key, text).alias("_kw_draw"), words_of(text).alias("_kw_size"), given.cast("double").alias("_kw_base"))
    rate = base(F.col("_kw_size")) if callable(base) else F.col("_kw_base")
    return rows.withColumn("_kw_base", F.greatest(F.coalesce(rate, F.lit(1.0)), F.lit(1e-300)))


def mix_documents(
    df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", base: Base = length_preference
) -> DataFrame:
    """One row per row of df: doc_id, size, source_size, target, taken (whole copies times size), copies.

    Sources in the order of their names, null last, get the weights in turn and together share times
    all words; no source's target exceeds cap times its words. A document is taken floor or ceiling
    of its rate times, at most cap times. Each source's taken words meet its target up to half of
    its largest document (of all rows with equal key and text, if such repeat). base names a column
    of rates before tilting (null: 1), or makes them from the size, like length_preference; with None all are 1. Documents of
    one source keep the ratio of their base rates, but for the cap. Reruns over the same rows agree, however these are stored.

    Null and empty texts have size 0 and never change a sum; a null source is one source. Repeated
    rows are taken alike. A source without words has target 0. An empty table gives an empty result.
    """
    rows = checkpointed(_inputs(df, key, text, source, base).drop("_kw_row"))
    plan = plan_mix(rows, weights, share, cap)
    return _with_copies(rows, plan, cap).select(
        F.col("_kw_key").alias("doc_id"), F.col("_kw_size").alias("size"), F.col("_kw_source_size").alias("source_size"), F.col("_kw_target").alias("target"),
        (F.col("_kw_copies") * F.col("_kw_size")).alias("taken"), F.col("_kw_copies").alias("copies"),
    )


def repeat_documents(
    df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", base: Base = length_preference
) -> DataFrame:
    """The rows of df with all columns, each as often as mix_documents takes it; documents without words have their rate too."""
    rows = _inputs(df, key, text, source, base)
    plan = plan_mix(checkpointed(rows.drop("_kw_row", "_kw_key")), weights, share, cap)
    copies = _with_copies(rows, plan, cap).select("_kw_row", F.explode(F.array_repeat(F.lit(0), F.col("_kw_copies").cast("int"))))
    return copies.select("_kw_row.*")
