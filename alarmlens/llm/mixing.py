"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.cluster import join_null_safe
from alarmlens.llm.common import WORD, small, stored, text_key

WEIGHTS = (1, 2, 3)
EPOCHS = 3
# Names of the result and of the columns in between; columns of the input that bear them are replaced.
_OWN = ("size", "source_size", "target", "repeats", "_size", "_draw", "_slice", "_key", "_source", "_whole", "_due", "_end", "_before", "_cut", "_reached", "_extra")
_DIGITS = 3  # hex digits of the draw that name one of 4,096 slices of a source


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sources: DataFrame, epochs: int) -> DataFrame:
    """Add ``target`` to one row per source with ``source_size`` and ``weight``.

    Every source gets ``level * weight``, at most ``epochs`` times its size. Raising the level by what
    the clamped sources leave over clamps further ones; it ends after as many rounds as
    clamp a new source, each one a sum over the source table. Whole numbers are summed, so reruns agree.
    """
    cap = F.col("source_size") * F.lit(epochs)
    level, clamped = None, -1
    while True:
        free = F.lit(True) if level is None else cap > F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(free, F.col("weight"))).alias("weights"),
            F.sum(F.when(~free, cap)).alias("fixed"),
            F.count(F.when(~free, 1)).alias("clamped"),
        ).first()
        if not row["weights"] or row["clamped"] == clamped:
            break
        level, clamped = float(row["all"] - (row["fixed"] or 0)) / float(row["weights"]), row["clamped"]
    level = F.lit(level if level is not None else 0.0)
    return sources.withColumn("target", F.least(cap.cast("double"), level * F.col("weight")))


def mix(
    docs: DataFrame, size: Column, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix"
) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, repeats``; repeats is 0 to ``epochs``.

    ``docs`` has ``doc_id, source, text``. Sources in code point order, NULL last, get the weights in
    turn and share the sum of all sizes. A source is repeated whole as often as its target holds it;
    the rest is taken in the order of a seeded md5 of the id, up to the row whose middle passes
    the rest, so the words taken miss the target by half a document at most. Rows of size 0 count for
    nothing and come along when the order reaches them. Rows equal in id, source and text are
    interchangeable, so ties have one result. No row is dropped here; a source of size 0 has target 0.

    No task sees a whole source: its draws are first summed in 4,096 slices, and only
    the slice in which the rest ends is put in order. A hot source is summed before any shuffle.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    kept = [c for c in docs.columns if c not in _OWN]
    rows = docs.select(
        *kept, size.alias("_size"), draw.alias("_draw"), F.substring(draw, 1, _DIGITS).alias("_slice"),
        text_key(F.col("text")).alias("_key"),
    )
    sums = stored(
        rows.groupBy("source", "_slice").agg(F.sum("_size").alias("_words")).withColumnRenamed("source", "_source"),
        "mix-slices",
    )
    by_source = sums.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    ranked = by_source.select(
        "*", (F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1).alias("_place")
    )  # a row per source
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.get(turn, F.pmod("_place", F.lit(len(weights)))))
    targets = stored(water_fill(ranked, epochs).drop("_place"), "mix-targets")

    # How often each source is taken whole, and the words of the fraction that are still due.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    due = F.col("target") - whole * F.col("source_size")
    plan = targets.select("_source", "source_size", "target", whole.alias("_whole"), due.alias("_due"))
    slices = join_null_safe(sums, small(plan), ["_source"], "inner")
    so_far = Window.partitionBy("_source").orderBy("_slice")  # at most 4,096 rows a source
    slices = slices.withColumn("_before", F.sum("_words").over(so_far) - F.col("_words"))
    ends = slices.where("_before < _due and _before + _words >= _due")
    # Of each source the slice in which the fraction ends; sources that need none have no row.
    ends = ends.groupBy("_source").agg(F.min("_slice").alias("_end"), F.min("_before").alias("_before"))
    plan = stored(join_null_safe(plan, ends, ["_source"], "left"), "mix-plan")

    rows = rows.withColumn("_source", F.col("source"))
    rows = join_null_safe(rows, small(plan), ["_source"], "inner").drop("_source")
    inside = F.col("_slice") == F.col("_end")
    # The window orders one slice per source; all other rows are spread by their draw.
    group = F.when(F.coalesce(inside, F.lit(False)), F.lit("")).otherwise(F.col("_draw"))
    order = Window.partitionBy("source", "_cut").orderBy("_draw", "doc_id", "_key")
    cut = rows.withColumn("_cut", group).where(F.coalesce(inside, F.lit(False)))
    cut = cut.withColumn("_reached", F.col("_before") + F.sum("_size").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("_size") / F.lit(2.0))
    cut = cut.withColumn("_extra", (F.col("_reached") <= F.col("_due")).cast("int")).drop("_cut", "_reached")
    rest = rows.where(~F.coalesce(inside, F.lit(False)))
    rest = rest.withColumn("_extra", F.coalesce(F.col("_slice") < F.col("_end"), F.lit(False)).cast("int"))
    repeats = (F.col("_whole") + F.col("_extra")).cast("int")
    return rest.unionByName(cut).select(
        *kept, F.col("_size").alias("size"), "source_size", "target", repeats.alias("repeats")
    )
