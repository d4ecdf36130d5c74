"""One score per window: mean, median, share above a threshold, or distance-weighted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.cluster import at_most, attach, join_null_safe, materialise
from alarmlens.functions.fixed_point import (
    finite,
    fixed_scale,
    infinities,
    limb_names,
    limbs,
    mean_of,
    scale_of,
    total_of,
)
from alarmlens.functions.weights import distance_weight, distance_weight_single
from alarmlens.limits import DEFAULT_LIMITS, Limits
from alarmlens.operators.alarms import Alarms, hours_to_alarm, next_alarm
from alarmlens.operators.ordered import along
from alarmlens.operators.percentile import exact_percentile, percentile_value
from alarmlens.operators.selection import select_ranks, sort_key
from alarmlens.operators.windows import (
    BY,
    DEFAULT_GRID,
    common_span,
    common_step,
    positive_label,
    positive_lengths,
    whole_seconds,
    window_number,
)

# The aggregation methods, and the threshold of "ccdf" for a single curve.
METHODS = ("mean", "median", "NAB", "ccdf")
CURVE_THRESHOLD = 0.95
AUTO = "auto"  # decimals by the largest score of a group


def global_threshold(
    scores: DataFrame,
    share: float = 0.95,
    by: Sequence[str] = BY,
    *,
    exact: bool = False,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Percentile of all scores per group: a score that occurs, or, with ``exact``, interpolated between two. NULL and NaN are left out."""
    percentile = exact_percentile if exact else percentile_value
    return percentile(scores, by, "score", share, "threshold", limits)


def score_windows(
    scores: DataFrame,
    alarms: DataFrame | Alarms,
    windows: Sequence[float] | DataFrame = DEFAULT_GRID,
    method: str = "mean",
    *,
    single_negative: bool = False,
    threshold: float | DataFrame | None = None,
    nab_total: str = "alarm",
    nab_saturated: bool = True,
    revert: bool = False,
    decimals: int | str | None = AUTO,
    by: Sequence[str] = BY,
    limits: Limits = DEFAULT_LIMITS,
    roll_up: bool = True,
) -> DataFrame:
    """Score and label every window of every window length, in one job.

    ``windows``: a list of hours, or a frame ``(*by, window_length)`` that gives each group its own grid.
    ``threshold``: for ``ccdf`` a number, a frame ``(*by, threshold)``, or None for the group's 95th percentile.
    ``nab_total``: divide by the weights of the ``alarm``, or of the whole group (``global``).
    ``nab_saturated``: with a single negative window, the rows outside the positive one weigh exactly 1.
    ``revert``: low scores are the anomalous ones.
    ``decimals``: places that the order-free sums keep; by default 12 behind the first digit of the group's
    largest finite score, or behind the point if that score is from 1 to 1e15; None takes plain averages of doubles.
    ``roll_up``: sum the rows once per common step of the grid, where it has one.

    NaN and NULL scores are skipped, as are rows without a time; a window without any other score is left out. Infinite
    scores make means infinite; a window with both signs has no mean and is left out.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, not {method!r}")
    if nab_total not in ("alarm", "global"):
        raise ValueError(f"nab_total must be 'alarm' or 'global', not {nab_total!r}")
    by = list(by)
    rows = scores.select(*by, "unix", F.nanvl(F.col("score").cast("double"), F.lit(None)).alias("score"))
    rows = rows.where("score is not null and unix is not null")
    if method == "ccdf":
        rows = _with_threshold(rows, scores, threshold, by, limits)
    elif method in ("mean", "NAB") and decimals is not None:
        rows = _with_scale(rows, decimals, by, limits)
    rows = next_alarm(rows, alarms, limits)

    grid = None if isinstance(windows, DataFrame) else positive_lengths(windows)
    seconds = whole_seconds(grid) if grid else None
    if grid is None:
        grids = windows.groupBy(*by).agg(F.sort_array(F.collect_set("window_length")).alias("_grid"))
        grids = materialise(grids)
        with_grid = lambda df: attach(df, grids, by, limits)
    else:
        with_grid = lambda df: df.withColumn("_grid", F.array(*[F.lit(length) for length in grid]))

    if method in ("mean", "ccdf"):
        steps = seconds and roll_up and common_step(seconds) * limits.steps_per_window >= min(seconds)
        if steps:
            scored = _stepped_sums(with_grid, rows, common_step(seconds), method, single_negative, decimals, by)
        elif method == "mean" and decimals is None:
            scored = _plain_means(with_grid(rows), single_negative, by)
        else:
            scored = _running_sums(with_grid, rows, method, single_negative, by, limits)
    elif method == "median":
        scored = _medians(with_grid, rows, seconds, single_negative, by, limits)
    else:
        scored = _weighted(with_grid(rows), single_negative, nab_total, nab_saturated, decimals, by, limits)
    if method in ("mean", "NAB") and decimals is not None:
        scored = scored.where("score is not null")
    score = -F.col("score") if revert else F.col("score")
    return scored.select(
        *by, "window_length", "next_alarm", "window_no", score.alias("score"), positive_label().alias("label")
    )


def _with_threshold(rows, scores, threshold, by, limits):
    if isinstance(threshold, (int, float)):
        return rows.withColumn("threshold", F.lit(float(threshold)))
    if threshold is None:
        threshold = global_threshold(scores, by=by, limits=limits)
    return attach(rows, materialise(threshold.select(*by, "threshold")), by, limits)


def _with_scale(rows, decimals, by, limits):
    if decimals != AUTO:
        return rows.withColumn("_scale", fixed_scale(decimals))
    largest = rows.groupBy(*by).agg(F.max(F.abs(finite(F.col("score")))).alias("_largest"))
    scales = largest.select(*by, scale_of(F.col("_largest")).alias("_scale"))
    return attach(rows, materialise(scales), by, limits)


def _addends(method: str, decimals: int | str | None) -> dict[str, Column]:
    addends = {"_rows": F.lit(1).cast("bigint")}
    if method == "ccdf":
        addends["_above"] = (F.col("score") > F.col("threshold")).cast("bigint")
    elif decimals is None:
        addends["_plain"] = F.col("score")
    else:
        addends |= limbs(F.col("score"), "_score", F.col("_scale")) | infinities(F.col("score"), "_score")
    return addends


def _steps(step: int, single_negative: bool) -> Column:
    """Whole steps to the alarm; rounded up where "further than w" has to be decided."""
    distance = (F.col("next_alarm") - F.col("unix")) / F.lit(step)
    return F.ceil(distance) if single_negative else F.floor(distance)


def _window_of_step(step: int, single_negative: bool) -> Column:
    """The window number again, from the steps, for lengths that are multiples of the step."""
    per_window = (F.col("window_length") * 3600 / step).cast("bigint")
    if single_negative:
        return (F.col("_step") > per_window).cast("bigint")
    return F.floor(F.col("_step") / per_window)


def _summed(df, key, method, decimals, addends):
    """Sums of the addends per ``key``."""
    sums = [F.sum(n).alias(n) for n in addends]
    if method == "mean" and decimals is not None:
        sums.append(F.max("_scale").alias("_scale"))
    return df.groupBy(*key).agg(*sums)


def _with_score(grouped, method, decimals):
    if method == "ccdf":
        return grouped.withColumn("score", F.col("_above") / F.col("_rows"))
    if decimals is None:
        return grouped.withColumn("score", F.col("_plain") / F.col("_rows"))
    return grouped.withColumn("score", mean_of("_score", "_rows", F.col("_scale")))


def _stepped_sums(with_grid, rows, step, method, single_negative, decimals, by):
    """Mean and share above where all lengths are multiples of a step.

    The rows are summed once per step, and the grid multiplies those few sums instead of the rows.
    """
    addends = _addends(method, decimals)
    kept = [F.col("_scale")] if method == "mean" and decimals is not None else []
    rows = rows.select(
        *by, "next_alarm", _steps(step, single_negative).alias("_step"), *kept, *[c.alias(n) for n, c in addends.items()]
    )
    rows = with_grid(_summed(rows, [*by, "next_alarm", "_step"], method, decimals, addends))
    rows = rows.withColumn("window_length", F.explode("_grid"))
    rows = rows.withColumn("window_no", _window_of_step(step, single_negative))
    grouped = _summed(rows, [*by, "window_length", "next_alarm", "window_no"], method, decimals, addends)
    return _with_score(grouped, method, decimals)


def _plain_means(rows, single_negative, by):
    """Plain averages for lengths without a common step: doubles have no exact differences, so the grid multiplies the rows."""
    rows = rows.withColumn("window_length", F.explode("_grid"))
    rows = rows.withColumn("window_no", window_number(F.col("window_length"), single_negative))
    return rows.groupBy(*by, "window_length", "next_alarm", "window_no").agg(F.avg("score").alias("score"))


def _running_sums(with_grid, rows, method, single_negative, by, limits):
    """Mean and share above for lengths without a common step: differences of exact running sums.

    Rows are summed per second, then along the time to each alarm. A window is a run of seconds, so its sums are what the running
    sums gain from its first second to its last. Only these two places of each window are dealt to its length, never the rows.
    """
    place = [*by, "next_alarm"]
    addends = _addends(method, AUTO)
    kept = [F.col("_scale")] if method == "mean" else []
    rows = rows.select(*place, "unix", *kept, *[c.alias(n) for n, c in addends.items()])
    rows = _summed(rows, [*place, "unix"], method, AUTO, addends)
    # Running sums reach further than those of a window.
    wide = {n: F.col(n).cast("decimal(20,0)") for n in addends if n.endswith("_whole")}
    rows = materialise(rows.withColumns(wide))
    walked = along(
        rows,
        place,
        ["unix"],
        limits,
        running={f"_with{n}": n for n in addends},
        previous={"_earlier": "unix"},
        following={"_later": "unix"},
    )

    def places(length):
        own = window_number(length, single_negative)
        differs = lambda time: F.col(time).isNull() | (window_number(length, single_negative, F.col(time)) != own)
        return F.struct(
            length.alias("window_length"), own.alias("window_no"), differs("_earlier").alias("opens"), differs("_later").alias("closes")
        )

    ends = F.filter(F.transform("_grid", places), lambda end: end["opens"] | end["closes"])
    ends = with_grid(walked).withColumn("_end", F.explode(ends)).select("*", "_end.*")
    gained = {
        n: F.when(F.col("closes"), F.col(f"_with{n}")).otherwise(F.lit(0))
        - F.when(F.col("opens"), F.col(f"_with{n}") - F.col(n)).otherwise(F.lit(0))
        for n in addends
    }
    grouped = _summed(ends.withColumns(gained), [*by, "window_length", "next_alarm", "window_no"], method, AUTO, addends)
    grouped = grouped.withColumns({n: F.col(n).cast("bigint") for n in wide})
    return _with_score(grouped, method, AUTO)


def _weighted(rows, single_negative, nab_total, nab_saturated, decimals, by, limits):
    """Mean of ``weight * score`` over the sum of the weights of the alarm, or of the whole group."""
    if decimals is None:
        rows = _with_scale(rows, AUTO, by, limits)
    weigh = distance_weight_single if single_negative and nab_saturated else distance_weight
    rows = (
        rows.withColumn("window_length", F.explode("_grid"))
        .withColumn("window_no", window_number(F.col("window_length"), single_negative))
        .withColumn("_weight", weigh(hours_to_alarm(), F.col("window_length")))
    )
    weighted = F.col("_weight") * F.col("score")
    addends = limbs(weighted, "_score", F.col("_scale")) | infinities(weighted, "_score") | limbs(F.col("_weight"), "_weight")
    grouped = rows.groupBy(*by, "window_length", "next_alarm", "window_no").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max("_scale").alias("_scale"),
        *[F.sum(c).alias(n) for n, c in addends.items()],
    )
    # One row per window is left here, no longer one per score.
    kept = [c for c in grouped.columns if c not in limb_names("_weight")]
    if nab_total == "alarm":
        whole = Window.partitionBy(*by, "window_length", "next_alarm")
        weighed = grouped.select(*kept, *[F.sum(n).over(whole).alias(n) for n in limb_names("_weight")])
    else:
        # All windows of a group share the total: summed in part first, then looked up, so none is held in one task.
        grouped = materialise(grouped)
        totals = grouped.groupBy(*by, "window_length").agg(*[F.sum(n).alias(n) for n in limb_names("_weight")])
        weighed = attach(grouped.select(*kept), materialise(totals), [*by, "window_length"], limits)
    return weighed.withColumn("score", mean_of("_score", "_rows", F.col("_scale")) / total_of("_weight"))


def _medians(with_grid, rows, seconds, single_negative, by, limits):
    """Exact medians; windows of an overfull block are ranked without gathering them.

    The windows of all lengths nest in blocks of their common span, counted from the alarm. Rows
    are shuffled once by block, and the grid is applied behind that shuffle.
    """
    distance = F.col("next_alarm") - F.col("unix")
    nested = bool(seconds) and not single_negative
    block = F.floor(distance / F.lit(common_span(seconds))) if nested else F.lit(0).cast("bigint")
    longest = F.floor(distance / F.lit(max(seconds))) if nested else F.lit(0).cast("bigint")
    rows = rows.withColumn("_block", block)
    place = [*by, "next_alarm", "_block"]
    key = [*by, "window_length", "next_alarm", "window_no"]
    # The number of partitions is fixed, because the grid multiplies the rows after the shuffle.
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    full = (
        rows.groupBy(*place, longest.alias("_longest"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .groupBy(*place)
        .agg(F.sum("_rows").alias("_all"), F.max("_rows").alias("_widest"))
        .where((F.col("_all") > limits.rows_per_task) | (F.col("_widest") > limits.rows_in_memory))
    )
    full = materialise(full.select(*place))

    def dealt(df):
        return with_grid(df).withColumn("window_length", F.explode("_grid")).drop("_grid")

    def merged(df):
        # Scores are gathered once per step. A window sorts the arrays of its steps, which are sorted runs already.
        step = common_step(seconds)
        steps = df.select(*place, "score", _steps(step, single_negative).alias("_step"))
        runs = steps.repartition(partitions, *place).groupBy(*place, "_step")
        runs = dealt(runs.agg(F.sort_array(F.collect_list("score")).alias("_run")))
        runs = runs.withColumn("window_no", _window_of_step(step, single_negative))
        # The keys contain those of the shuffle, so no other one follows.
        grouped = runs.groupBy(*key, "_block").agg(F.sort_array(F.flatten(F.collect_list("_run"))).alias("_run"))
        count = F.size("_run")
        lower = F.element_at("_run", F.floor((count + 1) / F.lit(2)).cast("int"))
        upper = F.element_at("_run", F.floor(count / F.lit(2) + 1).cast("int"))
        return grouped.select(*key, (lower * F.lit(0.5) + upper * F.lit(0.5)).alias("score"))

    def walked(df):
        # Lengths without a common step: the rows of each window are sorted, with spilling, by a window function.
        whole = Window.partitionBy("window_no", "window_length", "next_alarm", "_block", *by)
        number = window_number(F.col("window_length"), single_negative)
        places = dealt(df.repartition(partitions, *place)).withColumn("window_no", number).select(
            *key,
            "_block",
            "score",
            F.row_number().over(whole.orderBy("score")).alias("_place"),
            F.count(F.lit(1)).over(whole).alias("_rows"),
        )
        middle = places.where("_place * 2L between _rows and _rows + 2")
        halves = F.min("score") * F.lit(0.5) + F.max("score") * F.lit(0.5)
        return middle.groupBy(*key, "_block").agg(halves.alias("score")).select(*key, "score")

    gathered = merged if seconds else walked

    def ranked(df):
        # How often each score occurs per step (or second); windows of all lengths are added up from counts of digits.
        step = common_step(seconds) if seconds else None
        fine = ["_step"] if step else ["unix"]
        cells = df.withColumn("_key", sort_key(F.col("score")))
        if step:
            cells = cells.withColumn("_step", _steps(step, single_negative))
        cells = materialise(cells.groupBy(*place, *fine, "_key").agg(F.count(F.lit(1)).alias("_copies")))

        def spread(counts):
            number = _window_of_step(step, single_negative) if step else window_number(F.col("window_length"), single_negative)
            return dealt(counts).withColumn("window_no", number)

        middle = {"_lower": lambda n: F.floor((n + 1) / 2), "_upper": lambda n: F.floor(n / 2) + 1}
        found = select_ranks(cells, place, [*key, "_block"], middle, limits, fine=fine, spread=spread)
        return found.select(*key, (F.col("_lower") * F.lit(0.5) + F.col("_upper") * F.lit(0.5)).alias("score"))

    if full.isEmpty():
        return gathered(rows)
    if not at_most(full, limits.broadcast_rows):
        return ranked(rows)
    within = join_null_safe(rows, F.broadcast(full), place, "left_anti")
    beyond = join_null_safe(rows, F.broadcast(full), place, "left_semi")
    return gathered(within).unionByName(ranked(beyond))
