"""The result of every query as one SQL statement over the same parquet tables."""

from __future__ import annotations

from catalogue.queries import CCDF_THRESHOLD, CURVE_COLUMNS, DAILY_GRID, FAR, FRACTIONAL_GRID, IRREGULAR_GRID, PLANNED

DEFAULT_GRID = (1, 2, 3, 4, 5, 6, 12, 18, 24, 36, 48)

EVENTS = """
    scores AS (
        SELECT event_type AS algorithm, CAST(floor(epoch(ts)) AS BIGINT) AS unix, value AS score
        FROM events WHERE event_type <> 'error'),
    errors AS (
        SELECT CAST(floor(epoch(ts)) AS BIGINT) AS u, value, event_id,
               CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k
        FROM events WHERE event_type = 'error'),
    peaks AS (
        SELECT u, k, row_number() OVER (PARTITION BY u // 172800 ORDER BY value DESC, event_id) AS place FROM errors),
    maintenances AS (
        SELECT 'M' || row_number() OVER (ORDER BY u) AS maint_id, u AS unix_start, u + 60 * k AS unix_end
        FROM peaks WHERE place = 1),
    alarms AS (SELECT DISTINCT unix_start AS alarm FROM maintenances)"""

DAILY = """
    scores AS (
        SELECT o_orderpriority AS algorithm, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS unix, o_totalprice AS score
        FROM orders),
    largest AS (
        SELECT CAST(floor(epoch(o_orderdate)) AS BIGINT) AS u,
               row_number() OVER (PARTITION BY CAST(floor(epoch(o_orderdate)) AS BIGINT) // 15552000
                                  ORDER BY o_totalprice DESC, o_orderkey) AS place
        FROM orders),
    alarms AS (SELECT DISTINCT u AS alarm FROM largest WHERE place = 1)"""

KEPT = """
    SELECT * FROM scores s
    WHERE unix < (SELECT max(unix_start) FROM maintenances)
      AND NOT EXISTS (SELECT 1 FROM maintenances m WHERE s.unix > m.unix_start AND s.unix < m.unix_end + 1800)"""

# The same list of views, with maintenances applied and planned ones left out.
FILTERED = EVENTS.replace("scores AS", "raw_scores AS").replace(
    "alarms AS (SELECT DISTINCT unix_start AS alarm FROM maintenances)",
    f"scores AS ({KEPT.replace('FROM scores s', 'FROM raw_scores s')}),"
    f" alarms AS (SELECT DISTINCT unix_start AS alarm FROM maintenances WHERE maint_id NOT IN ('{PLANNED[0]}'))",
)

ANNOTATED = """
    annotated AS (
        SELECT s.*, coalesce(a.alarm, -1) AS next_alarm,
               (coalesce(a.alarm, -1) - s.unix) / CAST(3600 AS DOUBLE) AS hours_to_alarm
        FROM scores s ASOF LEFT JOIN alarms a ON s.unix < a.alarm)"""

EVEN_GRID = """
    hours AS (
        SELECT algorithm, min(hours_to_alarm) AS min_hours, max(hours_to_alarm) AS max_hours
        FROM annotated GROUP BY algorithm),
    bounds AS (SELECT algorithm, greatest(min_hours, 1.0) AS low, least(max_hours, 48.0) AS high FROM hours),
    grid AS (
        SELECT algorithm,
               CASE WHEN i = 4 THEN high ELSE low + i * ((high - low) / CAST(4 AS DOUBLE)) END AS window_length
        FROM bounds, (SELECT unnest([0, 1, 2, 3, 4]) AS i))"""

# Position in the ranking and interpolation of a percentile, spelled out.
THRESHOLDS = """
    ranked AS (
        SELECT algorithm, score, row_number() OVER (PARTITION BY algorithm ORDER BY score) - 1 AS place,
               CAST(0.95 AS DOUBLE) * (count(*) OVER (PARTITION BY algorithm) - 1) AS wanted
        FROM scores),
    neighbours AS (
        SELECT algorithm, any_value(wanted) AS wanted,
               max(CASE WHEN place = floor(wanted) THEN score END) AS lower,
               max(CASE WHEN place = ceil(wanted) THEN score END) AS upper
        FROM ranked GROUP BY algorithm),
    thresholds AS (
        SELECT algorithm,
               CASE WHEN lower = upper THEN lower
                    ELSE lower * (1 - (wanted - floor(wanted))) + upper * (wanted - floor(wanted)) END AS threshold
        FROM neighbours)"""

# The score at the rank that covers the share.
THRESHOLD_SCORES = """
    ranked AS (
        SELECT algorithm, score, row_number() OVER (PARTITION BY algorithm ORDER BY score) AS place,
               greatest(1, ceil(CAST(0.95 AS DOUBLE) * count(*) OVER (PARTITION BY algorithm))) AS wanted
        FROM scores),
    thresholds AS (SELECT algorithm, score AS threshold FROM ranked WHERE place = wanted)"""


def grid_of(lengths) -> str:
    return f"grid AS (SELECT unnest(CAST([{', '.join(map(str, lengths))}] AS DOUBLE[])) AS window_length)"


def windowed(single: bool = False, own_grid: bool = False) -> str:
    number = (
        "CAST(a.hours_to_alarm > g.window_length AS BIGINT)"
        if single
        else "CAST(floor((a.next_alarm - a.unix) / (CAST(3600 AS DOUBLE) * g.window_length)) AS BIGINT)"
    )
    on = "a.algorithm = g.algorithm" if own_grid else "true"
    return f"""
    windowed AS (
        SELECT a.*, g.window_length, {number} AS window_no FROM annotated a JOIN grid g ON {on})"""


def units(value: str) -> str:
    """``value`` as a whole number of 1e-12."""
    return (
        f"(CAST(floor({value}) AS HUGEINT) * 1000000000000"
        f" + CAST(floor(({value} - floor({value})) * CAST(1e12 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS HUGEINT))"
    )


def from_units(number: str) -> str:
    return (
        f"(CAST({number} // 1000000000000 AS DOUBLE)"
        f" + CAST({number} % 1000000000000 AS DOUBLE) / CAST(1e12 AS DOUBLE))"
    )


KEY = "algorithm, window_length, next_alarm, window_no"
LABEL = "(window_no = 0 AND next_alarm <> -1) AS label"


def scored_mean(sign: str = "") -> str:
    return f"""
    sums AS (SELECT {KEY}, sum({units('score')}) AS total, count(*) AS n FROM windowed GROUP BY {KEY}),
    means AS (SELECT {KEY}, total // n AS mean FROM sums),
    scored AS (SELECT {KEY}, {sign}{from_units('mean')} AS score, {LABEL} FROM means)"""


SCORED_DECIMAL = f"""
    means AS (SELECT {KEY}, sum(CAST(score AS DECIMAL(30, 9))) AS total, count(*) AS n FROM windowed GROUP BY {KEY}),
    scored AS (SELECT {KEY}, CAST(total AS DOUBLE) / n AS score, {LABEL} FROM means)"""

SCORED_MEDIAN = f"""
    places AS (
        SELECT {KEY}, score, row_number() OVER (PARTITION BY {KEY} ORDER BY score) AS place,
               count(*) OVER (PARTITION BY {KEY}) AS n
        FROM windowed),
    scored AS (
        SELECT {KEY},
               (max(CASE WHEN place = (n + 1) // 2 THEN score END) + max(CASE WHEN place = n // 2 + 1 THEN score END))
               / CAST(2 AS DOUBLE) AS score, {LABEL}
        FROM places GROUP BY {KEY})"""


def scored_ccdf(threshold: str) -> str:
    return f"""
    scored AS (
        SELECT {KEY}, CAST(sum(CASE WHEN score > {threshold} THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE)
               AS score, {LABEL}
        FROM windowed GROUP BY {KEY})"""


def scored_nab(total: str = "alarm", single: bool = False) -> str:
    sigmoid = (
        "2 / (1 + exp(CAST(-15 AS DOUBLE) * greatest(hours_to_alarm / window_length, CAST(0.01 AS DOUBLE)))) - 1"
    )
    weight = f"CASE WHEN hours_to_alarm > window_length THEN 1 ELSE {sigmoid} END" if single else sigmoid
    share = "algorithm, window_length" + (", next_alarm" if total == "alarm" else "")
    return f"""
    weights AS (SELECT *, CAST({weight} AS DOUBLE) AS weight FROM windowed),
    sums AS (
        SELECT {KEY}, sum({units('weight * score')}) // count(*) AS mean, sum({units('weight')}) AS weights
        FROM weights GROUP BY {KEY}),
    shares AS (SELECT {KEY}, mean, sum(weights) OVER (PARTITION BY {share}) AS total FROM sums),
    scored AS (
        SELECT {KEY}, {from_units('mean')} / (CAST(total AS DOUBLE) / CAST(1e12 AS DOUBLE)) AS score, {LABEL}
        FROM shares)"""


CURVE = """
    counts AS (
        SELECT algorithm, window_length, score AS threshold,
               CAST(sum(CASE WHEN label THEN 1 ELSE 0 END) AS BIGINT) AS pos,
               CAST(sum(CASE WHEN label THEN 0 ELSE 1 END) AS BIGINT) AS neg
        FROM scored GROUP BY ALL),
    confusion AS (
        SELECT *,
               CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
               row_number() OVER w AS point_no,
               CAST(sum(pos) OVER (PARTITION BY algorithm, window_length) AS BIGINT) AS positives,
               CAST(sum(neg) OVER (PARTITION BY algorithm, window_length) AS BIGINT) AS negatives,
               lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
        FROM counts WINDOW w AS (PARTITION BY algorithm, window_length ORDER BY threshold DESC))"""

AUC = """
    areas AS (
        SELECT algorithm, window_length, CAST(sum(neg * (2 * tp - pos)) AS BIGINT) AS twice,
               CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
        FROM confusion GROUP BY ALL),
    aucs AS (
        SELECT algorithm, window_length,
               CASE WHEN positives > 0 AND negatives > 0
                    THEN CAST(twice AS DOUBLE) / CAST(2 * positives * negatives AS DOUBLE) END AS auc,
               positives, negatives
        FROM areas)"""


def points(reduced: bool = True) -> str:
    bends = "WHERE point_no = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg" if reduced else ""
    return f"""
    kept AS (
        SELECT algorithm, window_length, point_no, threshold, tp, fp, positives, negatives FROM confusion {bends}
        UNION ALL
        SELECT algorithm, window_length, 0, NULL, 0, 0, CAST(sum(pos) AS BIGINT), CAST(sum(neg) AS BIGINT)
        FROM counts GROUP BY ALL),
    points AS (
        SELECT algorithm, window_length, point_no, threshold, tp, fp,
               CASE WHEN negatives > 0 THEN CAST(fp AS DOUBLE) / CAST(negatives AS DOUBLE) END AS fpr,
               CASE WHEN positives > 0 THEN CAST(tp AS DOUBLE) / CAST(positives AS DOUBLE) END AS tpr,
               CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
               CASE WHEN positives > 0 THEN CAST(tp AS DOUBLE) / CAST(positives AS DOUBLE) END AS recall,
               CASE WHEN tp + fp + positives > 0
                    THEN CAST(2 * tp AS DOUBLE) / CAST(tp + fp + positives AS DOUBLE) ELSE 0.0 END AS f1
        FROM kept)"""


def statement(final: str, *parts: str) -> str:
    return f"WITH {', '.join(parts)} {final}"


def scores_of(scored: str, *, source=EVENTS, lengths=DEFAULT_GRID, single=False, digits=None) -> str:
    score = "score" if digits is None else f"round(score, {digits}) AS score"
    return statement(
        f"SELECT {KEY}, {score}, label FROM scored", source, ANNOTATED, grid_of(lengths), windowed(single), scored
    )


def curve_parts(scored: str, *, source=EVENTS, lengths=DEFAULT_GRID, single=False) -> list[str]:
    return [source, ANNOTATED, grid_of(lengths), windowed(single), scored, CURVE]


def auc_sql(scored: str, **options) -> str:
    return statement("SELECT * FROM aucs", *curve_parts(scored, **options), AUC)


def points_sql(columns=CURVE_COLUMNS, reduced=True, scored=None, digits=None, **options) -> str:
    parts = curve_parts(scored or scored_mean(), **options)
    columns = [f"round({c}, {digits}) AS {c}" if digits and c == "threshold" else c for c in columns]
    return statement(f"SELECT {', '.join(columns)} FROM points", *parts, points(reduced))


def window_no_sql(source: str, length: int, single: bool) -> str:
    return statement(
        f"SELECT algorithm, unix, score, next_alarm, hours_to_alarm, window_no, {LABEL} FROM windowed",
        source,
        ANNOTATED,
        grid_of([length]),
        windowed(single),
    )


def global_ccdf(final: str, *more: str, thresholds: str = THRESHOLDS) -> str:
    with_threshold = """
    annotated AS (SELECT n.*, t.threshold FROM nearest n JOIN thresholds t ON n.algorithm = t.algorithm)"""
    nearest = ANNOTATED.replace("annotated AS", "nearest AS")
    return statement(
        final, EVENTS, thresholds, nearest, with_threshold, grid_of(DEFAULT_GRID), windowed(),
        scored_ccdf("threshold"), *more,
    )


def summary_sql() -> str:
    """Mean AUCs, with those of the second grid's median inserted or put in place."""
    columns = "algorithm, window_length AS window_size, auc"
    old, new = auc_sql(scored_mean()), auc_sql(SCORED_MEDIAN, lengths=(6, 12, 72))
    return f"""
    WITH old AS (SELECT {columns} FROM ({old})), new AS (SELECT {columns} FROM ({new}))
    SELECT * FROM new
    UNION ALL
    SELECT * FROM old o
    WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.algorithm = o.algorithm AND n.window_size = o.window_size)"""


TRAPEZOIDS = """
    stored AS (SELECT DISTINCT algorithm, window_length, fpr, tpr FROM points),
    steps AS (
        SELECT *, lag(fpr) OVER w AS last_fpr, lag(tpr) OVER w AS last_tpr
        FROM stored WINDOW w AS (PARTITION BY algorithm, window_length ORDER BY fpr, tpr))"""

ALL_SCORES = "SELECT algorithm, unix, score FROM"
NEXT_ALARM = "SELECT algorithm, unix, score, next_alarm, hours_to_alarm FROM annotated"

ORACLE: dict[str, str] = {
    "next_alarm": statement(NEXT_ALARM, EVENTS, ANNOTATED),
    "next_alarm_dense": statement(NEXT_ALARM, DAILY, ANNOTATED),
    "next_alarm_far": statement(
        NEXT_ALARM, EVENTS.replace("FROM maintenances)", f"FROM maintenances UNION ALL SELECT {FAR})"), ANNOTATED
    ),
    "next_alarm_sweep": statement(NEXT_ALARM, EVENTS, ANNOTATED),
    "next_alarm_dense_sweep": statement(NEXT_ALARM, DAILY, ANNOTATED),
    "window_no_multi": window_no_sql(EVENTS, 6, False),
    "window_no_single": window_no_sql(EVENTS, 6, True),
    "window_no_multi_daily": window_no_sql(DAILY, 24, False),
    "window_no_single_daily": window_no_sql(DAILY, 24, True),
    "window_grid_default": statement(
        "SELECT algorithm, window_length FROM (SELECT DISTINCT algorithm FROM scores), grid", EVENTS, grid_of(DEFAULT_GRID)
    ),
    "hours_range": statement("SELECT * FROM hours", EVENTS, ANNOTATED, EVEN_GRID),
    "window_grid_even": statement("SELECT * FROM grid", EVENTS, ANNOTATED, EVEN_GRID),
    "score_mean": scores_of(scored_mean()),
    "score_mean_single": scores_of(scored_mean(), single=True),
    "score_mean_daily": scores_of(scored_mean(), source=DAILY, lengths=DAILY_GRID),
    "score_mean_direct": scores_of(scored_mean()),
    "score_median": scores_of(SCORED_MEDIAN),
    "score_median_single": scores_of(SCORED_MEDIAN, single=True),
    "score_median_ranked": scores_of(SCORED_MEDIAN),
    "score_ccdf": scores_of(scored_ccdf(str(CCDF_THRESHOLD))),
    "score_ccdf_global": global_ccdf(f"SELECT {KEY}, score, label FROM scored"),
    "global_threshold": statement("SELECT algorithm, round(threshold, 6) AS threshold FROM thresholds", EVENTS, THRESHOLDS),
    "score_nab_alarm": scores_of(scored_nab(), digits=6),
    "score_nab_global": scores_of(scored_nab("global"), digits=6),
    "score_nab_single": scores_of(scored_nab(single=True), single=True, digits=6),
    "score_nab_single_clamped": scores_of(scored_nab(), single=True, digits=6),
    "score_mean_irregular_single": scores_of(scored_mean(), lengths=IRREGULAR_GRID, single=True),
    "score_revert": scores_of(scored_mean("-")),
    "confusion_by_threshold": statement(
        "SELECT algorithm, window_length, point_no, threshold, tp, fp, positives, negatives FROM confusion",
        *curve_parts(scored_mean()),
    ),
    "confusion_by_threshold_ranges": statement(
        "SELECT algorithm, window_length, point_no, threshold, tp, fp, positives, negatives FROM confusion",
        *curve_parts(scored_mean()),
    ),
    "roc_points": points_sql(reduced=False),
    "roc_points_reduced": points_sql(),
    "roc_points_reduced_daily": points_sql(source=DAILY, lengths=DAILY_GRID),
    "auc": auc_sql(scored_mean()),
    "auc_bucketed": auc_sql(scored_mean()),
    "precision_recall_f1": points_sql(
        ("algorithm", "window_length", "point_no", "threshold", "precision", "recall", "f1"), False
    ),
    "roc_curve_6h": points_sql(lengths=(6,)),
    "roc_curve_median": points_sql(lengths=(6,), scored=SCORED_MEDIAN),
    "roc_curve_nab": points_sql(lengths=(6,), scored=scored_nab(), digits=6),
    "roc_curve_ccdf": points_sql(lengths=(6,), scored=scored_ccdf("CAST(0.95 AS DOUBLE)")),
    "roc_curve_single": points_sql(lengths=(6,), single=True),
    "roc_surface": points_sql(),
    "surface_auc": auc_sql(scored_mean()),
    "surface_auc_missing_times": auc_sql(scored_mean()),
    "surface_auc_single": auc_sql(scored_mean(), single=True),
    # Means as fractions of whole numbers, whose quotients are compared; the factor of the scores must not matter.
    "surface_auc_tiny": auc_sql(SCORED_DECIMAL),
    "surface_auc_huge": auc_sql(SCORED_DECIMAL),
    "surface_auc_rollup": auc_sql(scored_mean(), lengths=(0.5, 1, 1.5, 6)),
    "surface_auc_median": auc_sql(SCORED_MEDIAN),
    "surface_auc_ccdf": auc_sql(scored_ccdf(str(CCDF_THRESHOLD))),
    "surface_auc_ccdf_global": global_ccdf("SELECT * FROM aucs", CURVE, AUC),
    "surface_auc_ccdf_default": global_ccdf("SELECT * FROM aucs", CURVE, AUC, thresholds=THRESHOLD_SCORES),
    "surface_auc_nab_alarm": auc_sql(scored_nab()),
    "surface_auc_nab_global": auc_sql(scored_nab("global")),
    "surface_auc_nab_single": auc_sql(scored_nab(single=True), single=True),
    "surface_auc_revert": auc_sql(scored_mean("-")),
    "surface_auc_even": statement(
        "SELECT * FROM aucs", EVENTS, ANNOTATED, EVEN_GRID, windowed(own_grid=True), scored_mean(), CURVE, AUC
    ),
    "surface_auc_fractional": auc_sql(scored_mean(), lengths=FRACTIONAL_GRID),
    "surface_auc_irregular": auc_sql(scored_mean(), lengths=IRREGULAR_GRID),
    "surface_auc_irregular_ccdf": auc_sql(scored_ccdf(str(CCDF_THRESHOLD)), lengths=IRREGULAR_GRID),
    "surface_auc_daily": auc_sql(scored_mean(), source=DAILY, lengths=DAILY_GRID),
    "surface_auc_single_daily": auc_sql(scored_mean(), source=DAILY, lengths=DAILY_GRID, single=True),
    "surface_auc_filtered": auc_sql(scored_mean(), source=FILTERED),
    "filter_before_last": statement(
        f"{ALL_SCORES} scores WHERE unix < (SELECT max(unix_start) FROM maintenances)", EVENTS
    ),
    "filter_cooldown": statement(
        f"{ALL_SCORES} scores s WHERE NOT EXISTS (SELECT 1 FROM maintenances m"
        " WHERE s.unix > m.unix_start AND s.unix < m.unix_end + 1800)",
        EVENTS,
    ),
    "filter_cooldown_open": statement(
        f"{ALL_SCORES} scores s WHERE NOT EXISTS (SELECT 1 FROM maintenances m"
        " WHERE s.unix > m.unix_start AND s.unix < m.unix_end + 1800)"
        " AND NOT unix > (SELECT max(unix_start) + 86400 FROM maintenances)",
        EVENTS,
    ),
    "filter_cooldown_sweep": statement(
        f"{ALL_SCORES} scores s WHERE NOT EXISTS (SELECT 1 FROM maintenances m"
        " WHERE s.unix > m.unix_start AND s.unix < m.unix_end + 1800)",
        EVENTS,
    ),
    "filter_maintenances": statement(f"{ALL_SCORES} ({KEPT})", EVENTS),
    "exclude_planned": statement(
        f"SELECT maint_id, unix_start, unix_end FROM maintenances WHERE maint_id <> '{PLANNED[0]}'", EVENTS
    ),
    "read_format_us": statement(f"{ALL_SCORES} scores", EVENTS),
    "read_format_tls": statement(
        "SELECT algorithm, unix, score, CASE WHEN score > 100 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label"
        " FROM scores",
        EVENTS,
    ),
    "read_format_tl": statement(f"{ALL_SCORES} scores", EVENTS),
    "read_format_us_header": statement(f"{ALL_SCORES} scores", EVENTS),
    "read_format_tl_label": statement(f"{ALL_SCORES} scores", EVENTS),
    "read_format_days": statement(
        f"{ALL_SCORES} scores WHERE algorithm IN ('click', 'view')"
        " AND CAST(make_timestamp(unix * 1000000) AS DATE) IN (DATE '2024-01-05', DATE '2024-01-20')",
        EVENTS,
    ),
    "read_maintenances": statement("SELECT maint_id, unix_start, unix_end FROM maintenances", EVENTS),
    "scores_by_day": statement(
        f"SELECT algorithm, unix, score, CAST(make_timestamp(unix * 1000000) AS DATE) AS day FROM ({KEPT})", EVENTS
    ),
    "scores_by_day_csv": statement(
        f"SELECT algorithm, unix, score, CAST(make_timestamp(unix * 1000000) AS DATE) AS day FROM ({KEPT})", EVENTS
    ),
    "curve_table": points_sql(lengths=(6,)),
    "surface_table": points_sql(),
    "surface_rewrite": statement(
        f"SELECT {', '.join(CURVE_COLUMNS)} FROM points",
        EVENTS,
        ANNOTATED,
        EVEN_GRID,
        windowed(own_grid=True),
        scored_mean(),
        CURVE,
        points(True),
    ),
    "curve_beside_surface": points_sql(),
    "summarise_surface": statement(
        """
        SELECT algorithm, window_length,
               CASE WHEN NOT bool_or(fpr IS NULL OR tpr IS NULL)
                    THEN round(sum((fpr - last_fpr) * (tpr + last_tpr) / CAST(2 AS DOUBLE)), 6) END AS auc
        FROM steps GROUP BY algorithm, window_length""",
        *curve_parts(scored_mean()),
        points(),
        TRAPEZOIDS,
    ),
    "random_baseline": statement(
        """
        SELECT algorithm, window_length, fpr, tpr FROM points
        UNION ALL
        SELECT 'random', window_length, CAST(x AS DOUBLE), CAST(x AS DOUBLE)
        FROM (SELECT DISTINCT window_length FROM points), (SELECT unnest([0, 1]) AS x)""",
        *curve_parts(scored_mean(), lengths=(6,)),
        points(),
    ),
    "summary_upsert": summary_sql(),
    "summary_table": summary_sql(),
    "summary_csv": summary_sql(),
}
