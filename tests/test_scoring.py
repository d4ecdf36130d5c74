import math
import random
from dataclasses import replace

import naive
import numpy as np
import pytest
from pyspark.sql import functions as F

import alarmlens as al
from alarmlens.operators.percentile import exact_percentile
from alarmlens.operators.selection import sort_key, value_of

SCHEMA = "algorithm string, unix bigint, score double"
LENGTHS = [1, 6, 24]
SHORT = replace(al.DEFAULT_LIMITS, rows_per_task=10)
SHUFFLED = replace(al.DEFAULT_LIMITS, rows_per_task=10, broadcast_rows=0, salts=3)
CROWDED = replace(al.DEFAULT_LIMITS, rows_in_memory=9)


@pytest.fixture(scope="module")
def data(spark):
    rows, alarms = naive.series(7)
    frame = spark.createDataFrame([(a,) for a in alarms], "unix bigint")
    return rows, alarms, spark.createDataFrame(rows, SCHEMA), al.alarm_times(frame)


def by_key(df):
    rows = df.collect()
    found = {(r.algorithm, r.window_length, r.next_alarm, r.window_no): (r.score, r.label) for r in rows}
    assert len(found) == len(rows)
    return found


def check(df, windows, score, rel=1e-11):
    found = by_key(df)
    assert found.keys() == windows.keys()
    for key, members in windows.items():
        assert found[key][1] == naive.label(key)
        assert found[key][0] == pytest.approx(score(key, members), rel=rel, abs=1e-11), key


def scores_of(members):
    return [s for _, s in members]


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("options", [{}, {"roll_up": False}, {"decimals": None}, {"decimals": 15}, {"limits": SHUFFLED}])
def test_mean(data, single, options):
    rows, alarms, scores, frame = data
    scored = al.score_windows(scores, frame, LENGTHS, single_negative=single, **options)
    check(scored, naive.windows(rows, alarms, LENGTHS, single), lambda _, m: naive.mean(scores_of(m)))


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("lengths", [LENGTHS, [0.5, 1.25]])
@pytest.mark.parametrize(
    "limits", [al.DEFAULT_LIMITS, SHORT, SHUFFLED, CROWDED], ids=["gathered", "ranked", "shuffled", "crowded"]
)
def test_median(data, single, lengths, limits):
    rows, alarms, scores, frame = data
    scored = al.score_windows(scores, frame, lengths, "median", single_negative=single, limits=limits)
    check(scored, naive.windows(rows, alarms, lengths, single), lambda _, m: naive.middle(scores_of(m)))


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("total", ["alarm", "global"])
@pytest.mark.parametrize("saturated", [True, False])
def test_distance_weighted(data, single, total, saturated):
    rows, alarms, scores, frame = data
    windows = naive.windows(rows, alarms, LENGTHS, single)

    def weigh(key, unix):
        return naive.weight((key[2] - unix) / 3600, key[1], single and saturated)

    totals = {}
    for key, members in windows.items():
        of = key[:3] if total == "alarm" else key[:2]
        totals[of] = totals.get(of, 0.0) + math.fsum(weigh(key, u) for u, _ in members)

    def score(key, members):
        mean = math.fsum(weigh(key, u) * s for u, s in members) / len(members)
        return mean / totals[key[:3] if total == "alarm" else key[:2]]

    scored = al.score_windows(scores, frame, LENGTHS, "NAB", single_negative=single, nab_total=total, nab_saturated=saturated)
    check(scored, windows, score, rel=1e-9)


@pytest.mark.parametrize("limits", [al.DEFAULT_LIMITS, SHUFFLED], ids=["broadcast", "salted"])
def test_share_above(spark, data, limits):
    rows, alarms, scores, frame = data
    windows = naive.windows(rows, alarms, LENGTHS)
    own = spark.createDataFrame([("a", 2.5), ("b", 1.0)], "algorithm string, threshold double")
    scored = al.score_windows(scores, frame, LENGTHS, "ccdf", threshold=own, limits=limits)
    bound = {"a": 2.5, "b": 1.0}
    check(scored, windows, lambda k, m: sum(s > bound[k[0]] for s in scores_of(m)) / len(m))
    scored = al.score_windows(scores, frame, LENGTHS, "ccdf", threshold=3, limits=limits)
    check(scored, windows, lambda _, m: sum(s > 3 for s in scores_of(m)) / len(m))


def test_global_threshold_is_the_default(data):
    rows, alarms, scores, frame = data
    sketch = {r.algorithm: r.threshold for r in al.global_threshold(scores).collect()}
    for name, threshold in sketch.items():
        own = sorted(s for a, _, s in rows if a == name)
        assert threshold == own[math.ceil(0.95 * len(own)) - 1]
    again = al.global_threshold(scores.repartition(13, "score")).collect()
    assert sketch == {r.algorithm: r.threshold for r in again}
    scored = al.score_windows(scores, frame, [6], "ccdf")
    check(
        scored,
        naive.windows(rows, alarms, [6]),
        lambda k, m: sum(s > sketch[k[0]] for s in scores_of(m)) / len(m),
    )


def test_own_grid(spark, data):
    rows, alarms, scores, frame = data
    grid = spark.createDataFrame([("a", 2.5), ("a", 7.1), ("b", 3.0)], "algorithm string, window_length double")
    found = by_key(al.score_windows(scores, frame, grid))
    expected = {
        key: members for key, members in naive.windows(rows, alarms, [2.5, 3.0]).items() if key[:2] in (("a", 2.5), ("b", 3.0))
    }
    assert {k for k in found if k[1] != 7.1} == expected.keys()
    assert {k[:2] for k in found} == {("a", 2.5), ("a", 7.1), ("b", 3.0)}


def test_missing_scores_are_skipped(spark):
    rows = [("a", 1, 1.0), ("a", 2, float("nan")), ("a", 3, None), ("a", 9000, None), ("a", 9001, float("nan"))]
    alarms = spark.createDataFrame([(10,), (9999,)], "unix bigint")
    for method in ("mean", "median", "ccdf", "NAB"):
        scored = al.score_windows(spark.createDataFrame(rows, SCHEMA), alarms, [1], method, threshold=0.5).collect()
        assert [(r.next_alarm, r.window_no) for r in scored] == [(10, 0)]


def test_sums_do_not_depend_on_the_order(spark):
    source = random.Random(3)
    values = [source.uniform(-1000, 1000) for _ in range(500)] + [-0.1, 0.3, -2.5]
    alarms = al.alarm_times(spark.createDataFrame([(3600,)], "unix bigint"))
    means = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        frame = spark.createDataFrame([("a", 10, v) for v in values], SCHEMA).repartition(seed + 1)
        means.add(al.score_windows(frame, alarms, [1]).first().score)
    assert len(means) == 1
    assert means.pop() == pytest.approx(math.fsum(values) / len(values), rel=1e-11)


def test_equal_means_are_equal_doubles(spark):
    windows = {1: [0.1, 0.2, 0.3], 2: [0.2], 3: [0.3, 0.1], 4: [0.25, 0.15] * 7, 5: [-0.6, 1.0], 6: [0.2] * 11}
    rows = [("a", n * 3600 + 60, v) for n, values in windows.items() for v in values]
    alarms = spark.createDataFrame([(20 * 3600,)], "unix bigint")
    scored = al.score_windows(spark.createDataFrame(rows, SCHEMA), alarms, [1]).collect()
    assert len(scored) == 6 and {r.score for r in scored} == {0.2}


def test_large_sums(spark):
    rows = spark.range(3000).select(
        F.lit("a").alias("algorithm"), F.lit(0).cast("bigint").alias("unix"), (F.col("id") + 9e14).alias("score")
    )
    scored = al.score_windows(rows, spark.createDataFrame([(60,)], "unix bigint"), [1]).first()
    assert scored.score == 9e14 + 1499.5


def test_infinite_scores(spark):
    inf = float("inf")
    rows = [("a", 0, 1.0), ("a", 1, inf), ("b", 0, -inf), ("b", 1, 3.0), ("c", 0, inf), ("c", 1, -inf), ("d", 0, 1e-9), ("d", 1, 3e-9)]
    alarms = al.alarm_times(spark.createDataFrame([(60,)], "unix bigint"))
    scores = spark.createDataFrame(rows, SCHEMA)
    for method in ("mean", "NAB"):
        found = {r.algorithm: r.score for r in al.score_windows(scores, alarms, [1], method).collect()}
        assert found.keys() == {"a", "b", "d"}
        assert (found["a"], found["b"]) == (inf, -inf) and 0 < found["d"] < 4e-9
    assert al.score_windows(scores, alarms, [1], decimals=None).where("algorithm = 'a'").first().score == inf
    assert al.score_windows(scores, alarms, [1], "ccdf", threshold=2).where("algorithm = 'a'").first().score == 0.5


@pytest.mark.parametrize("method", ["mean", "NAB"])
def test_the_scale_of_scores_does_not_matter(data, method):
    _, _, scores, frame = data
    alarms = al.alarm_times(frame)

    def areas(power):
        scaled = scores.withColumn("score", F.col("score") * F.lit(float(f"1e{power}")))
        found = al.surface_auc(scaled, alarms, LENGTHS, method).collect()
        return {(r.algorithm, r.window_length): None if r.auc is None else round(r.auc, 9) for r in found}

    plain = areas(0)
    for power in (-300, -13, 15, 300):
        assert areas(power) == plain


def test_small_scores_with_more_decimals(spark):
    rows = [("a", 0, 3e-20), ("a", 1, 5e-20)]
    alarms = spark.createDataFrame([(60,)], "unix bigint")
    scored = al.score_windows(spark.createDataFrame(rows, SCHEMA), alarms, [1], decimals=30).first()
    assert scored.score == pytest.approx(4e-20, rel=1e-9)


def test_revert_mirrors_the_curve(data):
    _, _, scores, frame = data
    for method in ("mean", "median"):
        up = {(r.algorithm, r.window_length): r.auc for r in al.surface_auc(scores, frame, LENGTHS, method).collect()}
        down = al.surface_auc(scores, frame, LENGTHS, method, revert=True).collect()
        for r in down:
            before = up[r.algorithm, r.window_length]
            assert r.auc == (None if before is None else pytest.approx(1 - before))


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("limits", [al.DEFAULT_LIMITS, SHUFFLED])
def test_exact_percentile(spark, share, limits):
    source = random.Random(5)
    groups = {"a": [source.gauss(0, 1) for _ in range(700)], "b": [source.randrange(4) * 1.0 for _ in range(301)], "c": [2.0]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double")
    found = {r.g: r.p for r in exact_percentile(df, ["g"], "v", share, "p", limits).collect()}
    assert found == pytest.approx({g: float(np.quantile(v, share)) for g, v in groups.items()}, abs=1e-12)


def test_unknown_options(data):
    _, _, scores, frame = data
    with pytest.raises(ValueError):
        al.score_windows(scores, frame, method="max")
    with pytest.raises(ValueError):
        al.score_windows(scores, frame, method="NAB", nab_total="day")


ODD_LENGTHS = [1 / 7, 0.77, 2.5, 7.1]


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("limits", [al.DEFAULT_LIMITS, SHUFFLED], ids=["window", "ranges"])
def test_running_sums(data, single, limits):
    rows, alarms, scores, frame = data
    scored = al.score_windows(scores, frame, ODD_LENGTHS, single_negative=single, limits=limits)
    windows = naive.windows(rows, alarms, ODD_LENGTHS, single)
    check(scored, windows, lambda _, m: naive.mean(scores_of(m)))
    above = al.score_windows(scores, frame, ODD_LENGTHS, "ccdf", threshold=2.5, single_negative=single, limits=limits)
    check(above, windows, lambda _, m: sum(s > 2.5 for s in scores_of(m)) / len(m))


def test_running_sums_reach_further_than_a_long(spark):
    # Every window is in range, the sum along the time is not; one window holds both infinities, one a single one.
    rows = [("a", 3600 * i, 9e14 * (1 + i % 3)) for i in range(20_000)] + [(None, 5, 2.0), (None, 6, None)]
    rows += [("b", 10, float("inf")), ("b", 4000, float("inf")), ("b", 4001, float("-inf")), ("b", 9000, 1.0)]
    alarms = spark.createDataFrame([(3600 * 20_000,)], "unix bigint")
    scores = spark.createDataFrame(rows, SCHEMA)
    direct = by_key(al.score_windows(scores, alarms, [1.3], roll_up=False))
    stepped = by_key(al.score_windows(scores, alarms, [1.3]))
    assert direct == stepped and len(direct) > 15_000
    assert (None, 1.3) in {k[:2] for k in direct} and any(math.isinf(v[0]) for v in direct.values())


def test_running_sums_do_not_multiply_the_rows(data):
    _, _, scores, frame = data
    plan = al.score_windows(scores, frame, ODD_LENGTHS)._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate" in line]
    assert len(generated) == 1 and "filter(" in generated[0]  # only first and last seconds of windows


def test_sort_key_keeps_order_and_value(spark):
    source = random.Random(11)
    values = [s * 2.0**e * f for e in range(-1074, 1024) for s in (1, -1) for f in (1.0, 1.5, 2 - 2**-52) if e > -1022 or f == 1.0]
    values += [source.gauss(0, 1) * 10.0 ** source.randint(-300, 300) for _ in range(5000)]
    values += [0.0, -0.0, float("inf"), float("-inf"), 1.7976931348623157e308, 5e-324, 2.2250738585072011e-308]
    keyed = spark.createDataFrame([(v,) for v in values], "v double").select("v", sort_key(F.col("v")).alias("k"))
    keyed = keyed.withColumn("back", value_of(F.col("k"))).collect()
    assert all(r.v == r.back for r in keyed)
    ordered = sorted(keyed, key=lambda r: r.v)
    assert all((a.k < b.k) == (a.v < b.v) and a.k <= b.k for a, b in zip(ordered, ordered[1:]))
    rest = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(sort_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in rest] == [None, None]


def test_medians_on_own_grids(spark, data):
    rows, alarms, scores, frame = data
    grid = spark.createDataFrame([("a", 2.5), ("b", 3.0)], "algorithm string, window_length double")
    gathered = by_key(al.score_windows(scores, frame, grid, "median"))
    assert gathered and by_key(al.score_windows(scores, frame, grid, "median", limits=SHORT)) == gathered


def test_ranked_medians_gather_nothing(data):
    _, _, scores, frame = data
    limits = replace(al.DEFAULT_LIMITS, rows_per_task=1, broadcast_rows=0)
    plan = al.score_windows(scores, frame, LENGTHS, "median", limits=limits)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "sketch" not in plan.lower()
