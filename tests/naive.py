"""The definitions, spelled out row by row in plain Python."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from fractions import Fraction
from statistics import median


def next_alarm(unix, alarms):
    return min((a for a in alarms if a > unix), default=-1)


def window_no(unix, alarm, length, single):
    if single:
        return int(Fraction(alarm - unix, 3600) > length)
    return math.floor(Fraction(alarm - unix) / (3600 * Fraction(length)))


def windows(rows, alarms, lengths, single=False):
    """{(algorithm, length, alarm, number): [(unix, score), ...]}"""
    found = defaultdict(list)
    for algorithm, unix, score in rows:
        alarm = next_alarm(unix, alarms)
        for length in lengths:
            found[algorithm, float(length), alarm, window_no(unix, alarm, length, single)].append((unix, score))
    return dict(found)


def mean(scores):
    return float(sum(Fraction(str(s)) for s in scores) / len(scores))


def middle(scores):
    return float(median(scores))


def weight(hours, length, single=False):
    if single and hours > length:
        return 1.0
    return 2 / (1 + math.exp(-15 * max(hours / length, 0.01))) - 1


def label(key):
    return key[3] == 0 and key[2] != -1


def auc(labelled):
    """Share of (positive, negative) pairs in the right order, ties count half."""
    positives = [s for s, yes in labelled if yes]
    negatives = [s for s, yes in labelled if not yes]
    if not positives or not negatives:
        return None
    won = sum((p > n) + Fraction(p == n, 2) for p in positives for n in negatives)
    return float(won / (len(positives) * len(negatives)))


def share(part, whole):
    return part / whole if whole else None


def points(labelled):
    """Every threshold from above, with the measures of calling all scores from it on anomalous."""
    positives = sum(yes for _, yes in labelled)
    negatives = len(labelled) - positives
    rows = [(0, None, 0, 0)]
    for number, threshold in enumerate(sorted({s for s, _ in labelled}, reverse=True), 1):
        called = [yes for s, yes in labelled if s >= threshold]
        rows.append((number, threshold, sum(called), len(called) - sum(called)))
    return [
        (
            number, threshold, tp, fp, share(fp, negatives), share(tp, positives), share(tp, tp + fp) or 0.0,
            share(tp, positives), share(2 * tp, 2 * tp + fp + positives - tp) or 0.0,
        )
        for number, threshold, tp, fp in rows
    ]


def series(seed, rows=400, algorithms=("a", "b"), hours=200, decimals=1, start=1_600_000_000):
    """Scores with ties and repeated seconds, and alarms with repetitions among them."""
    source = random.Random(seed)
    data = [
        (source.choice(algorithms), start + source.randrange(hours * 3600), round(source.random() * 5, decimals))
        for _ in range(rows)
    ]
    alarms = [start + source.randrange(hours * 3600) for _ in range(8)]
    # Scores exactly at an alarm and exactly one window before it.
    data += [("a", alarms[0], 1.0), ("a", alarms[1] - 6 * 3600, 2.0), ("b", max(alarms) + 5, 3.0)]
    return data, alarms + alarms[:2]
