"""Whitening against a plain computation with whole numbers and fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from alarmlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, vec_id_2 int, x string, key int, size int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in vectors], SCHEMA)


def plain(vectors, weighted=False):
    """Exact n, sums, deviations and covariance of the distinct usable vectors."""
    usable = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = {}
    whole = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in usable]
    for _, x in whole:
        xs[x] = xs.get(x, 0) + 1 if weighted else 1
    n, d = sum(xs.values()), len(next(iter(xs)))
    sums = [sum(x[k] * w for x, w in xs.items()) for k in range(d)]
    deviations = {x: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in xs}
    covariance = [
        [float(sum(w * (x[a] - Fraction(sums[a], n)) * (x[b] - Fraction(sums[b], n)) for x, w in xs.items()) / n) for b in range(d)]
        for a in range(d)
    ]
    return whole, xs, n, sums, deviations, np.array(covariance)


@pytest.mark.parametrize("weights", ["one", "counts"])
@pytest.mark.parametrize("hot", [100_000, 5])
def test_against_plain(spark, monkeypatch, weights, hot):
    monkeypatch.setattr(whitening, "HOT_COPIES", hot)
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=6) * [3, 2, 1, 0.5, 0.2, 5]).tolist()) for i in range(120)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(40)] + [(7, vectors[7][1]), (None, vectors[8][1])]
    vectors += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [0.0] * 5 + [float("-inf")])]
    rows = whitening.whiten(frame(spark, vectors), weights=weights).collect()
    whole, xs, n, sums, deviations, covariance = plain(vectors, weights == "counts")
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted((str(i), c) for i, _ in whole for c in (1, 2, 3, 4))
    by_id = {r["vec_id"]: {} for r in rows}
    for r in rows:
        by_id[r["vec_id"]][r["component"]] = r
    signs = {}
    for i, x in whole:
        for component in (1, 2, 3, 4):
            row = by_id[i][component]
            k = component - 1
            assert (row["n"], row["deviation"]) == (n, deviations[x])
            assert row["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-9)
            assert 0 <= row["identity_error"] < 1e-9
            wanted = (np.array([float(c - Fraction(s, n)) for c, s in zip(x, sums)]) @ axes[:, k]) / math.sqrt(values[k])
            if abs(wanted) > 1e-3:
                signs.setdefault(component, row["whitened"] / wanted)
            assert row["whitened"] == pytest.approx(wanted * signs.get(component, 1), abs=1e-8)
    assert all(abs(abs(s) - 1) < 1e-8 for s in signs.values())


def test_edges(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, None)])).count() == 0
    alone = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(alone) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["n"] == 1 for r in alone)
    flat = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).orderBy("vec_id", "component").collect()
    assert [abs(r["whitened"]) if r["component"] == 1 else r["whitened"] for r in flat] == [1, None, 1, None]
    mixed = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.5]), (3, [5.0]), (4, [2.0]), (5, [1.0])]))
    assert {r["vec_id"]: r["n"] for r in mixed.collect()} == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3}
    vast = whitening.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert len(vast) == 4 and all(r["deviation"] is None for r in vast)
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, []), weights="two")


def test_large_whole_numbers(spark):
    """Deviations beyond 2**53, with sums that pass through unbounded whole numbers."""
    vectors = [(1, [1e6, -2e6]), (2, [3e5, 7.0]), (3, [1e6, 1e6])]
    _, _, n, _, deviations, _ = plain(vectors)
    whole = {i: x for i, x in plain(vectors)[0]}
    for r in whitening.whiten(frame(spark, vectors)).collect():
        wanted = deviations[whole[r["vec_id"]]]
        assert r["deviation"] == (wanted if wanted < 2**63 else None)
