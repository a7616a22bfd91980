"""The isotonic fit by ranges against one that looks at all stretches of points, whatever the labels do."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from tidemark.operators import isotonic

RNG = np.random.default_rng(3)
X = np.sort(RNG.random(300)).round(2)
CASES = {
    "noise": [(float(x), int(RNG.random() < 0.5)) for x in X],
    "rises": [(float(x), int(RNG.random() < x)) for x in X],
    "falls": [(float(x), int(RNG.random() > x)) for x in X],
    "saw": [(float(i), int(i % 20 >= 10)) for i in range(200)],
    "steps": [(float(i), int(i >= 100)) for i in range(200)],
    "one score": [(0.5, 1), (0.5, 0), (0.5, 0)],
    "zeros": [(0.0, 1), (-0.0, 0), (1.0, 1), (-1.0, 0)],
}


def least_squares(rows: list[tuple[float, int]]) -> dict[float, float]:
    """The greatest of the least means of the stretches around each score."""
    scores = sorted({s for s, _ in rows})
    y = np.cumsum([0] + [sum(label for s, label in rows if s == x) for x in scores])
    n = np.cumsum([0] + [sum(1 for s, _ in rows if s == x) for x in scores])
    k = len(scores)
    means = [[(y[b + 1] - y[a]) / (n[b + 1] - n[a]) if b >= a else np.inf for b in range(k)] for a in range(k)]
    least = np.minimum.accumulate(np.array(means)[:, ::-1], axis=1)[:, ::-1]
    return {scores[i]: max(least[a][i] for a in range(i + 1)) for i in range(k)}


@pytest.fixture
def ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("case", CASES)
def test_fit_is_that_of_all_stretches(spark, ranges, case):
    sample = spark.createDataFrame(CASES[case], "s double, label int").repartition(5)
    steps = sorted(map(tuple, isotonic.fitted(sample, "s", "label").collect()))
    expected = least_squares(CASES[case])
    assert {s: v for s in expected for first, last, _, _, v in steps if first <= s <= last} == expected
    assert sum(x[3] for x in steps) == len(CASES[case]) and sum(x[2] for x in steps) == sum(label for _, label in CASES[case])
    means = [Fraction(y, n) for _, _, y, n, _ in steps]
    assert all(a <= b for a, b in zip(means, means[1:]))


def test_between_and_beyond_the_steps(spark):
    sample = spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 1), (5.0, 0), (8.0, 1), (None, 1), (float("nan"), 0), (3.0, None)], "s double, label int")
    steps = isotonic.fitted(sample, "s", "label")
    assert sorted(map(tuple, steps.collect())) == [(1.0, 2.0, 0, 2, 0.0), (4.0, 5.0, 1, 2, 0.5), (8.0, 8.0, 1, 1, 1.0)]
    rows = spark.createDataFrame([(0.0, "a"), (1.5, "b"), (3.0, "c"), (4.0, "d"), (6.5, "e"), (8.0, "f"), (99.0, "g"), (None, "h"), (float("nan"), "i"), (3.0, "c")], "first double, own string")
    got = sorted((r["own"], r["fit"]) for r in isotonic.predicted(steps, rows, "first", "fit").collect())
    assert got == [("a", 0.0), ("b", 0.0), ("c", 0.25), ("c", 0.25), ("d", 0.5), ("e", 0.75), ("f", 1.0), ("g", 1.0), ("h", None), ("i", None)]
    none = isotonic.fitted(sample.limit(0), "s", "label")
    assert none.count() == 0 and [r["fit"] for r in isotonic.predicted(none, rows.limit(1), "first", "fit").collect()] == [None]
