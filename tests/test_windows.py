"""Order statistics of ranges in arrays, and the window operators on dense series, against plain Python."""

import math
import statistics

import numpy as np
import pytest

from mediaframe.functions import windows as W
from mediaframe.operators import series as S


@pytest.mark.parametrize("n", [1, 2, 7, 64, 300])
def test_ranges(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, max(2, n // 3), n).astype(float)
    a = rng.integers(0, n, 200)
    b = a + 1 + (rng.random(200) * (n - a)).astype(int)
    own = a + (rng.random(200) * (b - a)).astype(int)
    distinct, place = W.dense(values)
    assert distinct[W.largest(place, a, b)].tolist() == [values[i:j].max() for i, j in zip(a, b)]
    for k in (np.zeros(200, int), (b - a) // 2, b - a - 1):
        assert distinct[W.kth(place, a, b, k)].tolist() == [sorted(values[i:j])[m] for i, j, m in zip(a, b, k)]
    assert W.medians(values, a, b).tolist() == [statistics.median(values[i:j]) for i, j in zip(a, b)]
    for got, i, j, m in zip(W.medians(values, a, b, own), a, b, own):
        rest = [*values[i:m], *values[m + 1 : j]]
        assert got == statistics.median(rest) if rest else math.isnan(got)


def series(spark, rows):
    return spark.createDataFrame(rows, "g string, t bigint, n bigint, v double, note string")


def dense_rows(n=600):
    rng = np.random.default_rng(3)
    rows = [("ab"[i % 2], int(t), i, None if i % 97 == 5 else float(v), f"r{i}") for i, (t, v) in enumerate(zip(rng.integers(0, 4000, n), rng.integers(0, 90, n)))]
    return [*rows, ("c", 10, 1000, 80.0, "alone"), (None, 10, 1001, 5.0, "no group"), (None, 12, 1002, 80.0, "no group"), (None, 14, 1003, 6.0, "no group")]


def groups(rows):
    for g in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        yield own[0], [r for r in own if r[3] is not None]


def test_robust_cuts(spark):
    rows, want = dense_rows(), set()
    for first, own in groups(rows):
        for r in own:
            others = [x[3] for x in own if abs(x[1] - r[1]) <= 100 and x is not r and x is not first]
            m = statistics.median(others) if others else None
            if r is not first and r[3] >= 40 and r[3] >= 1.5 * max(m or 0, 2):
                want.add((*r, m))
    got = S.robust_cuts(series(spark, rows), ["g"], "t", "n", "v", 40, 1.5, 2, 100)
    assert got.columns == ["g", "t", "n", "v", "note", "median"]
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50 and any(r[0] is None for r in want)


def test_adaptive_peaks(spark):
    rows, want = dense_rows(), set()
    for first, own in groups(rows):
        for r in own:
            near = [x[3] for x in own if abs(x[1] - r[1]) <= 300 and x is not first]
            m = statistics.median(near) if near else None
            if r[3] >= 10 and r[3] >= max(x[3] for x in own if abs(x[1] - r[1]) <= 40) and r[3] >= 1.2 * (m or 0) + 0.1:
                want.add((*r, m))
    got = S.adaptive_peaks(series(spark, rows), ["g"], "t", "n", "v", 10, 1.2, 0.1, 40, 300)
    assert {tuple(r) for r in got.collect()} == want and ("c", 10, 1000, 80.0, "alone", None) in want and any(r[0] is None for r in want)


@pytest.mark.parametrize("name", ["robust_cuts", "adaptive_peaks"])
def test_no_window_is_visited_row_by_row(spark, name, capsys):
    """Spark's own windows took a list or a percentile of the whole window for each row."""
    df = series(spark, dense_rows(20))
    (S.robust_cuts(df, ["g"], "t", "n", "v", 40, 1.5, 2, 100) if name == "robust_cuts" else S.adaptive_peaks(df, ["g"], "t", "n", "v", 10, 1.2, 0.1, 40, 300)).explain()
    assert "Window" not in capsys.readouterr().out
