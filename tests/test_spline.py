"""Splines over series against a plain solver, in stretches so short that systems are reduced several times."""

import numpy as np
import pandas as pd
import pytest

from tallyloom.operators import ranks, spline


def plain(values: list[float | None]) -> list[float | None]:
    """B-splines of degree two by the recursion of their definition and a dense solver."""
    x = np.array([i for i, v in enumerate(values) if v is not None], dtype=float)
    if len(x) < 3:
        return values
    middles = ((x[1:] + x[:-1]) / 2)[1:-1]
    t = np.r_[[x[0]] * 3, middles, [x[-1]] * 3]

    def basis(j: int, k: int, at: float) -> float:
        if k == 0:
            return float(t[j] <= at < t[j + 1] or (at == t[-1] and t[j] < t[j + 1] == t[-1]))
        left = (at - t[j]) / (t[j + k] - t[j]) * basis(j, k - 1, at) if t[j + k] > t[j] else 0.0
        right = (t[j + k + 1] - at) / (t[j + k + 1] - t[j + 1]) * basis(j + 1, k - 1, at) if t[j + k + 1] > t[j + 1] else 0.0
        return left + right

    row = lambda at: [basis(j, 2, at) if t[j] <= at <= t[j + 3] else 0.0 for j in range(len(x))]
    weights = np.linalg.solve(np.array([row(a) for a in x]), np.array([values[int(a)] for a in x]))
    return [v if v is not None or not x[0] < i < x[-1] else float(np.dot(row(float(i)), weights)) for i, v in enumerate(values)]


def filled(spark, series: dict, **more) -> dict:
    rows = [(k, i, v) for k, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    out = {}
    for r in spline.interpolate_spline(df, "v", ["t"], ["k"], **more).orderBy("k", "t").collect():
        out.setdefault(r["k"], []).append(r["v"])
    return out


def close(got, want):
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None], rtol=1e-8, atol=1e-8)


def holed(rng, n: int, share: float) -> list[float | None]:
    return [None if rng.random() < share else float(rng.normal() * 10) for _ in range(n)]


def test_parabola(spark):
    got = filled(spark, {"a": [None, 1.0, None, 9.0, None, None, 36.0, None], "nan": [0.0, float("nan"), 4.0, None, 16.0]})
    close(got["a"], [None, 1.0, 4.0, 9.0, 16.0, 25.0, 36.0, None])
    close(got["nan"], [0.0, 1.0, 4.0, 9.0, 16.0])


@pytest.mark.parametrize("stretch", [5, 64])
def test_against_plain(spark, stretch):
    rng = np.random.default_rng(stretch)
    series = {f"s{n}": holed(rng, n, share) for n, share in ((1, 0.5), (3, 0.2), (4, 0.5), (7, 0.3), (30, 0.5), (61, 0.9), (150, 0.1), (200, 0.6))}
    series |= {"none": [None, None], "one": [None, 2.0, None], "whole": [1.0, 2.0, 5.0]}
    got = filled(spark, series, stretch=stretch)
    for k, values in series.items():
        close(got[k], plain(values))


def test_few_points(spark):
    series = {"two": [None, 2.0, None, None, 8.0, None], "one": [1.0, None], "three": [0.0, None, 4.0, 9.0]}
    assert filled(spark, series)["two"] == series["two"]
    got = filled(spark, series, few="linear")
    close(got["two"], [None, 2.0, 4.0, 6.0, 8.0, None])
    close(got["one"], [1.0, None])
    close(got["three"], [0.0, 1.0, 4.0, 9.0])
    with pytest.raises(ValueError):
        filled(spark, series, few="mean")


def test_long_series_without_key(spark):
    """10 000 points in stretches of 64 and one gap of 5000 positions, with columns of other names and null keys."""
    rng = np.random.default_rng(3)
    values = [float(v) if rng.random() < 0.7 else None for v in rng.normal(size=3000)] + [None] * 5000 + [float(v) for v in rng.normal(size=2000)]
    df = spark.createDataFrame(pd.DataFrame({"t": range(len(values)), "v": pd.array(values, dtype="Float64"), "u": "x", "before": 1}))
    out = spline.interpolate_spline(df, "v", ["t"], stretch=64)
    assert out.columns == df.columns
    got = [r["v"] for r in out.orderBy("t").collect()]
    # the equations of a banded system, checked by what a spline is: its pieces meet with one slope at the knots
    x = [i for i, v in enumerate(values) if v is not None]
    assert all(got[i] == values[i] for i in x)
    close(filled(spark, {"k": values}, stretch=4096)["k"], got)
    assert all(g is not None for g in got[x[0] : x[-1]])


def test_empty_and_null_keys(spark):
    none = spark.createDataFrame([], "k string, t int, v int")
    out = spline.interpolate_spline(none, "v", ["t"], ["k"])
    assert out.count() == 0 and dict(out.dtypes)["v"] == "double"
    rows = [(k, i, v) for k in (None, "", "null") for i, v in enumerate([0, None, 4, 9])]
    got = spline.interpolate_spline(spark.createDataFrame(rows, "k string, t int, v int"), "v", ["t"], ["k"]).orderBy("k", "t").collect()
    assert [round(r["v"], 9) for r in got] == [0.0, 1.0, 4.0, 9.0] * 3


def test_numbered(spark):
    df = spark.range(100_000).selectExpr("(id * 7919) % 100003 AS v")
    out = ranks.numbered(df, ["v"], "n")
    assert out.selectExpr("count(*)", "min(n)", "max(n)", "count(DISTINCT n)").first()[:] == (100_000, 0, 99_999, 100_000)
    assert out.join(out.selectExpr("n + 1 AS n", "v AS earlier"), "n").where("earlier >= v").count() == 0
