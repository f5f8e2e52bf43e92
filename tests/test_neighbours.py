"""Nearest donors against a look at all pairs."""

import math
import time

import numpy as np
import pytest

from tallyloom.operators import missing


def brute(rows: list[tuple], k: int) -> dict:
    """rows: key, target, others; the mean of the nearest k donors, ties by key."""
    out = {}
    for key, y, *x in rows:
        if y is not None:
            out[key] = y
            continue
        found = []
        for other, value, *z in rows:
            if value is not None:
                both = [(a - b) ** 2 for a, b in zip(x, z, strict=True) if a is not None and b is not None]
                found.append((math.sqrt(len(x) / len(both) * sum(both)) if both else math.inf, other, value))
        best = sorted(found)[:k]
        out[key] = sum(v for *_, v in best) / len(best) if best else None
    return out


def filled(spark, rows, k, **more):
    names = [f"c{i}" for i in range(len(rows[0]) - 2)]
    df = spark.createDataFrame(rows, "id long, y double, " + ", ".join(f"{n} double" for n in names))
    return {r["id"]: r["y"] for r in missing.knn_impute(df, "y", names, "id", k, **more).collect()}


@pytest.mark.parametrize(("n", "width", "donors", "lacking"), [(300, 4, 40, 0.3), (60, 3, 10_000, 0.5)])
def test_against_all_pairs(spark, n, width, donors, lacking):
    rng = np.random.default_rng(n)
    # few different whole numbers, so that distances tie; a third of the rows in one place
    cell = lambda i: None if rng.random() < lacking else (0.0 if i % 3 == 0 else float(rng.integers(-30, 30)))
    rows = [(i, None if rng.random() < 0.15 else float(rng.integers(0, 1000)), *[cell(i) for _ in range(width)]) for i in range(n)]
    got, want = filled(spark, rows, 5, donors=donors), brute(rows, 5)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i]) for i in want)


def test_few_donors(spark):
    rows = [(1, 4.0, 0.0), (2, None, 1.0), (3, 8.0, 5.0), (4, None, None)]
    assert filled(spark, rows, 5) == {1: 4.0, 2: 6.0, 3: 8.0, 4: 6.0}
    assert filled(spark, rows, 1) == {1: 4.0, 2: 4.0, 3: 8.0, 4: 4.0}
    assert filled(spark, [(1, None, 0.0)], 5) == {1: None}


def test_without_others(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "id int, y double")
    assert {r["id"]: r["y"] for r in missing.knn_impute(df, "y", [], "id").collect()} == {1: 2.0, 2: 3.0, 3: 4.0}
    assert missing.knn_impute(df.limit(0), "y", ["id"], "id").count() == 0


def test_few_places_are_compared_once(spark):
    """Many rows alike in the other columns: the nearest by key, in time that does not grow with the square."""
    n = 60_000
    df = spark.range(n).selectExpr("id", "IF(id % 5 = 2, NULL, CAST(id * 7919 % 10007 AS DOUBLE)) AS y", "IF(id % 1000 = 7, NULL, CAST(id % 25 AS DOUBLE)) AS x")
    began = time.monotonic()
    got = {r["id"]: r["y"] for r in missing.knn_impute(df, "y", ["x"], "id", 3).collect()}
    assert time.monotonic() - began < 60
    assert len(got) == n
    value = lambda i: float(i * 7919 % 10007)
    least = {x: [i for i in range(x, 1000, 25) if i % 5 != 2 and i % 1000 != 7][:3] for x in range(25)}
    # remainders of 25 fix those of 5: a hole meets no donor at its own place, and the next ones on either side tie
    for i in range(2, n, 4999):
        if i % 5 == 2 and i % 1000 != 7:
            near = sorted((abs(i % 25 - x), d) for x in range(25) for d in least[x])[:3]
            assert math.isclose(got[i], sum(value(d) for _, d in near) / 3)


def test_odd_places(spark):
    nan = float("nan")
    rows = [(1, 4.0, 0.0), (2, None, -0.0), (3, 8.0, nan), (4, None, nan), (5, 6.0, None), (6, None, None), (7, 2.0, 0.0), (8, None, 0.0)]
    assert filled(spark, rows, 2) == {1: 4.0, 2: 3.0, 3: 8.0, 4: 5.0, 5: 6.0, 6: 6.0, 7: 2.0, 8: 3.0}
