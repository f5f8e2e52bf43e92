"""Quadratic splines through the known values of ordered series, one system of equations for all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from . import ranks

#: Equations that one task solves at a time, and positions that one row of a piece expands to.
STRETCH = 4096
#: Known points on either side that the knots around a point depend on.
REACH = 3

_EQUATION = "_n long, _i long, _v double, lo double, di double, up double, a double, b double, c double, d double, slope double"
_REDUCED = "_n long, lo double, di double, up double, _v double"


def interpolate_spline(df: DataFrame, column: str, order: list[str], keys: list[str] = (), few: str = "keep", stretch: int = STRETCH) -> DataFrame:
    """Missing values from the quadratic spline through the known ones, by position; ``column`` becomes double.

    The knots are the middles between neighbouring points, without the first and the last of them, so that a series of three
    is one parabola. Nothing is filled before the first known point or after the last. Series of fewer than
    three known points stay as they are; with ``few="linear"`` two points are joined by a straight line. NaN
    counts as missing; no rows give no rows. Rows of one key that tie in ``order`` come in any order.

    A coefficient depends on all points of its series, but only neighbours share an equation. All series, in a
    row, are one tridiagonal system: stretches of it are reduced to equations between their ends, these are
    solved in the same way, and the stretches are filled in from their ends. No series, however long, comes
    into one task, and short ones share tasks. Rows are numbered by two sorts whose results are written.
    """
    if few not in ("keep", "linear"):
        raise ValueError(f"few is {few}, not keep or linear")
    if stretch <= REACH:
        raise ValueError(f"stretches of {stretch} points, which must be over {REACH}")
    v = F.col(column).cast("double")
    series = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = ranks.numbered(df.withColumn("_v", F.when(~F.isnan(v), v)).withColumn("_s", series), [*keys, *order], "_i")
    known = ranks.numbered(rows.where("_v IS NOT NULL").select("_s", "_i", "_v"), ["_i"], "_n")
    count = known.count()
    if not count:
        return rows.withColumn(column, F.col("_v")).select(*df.columns)
    path = shared.folder(df.sparkSession, "spline")
    cell = lambda n: F.expr(f"({n}) DIV {stretch}L")
    # points near the end of a stretch are known to the next one too
    near = known.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(f"greatest(_n - {REACH}, 0)"), cell("_n"), cell(f"_n + {REACH}")))))
    near.groupBy("_cell").applyInPandas(_equations(stretch, few == "linear"), _EQUATION).write.parquet(path)
    pieces = _solved(df.sparkSession.read.parquet(path), count, stretch).where("c IS NOT NULL")
    return rows.join(_values(pieces, stretch), "_i", "left").withColumn(column, F.coalesce("_v", "_filled")).select(*df.columns)


def _values(pieces: DataFrame, stretch: int) -> DataFrame:
    """_i, _filled at all whole positions of each piece, from b to before c, but for its known point."""
    ends = pieces.withColumn("_first", F.ceil("b").cast("long")).withColumn("_last", F.ceil("c").cast("long") - 1)
    cells = ends.where("_last > _first OR (_last = _first AND _first <> _i)").withColumn("_cell", F.explode(F.expr(f"sequence(_first DIV {stretch}L, _last DIV {stretch}L)")))
    inside = F.expr(f"sequence(greatest(_first, _cell * {stretch}L), least(_last, _cell * {stretch}L + {stretch - 1}L))")
    x = F.col("_x")
    curve = F.col("u") + (F.col("before") - F.col("u")) * F.pow(F.col("c") - x, 2) / ((F.col("c") - F.col("a")) * (F.col("c") - F.col("b"))) + (
        F.col("after") - F.col("u")
    ) * F.pow(x - F.col("b"), 2) / ((F.col("d") - F.col("b")) * (F.col("c") - F.col("b")))
    line = F.col("_v") + F.col("slope") * (x - F.col("_i"))
    return cells.withColumn("_x", F.explode(inside)).where("_x <> _i").select(x.alias("_i"), F.coalesce(line, curve).alias("_filled"))


def _equations(stretch: int, lines: bool):
    """Of each point: its equation, and the knots a to d around the piece from b to c that is its own."""

    def make(cell: tuple, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("_n")
        number, x, v = points["_n"].to_numpy(), points["_i"].to_numpy(), points["_v"].to_numpy()
        series = points["_s"].to_numpy()
        n = len(x)
        at = np.arange(n)

        def neighbour(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            there = np.clip(at + k, 0, n - 1)
            return (at + k == there) & (series[there] == series), x[there].astype(float), v[there]

        (l1, p1, _), (l2, p2, _), (l3, _, _) = (neighbour(-k) for k in (1, 2, 3))
        (r1, n1, v1), (r2, n2, _), (r3, _, _) = (neighbour(k) for k in (1, 2, 3))
        own = x.astype(float)
        a = np.where(l3, (p2 + p1) / 2, np.where(l2, p2, p1))
        b = np.where(l2, (p1 + own) / 2, p1)
        c = np.where(r2, (own + n1) / 2, n1)
        d = np.where(r3, (n1 + n2) / 2, np.where(r2, n2, n1))
        inner = l1 & r1
        line = lines & r1 & ~r2 & ~l1
        with np.errstate(divide="ignore", invalid="ignore"):
            lo = np.where(inner, (c - own) ** 2 / ((c - a) * (c - b)), 0.0)
            up = np.where(inner, (own - b) ** 2 / ((d - b) * (c - b)), 0.0)
            slope = np.where(line, (v1 - v) / (n1 - own), np.nan)
        piece = lambda e: np.where(inner | line, e, np.nan)  # noqa: E731  (NaN comes back as null)
        out = pd.DataFrame({"_n": number, "_i": x, "_v": v, "lo": lo, "di": 1 - lo - up, "up": up, "a": piece(a), "b": piece(np.where(line, own, b)), "c": piece(np.where(line, n1, c)), "d": piece(d), "slope": slope})
        return out[number // stretch == cell[0]]

    return make


def _sweep(lo: np.ndarray, di: np.ndarray, up: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of one stretch for several right sides (columns), lo[0] and up[-1] left out."""
    n = len(di)
    ratio, out = np.zeros(n), np.array(right, dtype=float)
    pivot = di[0]
    out[0] /= pivot
    for i in range(1, n):
        ratio[i - 1] = up[i - 1] / pivot
        pivot = di[i] - lo[i] * ratio[i - 1]
        out[i] = (out[i] - lo[i] * out[i - 1]) / pivot
    for i in range(n - 2, -1, -1):
        out[i] -= ratio[i] * out[i + 1]
    return out


def _ends(cell: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """The first and the last unknown of a stretch, each by its neighbours alone: the unknown outside and the other end."""
    part = part.sort_values("_n")
    lo, di, up, v = (part[c].to_numpy() for c in ("lo", "di", "up", "_v"))
    n, first = len(di), 2 * cell[0]
    if n == 1:
        return pd.DataFrame([(first, lo[0], di[0], up[0], v[0])], columns=["_n", "lo", "di", "up", "_v"])
    right = np.zeros((n, 3))  # known side, the share of the unknown before and of the one after
    right[:, 0] = v
    right[0, 1], right[-1, 2] = -lo[0], -up[-1]
    solved = _sweep(lo, di, up, right)
    (g0, before0, after0), (g1, before1, after1) = solved[0], solved[-1]
    s = after0 / after1 if after1 else 0.0
    t = before1 / before0 if before0 else 0.0
    # what lies beyond the other end is put out of both equations
    rows = [(first, -(before0 - s * before1), 1.0, -s, g0 - s * g1), (first + 1, -t, 1.0, -(after1 - t * after0), g1 - t * g0)]
    return pd.DataFrame(rows, columns=["_n", "lo", "di", "up", "_v"])


def _fill(cell: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """Unknowns of a stretch, with the ones before and after each, from the unknowns outside."""
    part = part.sort_values("_n").reset_index(drop=True)
    lo, di, up, right = (part[c].to_numpy(copy=True) for c in ("lo", "di", "up", "_v"))
    left, beyond = np.nan_to_num(part[["_left", "_right"]].iloc[0].to_numpy(dtype=float))
    right[0] -= lo[0] * left
    right[-1] -= up[-1] * beyond
    u = _sweep(lo, di, up, right[:, None])[:, 0]
    return part.drop(columns=["_cell", "_left", "_right"]).assign(u=u, before=np.r_[left, u[:-1]], after=np.r_[u[1:], beyond])


def _solved(system: DataFrame, count: int, stretch: int) -> DataFrame:
    """The system with its unknowns ``u`` and those ``before`` and ``after``; ``_n`` runs from 0 to under ``count``."""
    parts = system.withColumn("_cell", F.expr(f"_n DIV {stretch}L"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in system.schema) + ", u double, before double, after double"
    stretches = -(-count // stretch)
    if stretches == 1:
        sides = parts.withColumn("_left", F.lit(0.0)).withColumn("_right", F.lit(0.0))
    else:
        upper = _solved(parts.select("_cell", "_n", "lo", "di", "up", "_v").groupBy("_cell").applyInPandas(_ends, _REDUCED), 2 * stretches, stretch)
        sides = parts.join(upper.groupBy(F.expr("_n DIV 2L").alias("_cell")).agg(F.min_by("before", "_n").alias("_left"), F.max_by("after", "_n").alias("_right")), "_cell")
    columns = [*system.columns, "_cell", "_left", "_right"]
    return sides.select(*columns).groupBy("_cell").applyInPandas(_fill, schema)
