"""Missing values: sentinels, fills, ordered fills without a single-partition window, and policies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks, spline
from .templates import numeric_columns
from .types import SENTINELS


def sentinels_to_null(df: DataFrame, columns: list[str] | None = None, sentinels=SENTINELS) -> DataFrame:
    """Strings that stand for a missing value become null."""
    chosen = set(columns or [c for c, t in df.dtypes if t == "string"])
    return df.select(*[F.when(~F.col(c).isin(*sentinels), F.col(c)).alias(c) if c in chosen else c for c in df.columns])


def _with_statistic(df: DataFrame, column: str, statistic: Column) -> DataFrame:
    row = df.agg(statistic.alias("_fill"))  # one row
    return df.crossJoin(F.broadcast(row)).withColumn(column, F.coalesce(F.col(column), F.col("_fill"))).drop("_fill")


def _with_value(df: DataFrame, column: str, value: float | None) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value).cast("double")))


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    return _with_statistic(df, column, F.avg(column))


def fill_median(df: DataFrame, column: str) -> DataFrame:
    return _with_value(df, column, ranks.median(df, column))


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the least on ties; counted per value, so that one aggregate state stays small."""
    top = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).count().orderBy(F.desc("count"), "_v").limit(1).select(F.col("_v").alias("_fill"))
    filled = df.join(F.broadcast(top), F.lit(True), "left")  # one row at most
    return filled.withColumn(column, F.coalesce(F.col(column), F.col("_fill"))).drop("_fill")


def fill_value(df: DataFrame, column: str, value=0) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.na.drop(subset=[column])


def fill_outlier_median(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Median of the values within ``limit`` population deviations; the plain median below three values."""
    mean, spread, n = df.agg(F.avg(column), F.stddev_pop(column), F.count(column)).first()
    near = df if n < 3 or not spread else df.where(F.abs(F.col(column) - F.lit(mean)) / F.lit(spread) < limit)
    return _with_value(df, column, ranks.median(near, column))


def _known(column: str) -> Column:
    return F.last(column, ignorenulls=True)


def _backward(order: list[str]) -> list[Column]:
    """The order from its end: a window up to its last row reads all that follows again for every row, one from the first row does not."""
    return [F.desc_nulls_last(c) for c in order]


def fill_forward(df: DataFrame, column: str, order: list[str], keys: list[str] = ()) -> DataFrame:
    """The last known value before; over whole tables too, by ranges with the value carried in."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(column, _known(column).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _carried(df, column, order, True)


def fill_backward(df: DataFrame, column: str, order: list[str], keys: list[str] = ()) -> DataFrame:
    """The next known value."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(*_backward(order))
        return df.withColumn(column, _known(column).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _carried(df, column, order, False)


def _carried(df: DataFrame, column: str, order: list[str], before: bool) -> DataFrame:
    """An ordered fill without keys: inside ranges of the order, then from the nearest range that knows one.

    The ranges are bounds on the first order column, so that they are a function of the row.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = F.col(order[0])
    number = F.unix_micros(lead.cast("timestamp")) if dict(df.dtypes)[order[0]] in ("timestamp", "timestamp_ntz", "date") else lead.cast("double")
    bounds = df.agg(F.percentile_approx(number, [i / n for i in range(1, n)] if n > 1 else [0.5], 1000).alias("b")).first()["b"] or []
    place = sum(((number > F.lit(b)).cast("int") for b in bounds), F.lit(0)).cast("int")
    tagged = df.withColumn("_range", F.coalesce(place, F.lit(0)))
    span = Window.partitionBy("_range").orderBy(*(order if before else _backward(order))).rowsBetween(Window.unboundedPreceding, 0)
    edge = tagged.where(F.col(column).isNotNull()).groupBy("_range").agg((F.max_by if before else F.min_by)(column, F.struct(*order)).alias("_edge"))
    ranges = df.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_range")).join(edge, "_range", "left")  # a row per range
    over = Window.orderBy(*(["_range"] if before else _backward(["_range"]))).rowsBetween(Window.unboundedPreceding, -1)
    carry = ranges.select("_range", _known("_edge").over(over).alias("_carry"))
    return tagged.join(F.broadcast(carry), "_range").withColumn(column, F.coalesce(_known(column).over(span), F.col("_carry"))).drop("_range", "_carry")


def interpolate(df: DataFrame, column: str, order: list[str], keys: list[str]) -> DataFrame:
    """Straight lines between known neighbours by position; the last value after the end, nothing before the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(w)
    rows = df.withColumn("_i", place).withColumn("_k", F.when(F.col(column).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(column).cast("double").alias("v"))))
    rows = rows.withColumn("_p", F.last("_k", ignorenulls=True).over(back)).withColumn("_n", F.last("_k", ignorenulls=True).over(ahead))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p.i")) / F.nullif(F.col("_n.i") - F.col("_p.i"), F.lit(0))
    return rows.withColumn(column, F.coalesce(F.col(column).cast("double"), line, F.when(F.col("_n").isNull(), F.col("_p.v")))).drop("_i", "_k", "_p", "_n")


def interpolate_quadratic(df: DataFrame, column: str, order: list[str], keys: list[str]) -> DataFrame:
    """A parabola by position through the known neighbours of a gap and the known point beyond the nearer one.

    Straight lines where a series has fewer than three known points; the last value after the end, nothing
    before the first. A spline over the whole series would not be local; inside a gap the two differ little.
    """
    known_only = Window.partitionBy(*keys).orderBy("_i")
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(w).cast("double")).withColumn("_v", F.col(column).cast("double"))
    point = F.struct(F.col("_i").alias("i"), F.col("_v").alias("v"))
    known = rows.where("_v IS NOT NULL").select(*keys, "_i", F.struct(F.lag(point).over(known_only).alias("before"), point.alias("own"), F.lead(point).over(known_only).alias("after")).alias("_k"))
    joined = rows.join(known, [*keys, "_i"], "left")
    back = known_only.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    near = joined.withColumn("_p", F.last("_k", ignorenulls=True).over(back)).withColumn("_n", F.last("_k", ignorenulls=True).over(ahead))
    a, b = F.col("_p.own"), F.col("_n.own")
    nearer_left = F.col("_i") - a["i"] <= b["i"] - F.col("_i")
    c = F.when(nearer_left, F.coalesce("_p.before", "_n.after")).otherwise(F.coalesce("_n.after", "_p.before"))
    x = F.col("_i")

    def share(p: Column, q: Column, r: Column) -> Column:
        return p["v"] * (x - q["i"]) * (x - r["i"]) / ((p["i"] - q["i"]) * (p["i"] - r["i"]))

    curve = share(a, b, c) + share(b, a, c) + share(c, a, b)
    line = a["v"] + (b["v"] - a["v"]) * (x - a["i"]) / (b["i"] - a["i"])
    value = F.when(F.col("_v").isNotNull(), F.col("_v")).when(F.col("_p").isNull(), None).when(F.col("_n").isNull(), a["v"]).when(c.isNotNull(), curve).otherwise(line)
    return near.withColumn(column, value).select(*df.columns)


def _nearest(width: int, k: int):
    """The k nearest donors of one block for each row of a block of holes, equal distances by the donor's rank."""

    def of_block(holes: pa.Table, donors: pa.Table) -> pa.Table:
        x, z = ([(t[f"x{i}"].is_null().to_numpy(), t[f"x{i}"].to_numpy()) for i in range(width)] for t in (holes, donors))
        rank = np.argsort(donors["rank"].to_numpy(), kind="stable")
        z = [(lacks[rank], value[rank]) for lacks, value in z]
        hole, donor, far = [], [], []
        step = max(1, (1 << 20) // max(1, len(rank)))
        for at in range(0, len(holes) if len(rank) else 0, step):
            some = slice(at, at + step)
            total, valid = 0.0, 0
            for (lacks, value), (lacks_too, other) in zip(x, z, strict=True):
                both = ~(lacks[some, None] | lacks_too)
                total = total + np.where(both, np.square(value[some, None] - other), 0.0)
                valid = valid + both
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(valid > 0, np.sqrt(width / valid * total), np.inf)
            # all that are not beyond the k-th, NaN being beyond everything; the order is stable
            bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < len(rank) else np.nan
            row, column = np.nonzero(~(d > bound))
            value = d[row, column]
            order = np.lexsort((column, value, row))
            row = row[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
            hole.append(at + row[keep])
            donor.append(rank[column[order][keep]])
            far.append(value[order][keep])
        hole, donor, far = (np.concatenate([np.zeros(0, t), *some]) for t, some in ((np.int64, hole), (np.int64, donor), (np.float64, far)))
        found = donors.take(donor)
        own = [holes[f"x{i}"].take(hole) for i in range(width)]
        return pa.table([*own, pa.array(far), found["key"], found["y"]], names=[*[f"_x{i}" for i in range(width)], "d", "key", "y"])

    return of_block


def knn_impute(df: DataFrame, target: str, others: list[str], key: str, k: int = 5, donors: int = 10_000) -> DataFrame:
    """Mean of the k nearest donors over the other columns, distances scaled up for what is missing.

    Donors are all rows that know the target. Equal distances go by ``key``, so that of donors that are alike in
    the other columns only the first k can be among the nearest, and rows to fill that are alike have the
    same ones. What is left of both meets in blocks of about ``donors`` rows, and the nearest of all blocks
    are merged. Without other columns it is the mean.
    """
    if not others:
        return fill_mean(df, target)
    source = df.where(F.col(target).isNotNull())
    x = [f"x{i}" for i in range(len(others))]
    values = [F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(others, x, strict=True)]
    entry = source.select(F.col(f"`{key}`").alias("key"), F.col(f"`{target}`").cast("double").alias("y"), *values)
    alike = Window.partitionBy(*x).orderBy("key", "y")
    known = entry.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= k).drop("_r")
    holes = df.where(F.col(f"`{target}`").isNull())
    wanted = holes.select(*values).distinct()
    many, few = known.count(), wanted.count()
    blocks, groups = max(1, -(-many // donors)), max(1, -(-few // donors))
    dealt = known.withColumn("block", F.pmod(F.xxhash64("key", "y", *x), F.lit(blocks)).cast("int"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("key", "y")))
    placed = wanted.withColumn("group", F.pmod(F.xxhash64(*x), F.lit(groups)).cast("int"))
    every = lambda d, n, c: d.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left, right = every(placed, blocks, "block").groupBy("group", "block"), every(ranked, groups, "group").groupBy("group", "block")
    kind = df.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    schema = ", ".join([*[f"_{c} double" for c in x], "d double", f"key {kind}", "y double"])
    near = left.cogroup(right).applyInArrow(_nearest(len(x), k), schema)
    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "key", "y"))), 1, k)
    mean = F.aggregate("_best", F.lit(0.0), lambda a, n: a + n["y"]) / F.nullif(F.size("_best"), F.lit(0))
    found = near.groupBy(*[f"_{c}" for c in x]).agg(best.alias("_best")).withColumn("_mean", mean).drop("_best")
    alike_too = reduce(lambda a, b: a & b, [v.eqNullSafe(found[f"_{c}"]) for v, c in zip((F.col(f"`{c}`").cast("double") for c in others), x, strict=True)])
    filled = holes.join(found, alike_too, "left").withColumn(target, F.col("_mean")).select(*[F.col(f"`{c}`") for c in df.columns])
    return source.withColumn(target, F.col(f"`{target}`").cast("double")).unionByName(filled)


@dataclass(frozen=True)
class Policy:
    """What to do with a column: strategy, value, and the fallback where more than ``threshold`` is missing.

    forward, backward, linear and polynomial go by ``order`` inside ``keys`` (linear needs some); knn takes the
    ``neighbours`` rows that are nearest in ``others``, rows being told apart by ``key``.
    """

    strategy: str
    value: object = None
    threshold: float = 0.5
    fallback: str = "remove"
    order: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    others: tuple[str, ...] = ()
    key: str | None = None
    neighbours: int = 5


_STRATEGIES = {
    "remove": lambda d, c, p: drop_missing(d, c), "mean": lambda d, c, p: fill_mean(d, c), "median": lambda d, c, p: fill_median(d, c),
    "mode": lambda d, c, p: fill_mode(d, c), "zero": lambda d, c, p: fill_value(d, c, 0), "empty": lambda d, c, p: fill_value(d, c, ""),
    "false": lambda d, c, p: fill_value(d, c, False), "custom": lambda d, c, p: fill_value(d, c, 0 if p.value is None else p.value),
    "outlier": lambda d, c, p: fill_outlier_median(d, c), "keep": lambda d, c, p: d,
    "forward": lambda d, c, p: fill_forward(d, c, list(p.order), list(p.keys)), "backward": lambda d, c, p: fill_backward(d, c, list(p.order), list(p.keys)),
    "linear": lambda d, c, p: interpolate(d, c, list(p.order), list(p.keys)), "polynomial": lambda d, c, p: spline.interpolate_spline(d, c, list(p.order), list(p.keys)),
    "knn": lambda d, c, p: knn_impute(d, c, list(p.others), p.key, p.neighbours),
}


def default_policies(df: DataFrame) -> dict[str, Policy]:
    """By type and share missing: over half removes, numbers take the median, booleans false, the rest the mode."""
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{i}") for i, c in enumerate(df.columns)]).first()
    kinds, numbers = dict(df.dtypes), set(numeric_columns(df))
    out = {}
    for i, c in enumerate(df.columns):
        if row[f"c_{i}"] < row["n"]:
            out[c] = Policy("median" if c in numbers else "false" if kinds[c] == "boolean" else "mode")
    return out


def _counted(df: DataFrame, names: list[str], without: str | None = None):
    """Rows and known values of each column; with ``without`` these, and the same of the rows that know this column."""
    kept = F.lit(True) if without is None else F.col(f"`{without}`").isNotNull()
    facts = lambda test: [F.count_if(test), *[F.count_if(test & F.col(f"`{c}`").isNotNull()) for c in names]]
    row = tuple(df.agg(*facts(F.lit(True)), *(facts(kept) if without else [])).first())
    return (row[: len(names) + 1], row[len(names) + 1 :]) if without else row


def imputation_report(df: DataFrame, policies: dict[str, Policy]) -> tuple[DataFrame, DataFrame]:
    """The table with policies applied column by column, and a row for each policy.

    name, strategy (the fallback's where too much was missing), missing_before, missing_after, rows_removed,
    imputed, improvement (share of the missing values that are gone) and warning. Each column is measured
    on what the ones before left. Fills change neither the rows nor other columns, so that the table is counted once, once
    more for each removal, and once at the end.
    """
    names = list(policies)
    place = {c: i + 1 for i, c in enumerate(names)}
    steps, after = [], {}  # name, policy, strategy, rows and missing before; rows and missing after
    waiting: list[str] = []
    now = _counted(df, names)
    for c, p in policies.items():
        n, known = now[0], now[place[c]]
        strategy = p.fallback if n > 0 and 1 - known / n > p.threshold else p.strategy
        steps.append((c, p, strategy, n, n - known))
        if strategy == "remove":
            # what the fills since the last removal left, and what this one leaves, from one job
            earlier, now = _counted(df, names, c)
            after |= {w: (earlier[0], earlier[0] - earlier[place[w]]) for w in waiting} | {c: (now[0], 0)}
            waiting = []
        else:
            waiting.append(c)
        df = _STRATEGIES[strategy](df, c, p)
    if waiting:
        now = _counted(df, names)
        after |= {w: (now[0], now[0] - now[place[w]]) for w in waiting}
    facts = []
    for c, p, strategy, n, before in steps:
        left, still = after[c]
        over = n > 0 and before / n > p.threshold
        warning = f"{c}: over {100 * p.threshold:g} % missing, {strategy} instead of {p.strategy}" if over and strategy != p.strategy else None
        facts.append((c, strategy, before, still, n - left, max(0, before - still - (n - left)), (before - still) / before if before else 0.0, warning))
    schema = "name string, strategy string, missing_before long, missing_after long, rows_removed long, imputed long, improvement double, warning string"
    return df, df.sparkSession.createDataFrame(facts, schema)  # a row for each policy


def apply_policies(df: DataFrame, policies: dict[str, Policy], sequential: bool = False) -> DataFrame:
    """Fill or remove by policy; ``sequential`` measures each column on what earlier removals left."""
    count = lambda d: d.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in policies]).first()
    if not policies:
        return df
    row = count(df)
    for c, p in policies.items():
        share = 1 - row[c] / row["n"] if row["n"] else 0.0
        strategy = p.fallback if share > p.threshold else p.strategy
        df = _STRATEGIES[strategy](df, c, p)
        if sequential and strategy == "remove":
            row = count(df)
    return df
