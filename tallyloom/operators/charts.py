"""Data behind charts, pivots, histograms, correlations and box plots."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks

_AGG = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": F.median}


def bar(df: DataFrame, x: str, y: str | None = None, how: str = "sum") -> DataFrame:
    known = df.where(F.col(x).isNotNull())
    if y is None:
        return known.groupBy(x).agg(F.count("*").alias("count")).orderBy(F.desc("count"), x)
    return known.groupBy(x).agg(_AGG[how](y).alias("value")).orderBy(x)


def line(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    known = df.where(F.col(x).isNotNull())
    return known.groupBy(x).agg(F.count("*").alias("count")).orderBy(x) if y is None else known.select(x, y).orderBy(x, y)


def pie(df: DataFrame, x: str) -> DataFrame:
    return bar(df, x)


def scatter(df: DataFrame, x: str, y: str, key: str, one_in: int = 1) -> DataFrame:
    """Points, every ``one_in``-th by the hash of ``key`` where there are too many to draw."""
    points = df.where(F.pmod(F.xxhash64(key), F.lit(one_in)) == 0) if one_in > 1 else df
    return points.select(key, x, y)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal bins closed on the right, the first one at both ends; empty bins too."""
    v = F.col(column).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    ends = known.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    place = F.coalesce(F.ceil(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(1))
    counts = known.crossJoin(F.broadcast(ends)).groupBy(F.least(F.greatest(place, F.lit(1)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, "bin", "left").where("lo IS NOT NULL AND (hi > lo OR bin = 1)").select(
        "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_low"), (F.col("lo") + F.col("bin") * width).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def heatmap(df: DataFrame, x: str, y: str, columns: list, value: str | None = None, how: str = "sum") -> DataFrame:
    """x by y: counts, or an aggregate of ``value``; zero where nothing falls."""
    return df.groupBy(x).pivot(y, columns).agg(F.count(F.lit(1)) if value is None else _AGG[how](value)).na.fill(0)


def correlations(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """Pairwise correlations of complete pairs whose size is above ``least``."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(made)).where(F.abs("correlation") > least)


def box(df: DataFrame, column: str) -> DataFrame:
    """Quartiles and whiskers (least and greatest value within 1.5 times the middle half)."""
    q1, middle, q3 = ranks.quantiles(df, [column], [0.25, 0.5, 0.75])[column]
    reach = 1.5 * (q3 - q1) if q1 is not None else None
    inside = df.where(F.col(column).between(q1 - reach, q3 + reach)) if q1 is not None else df.where(F.lit(False))
    facts = inside.agg(F.min(column).alias("low"), F.max(column).alias("high")).where("low IS NOT NULL")
    return facts.select(*[F.lit(v).cast("double").alias(k) for k, v in (("q1", q1), ("median", middle), ("q3", q3))], "low", "high")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, one row a column."""
    aggs, quartiles = [], ranks.quantiles(df, columns, [0.25, 0.5, 0.75])
    for c in columns:
        aggs.append(F.struct(
            F.lit(c).alias("name"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            *[F.lit(q).cast("double").alias(k) for k, q in zip(("p25", "p50", "p75"), quartiles[c], strict=True)], F.max(c).cast("double").alias("max"),
        ).alias(c))
    return df.agg(*aggs).select(F.inline(F.array(*columns)))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)
