"""The question templates as DataFrame functions: aggregate, compare, trend, distribution, rank, select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks
from .filters import where_all

_FUNCTIONS = {
    "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "STDDEV": F.stddev_samp, "COUNT": F.count,
}
_NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in _NUMERIC or t.startswith("decimal")]


def aggregate(df: DataFrame, function: str | None = None, columns: list[str] | None = None, filters: list[tuple] = ()) -> DataFrame:
    """One row: the function over each column; without one, sums of numbers and counts of the rest."""
    df = where_all(df, list(filters))
    if columns is not None and not columns:
        return df.agg(F.count("*").alias("total_count"))
    numbers = numeric_columns(df)
    chosen = columns or numbers
    if function == "MEDIAN":
        middle = ranks.quantiles(df, chosen, [0.5])
        return df.sparkSession.range(1).select(*[F.lit(middle[c][0]).cast("double").alias(f"median_{c}") for c in chosen])
    out: list[Column] = []
    for c in chosen:
        name = function or ("SUM" if c in numbers else "COUNT")
        out.append(_FUNCTIONS[name](c).alias(f"{name.lower()}_{c}"))
    return df.agg(*out)


def compare_groups(df: DataFrame, values: list[str], key: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(f"avg_{c}") for c in values]).orderBy(key)


def trend(df: DataFrame, date: str, value: str) -> DataFrame:
    return df.groupBy(date).agg(F.avg(value).alias(f"avg_{value}")).orderBy(date)


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Count and percentage of the whole for each value, missing ones too, most frequent first."""
    counts = df.groupBy(key).agg(F.count("*").alias("count"))
    total = df.agg(F.count("*").alias("_n"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(key, "count", (F.col("count") * 100.0 / F.col("_n")).alias("percentage")).orderBy(F.desc("count"), key)


def rank(df: DataFrame, columns: list[str], n: int = 10, bottom: bool = False, ties: list[str] = ()) -> DataFrame:
    """Top (or bottom) rows by the first column; missing values come last either way."""
    first = F.col(columns[0])
    return df.select(*columns).orderBy(first.asc_nulls_last() if bottom else first.desc_nulls_last(), *ties).limit(n)


def select(df: DataFrame, columns: list[str] | None = None, filters: list[tuple] = ()) -> DataFrame:
    return where_all(df, list(filters)).select(*(columns or ["*"]))
