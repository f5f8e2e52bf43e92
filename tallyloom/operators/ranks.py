"""Exact order statistics of whole columns without bringing a column into one task.

Quantile sketches cut the values of a column into ranges, counts tell in which range a rank lies, and
only that range is looked at again, until it has few rows or one value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

#: Rows of a range that are sorted in one task.
FEW = 100_000
RANGES = 200


def at_ranks(df: DataFrame, ranks: dict[str, list[int]], few: int = FEW) -> dict[str, dict[int, float]]:
    """For each column the values at the ranks (from 0, ascending), nulls and NaN left out."""
    cells = None
    for c in ranks:
        v = F.col(f"`{c}`").cast("double")
        some = df.select(F.lit(c).alias("name"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
        cells = some if cells is None else cells.unionByName(some)
    found: dict[str, dict[int, float]] = {c: {} for c in ranks}
    # (column, ranks, rows before the range, lower end, upper end), both ends inside
    open_ranges = [(c, sorted(set(k)), 0, -math.inf, math.inf) for c, k in ranks.items() if k]
    while open_ranges:
        inside = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (c, _, _, lo, hi) in enumerate(open_ranges)])
        tagged = cells.select("v", F.inline(F.filter(inside, lambda r: (r["c"] == F.col("name")) & F.col("v").between(r["lo"], r["hi"])))).select("i", "v")
        facts = tagged.groupBy("i").agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10_000).alias("cuts")
        ).collect()  # a row for each range looked at
        small, large = [], []
        for r in facts:
            c, wanted, before, _, _ = open_ranges[r["i"]]
            if r["lo"] == r["hi"]:
                found[c].update(dict.fromkeys(wanted, r["lo"]))
            elif r["n"] <= few:
                small.append((c, wanted, before, r["lo"], r["hi"], r["i"]))
            else:
                large.append((c, wanted, before, sorted({r["lo"], *r["cuts"], r["hi"]}), r["i"]))
        if small:
            places = F.create_map(*[x for _, wanted, before, _, _, i in small for x in (F.lit(i), F.array(*[F.lit(k - before) for k in wanted]))])
            picked = tagged.where(F.col("i").isin([x[-1] for x in small])).groupBy("i").agg(F.sort_array(F.collect_list("v")).alias("s"))  # at most ``few`` values
            for r in picked.select("i", F.transform(F.element_at(places, F.col("i")), lambda k: F.get("s", k)).alias("at")).collect():
                c, wanted, *_ = open_ranges[r["i"]]
                found[c].update(zip(wanted, r["at"], strict=True))
        open_ranges = _narrowed(tagged, large, open_ranges) if large else []
    return found


def _narrowed(tagged: DataFrame, large: list[tuple], before_ranges: list[tuple]) -> list[tuple]:
    """The ranges, and single values, in which the ranks lie."""
    ends = F.create_map(*[x for _, _, _, cuts, i in large for x in (F.lit(i), F.array(*[F.lit(float(e)) for e in cuts]))])
    # twice the number of cuts at or below a value, one less where it is a cut itself
    cuts = F.element_at(ends, F.col("i"))
    place = 2 * F.size(F.filter(cuts, lambda e: e <= F.col("v"))) - F.array_contains(cuts, F.col("v")).cast("int")
    counted = tagged.where(F.col("i").isin([x[-1] for x in large])).groupBy("i", place.alias("p")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # two rows for each cut
    out = []
    for c, wanted, before, _, i in large:
        rows = sorted((r for r in counted if r["i"] == i), key=lambda r: r["p"])
        for r in rows:
            own = [k for k in wanted if before <= k < before + r["n"]]
            if own:
                out.append((c, own, before, r["lo"], r["hi"]))
            before += r["n"]
    return out


def counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def quantiles(df: DataFrame, columns: list[str], shares: list[float], few: int = FEW) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, straight lines between neighbours; None for a column without values."""
    n = counts(df, columns)
    ends = {c: [(p * (n[c] - 1)) for p in shares] for c in columns if n[c]}
    found = at_ranks(df, {c: [k for e in es for k in (math.floor(e), math.ceil(e))] for c, es in ends.items()}, few)

    def between(c: str, e: float) -> float:
        a, b = found[c][math.floor(e)], found[c][math.ceil(e)]
        return a + (b - a) * (e - math.floor(e))

    return {c: [between(c, e) for e in ends[c]] if c in ends else [None] * len(shares) for c in columns}


def median(df: DataFrame, column: str) -> float | None:
    return quantiles(df, [column], [0.5])[column][0]


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their number from 0 in the order of some columns; ties in no fixed order.

    Rows are sorted by ranges and written to the shared folder once, since the ranges of two jobs differ. A number is
    the rows of the ranges before, one row a range, and the place inside.
    """
    path = shared.folder(df.sparkSession, "numbered")
    placed = F.monotonically_increasing_id()  # the range in the upper bits, the place in the lower 33
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", placed).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_place", 33))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = sizes.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(before), "_range").withColumn(name, number).drop("_place", "_range", "_start")
