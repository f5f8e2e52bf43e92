"""KPIs: detection by profile, values in one aggregate, trends, comparisons, insights and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .templates import numeric_columns

# Column-name patterns of business measures, and what is reported of each.
BUSINESS = {
    "revenue": (("revenue", "sales", "income", "amount"), ("total", "average")),
    "cost": (("cost", "expense", "spend"), ("total",)),
    "profit": (("profit", "margin", "gain"), ("total",)),
    "quantity": (("quantity", "qty", "count", "units"), ("total",)),
    "price": (("price", "rate"), ("average",)),
    "customer": (("customer", "client", "user"), ("unique",)),
    "order": (("order", "transaction"), ("unique",)),
}


def _rows(df: DataFrame, made: list[tuple[str, str, Column]]) -> DataFrame:
    """(kpi_id, category, value) from expressions evaluated together in one aggregate."""
    if not made:
        return df.sparkSession.createDataFrame([], "kpi_id string, category string, value double")
    last = {k: (category, c) for k, category, c in made}
    row = df.agg(*[c.cast("double").alias(f"k{i}") for i, (_, c) in enumerate(last.values())])
    entries = [F.struct(F.lit(k).alias("kpi_id"), F.lit(category).alias("category"), F.col(f"k{i}").alias("value")) for i, (k, (category, _)) in enumerate(last.items())]
    return row.select(F.inline(F.array(*entries)))


def numeric_kpis(df: DataFrame, columns: list[str]) -> DataFrame:
    """Total (if nothing is negative), average and maximum (if over 5 distinct) of columns not half empty."""
    facts = df.agg(F.count("*").alias("n"), *[f for c in columns for f in (F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.countDistinct(c).alias(f"d_{c}"))]).first()
    made = []
    for c in columns:
        if facts[f"n_{c}"] * 2 < facts["n"] or not facts[f"n_{c}"]:
            continue
        if facts[f"lo_{c}"] >= 0:
            made.append((f"total_{c}", "sum", F.sum(c)))
        made.append((f"avg_{c}", "average", F.avg(c)))
        if facts[f"d_{c}"] > 5:
            made.append((f"max_{c}", "max", F.max(c)))
    return _rows(df, made)


def categorical_kpis(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """Distinct values, and the share of the most frequent one, of columns with few values."""
    distinct = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first()
    out = None
    for c in columns:
        if not 0 < distinct[c] <= most:
            continue
        top = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(1)
        rows = top.select(F.lit(f"top_{c}").alias("kpi_id"), F.col(c).cast("string").alias("label"), F.col("n").cast("double").alias("value")).unionByName(
            df.agg(F.countDistinct(c).cast("double").alias("value")).select(F.lit(f"unique_{c}").alias("kpi_id"), F.lit(None).cast("string").alias("label"), "value")
        )
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else df.sparkSession.createDataFrame([], "kpi_id string, label string, value double")


def time_kpis(df: DataFrame, date: str, days: int = 7) -> DataFrame:
    """Records a day (whole days between first and last), and records of the last ``days``."""
    ends = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"), F.count("*").alias("n"))  # one row
    recent = df.crossJoin(F.broadcast(ends.select("hi"))).where(F.col(date) >= F.col("hi") - F.expr(f"INTERVAL {days} DAYS")).agg(F.count("*").alias("recent"))
    whole = F.greatest(F.lit(1), F.floor((F.unix_micros(F.col("hi").cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))) / 86_400_000_000))
    return ends.crossJoin(recent).select(F.inline(F.array(
        F.struct(F.lit("records_per_day").alias("kpi_id"), (F.col("n") / whole).alias("value")),
        F.struct(F.lit("recent_records").alias("kpi_id"), F.col("recent").cast("double").alias("value")),
    )))


def business_kpis(df: DataFrame) -> DataFrame:
    """Measures recognised by column names; a later column of a kind replaces an earlier one."""
    numbers = set(numeric_columns(df))
    made = []
    for c in df.columns:
        for kind, (words, reports) in BUSINESS.items():
            if any(w in c.lower() for w in words):
                for report in reports:
                    if report == "unique":
                        made.append((f"unique_{kind}", "business", F.countDistinct(c)))
                    elif c in numbers:
                        made.append((f"{report}_{kind}", "business", (F.sum if report == "total" else F.avg)(c)))
    return _rows(df, made)


def quality_kpis(df: DataFrame) -> DataFrame:
    """Completeness %, total records, duplicate rate %."""
    columns = df.columns
    cells = df.agg(F.count("*").alias("n"), sum((F.count(c) for c in columns), F.lit(0)).alias("filled"))
    kinds = df.groupBy(*columns).count().agg(F.count("*").alias("kinds"))  # one row
    return cells.crossJoin(kinds).select(F.inline(F.array(
        F.struct(F.lit("completeness").alias("kpi_id"), F.coalesce(F.try_divide(F.col("filled") * 100.0, F.col("n") * len(columns)), F.lit(0.0)).alias("value")),
        F.struct(F.lit("total_records").alias("kpi_id"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("duplicate_rate").alias("kpi_id"), F.coalesce(F.try_divide((F.col("n") - F.col("kinds")) * 100.0, F.col("n")), F.lit(0.0)).alias("value")),
    )))


def trends(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Change from first to last, volatility, strength and direction of each series."""
    w = Window.partitionBy(*keys).orderBy(order)
    facts = df.withColumn("_i", F.row_number().over(w)).groupBy(*keys).agg(
        F.count("*").alias("points"), F.min_by(value, "_i").alias("first"), F.max_by(value, "_i").alias("last"),
        F.coalesce(F.try_divide(F.stddev_pop(value), F.abs(F.avg(value))), F.lit(0.0)).alias("volatility"),
        F.coalesce(F.abs(F.corr("_i", F.col(value).cast("double"))), F.lit(0.0)).alias("strength"),
    )
    change = F.col("last") - F.col("first")
    percent = F.coalesce(F.try_divide(change * 100.0, F.col("first")), F.lit(0.0))
    short = F.col("points") < 3
    return facts.select(
        *keys, "points", F.when(short, 0.0).otherwise(change).alias("change"), F.when(short, 0.0).otherwise(percent).alias("percent"),
        F.when(short, 0.0).otherwise(F.col("volatility")).alias("volatility"), F.when(short, 0.0).otherwise(F.col("strength")).alias("strength"),
        F.when(short, "STABLE").when(F.col("volatility") > 0.3, "VOLATILE").when(F.abs(percent) < 5, "STABLE").when(percent > 0, "UP").otherwise("DOWN").alias("direction"),
    )


def comparisons(current: DataFrame, base: DataFrame, key: str = "kpi_id", better: str = ">") -> DataFrame:
    """Difference, % difference (0 on a zero base) and improvement of the values that both sides have."""
    joined = current.select(key, F.col("value").alias("current")).join(base.select(key, F.col("value").alias("base")), key)
    diff = F.col("current") - F.col("base")
    return joined.select(
        key, "current", "base", diff.alias("difference"), F.coalesce(F.try_divide(diff * 100.0, F.col("base")), F.lit(0.0)).alias("percent"),
        (diff > 0 if better == ">" else diff >= 0).alias("improved"),
    )


def insights(rows: DataFrame, key: str = "kpi_id") -> DataFrame:
    """One row (insight, severity, confidence) for each rule that fires on a KPI.

    ``rows``: value; percent and improved against the period before; strength and direction of the trend;
    target_percent and target_met against a target. What is null fires nothing.
    """
    strong = F.col("strength") > 0.7
    met = F.col("target_met")
    better = F.when(F.col("improved"), "success").otherwise("warning")
    rules = [
        (strong & (F.col("direction") == "UP"), "upward_trend", F.lit("success"), F.col("strength")), (strong & (F.col("direction") == "DOWN"), "downward_trend", F.lit("warning"), F.col("strength")),
        (F.col("direction") == "VOLATILE", "volatile", F.lit("info"), F.lit(0.8)), (F.col("value") == 0, "zero_value", F.lit("warning"), F.lit(0.9)),
        (met, "target_exceeded", F.lit("success"), F.lit(0.95)), (~met, "target_missed", F.lit("warning"), F.lit(0.95)),
        (F.abs("percent") > 20, "large_change", better, F.lit(0.9)),
    ]
    fired = [F.when(test, F.struct(F.lit(name).alias("insight"), severity.alias("severity"), confidence.cast("double").alias("confidence"))) for test, name, severity, confidence in rules]
    return rows.select(key, F.inline(F.array_compact(F.array(*fired))))


def against_targets(values: DataFrame, targets: DataFrame, key: str = "kpi_id") -> DataFrame:
    """KPIs with target_percent (0 at a target of zero) and target_met (at least the target), null without one."""
    diff = F.col("value") - F.col("target")
    return values.join(targets.select(key, "target"), key, "left").select(
        *values.columns, F.when(F.col("target").isNotNull(), F.coalesce(F.try_divide(diff * 100.0, F.col("target")), F.lit(0.0))).alias("target_percent"), (diff >= 0).alias("target_met")
    )


def gauges(values: DataFrame, targets: DataFrame, key: str = "kpi_id") -> DataFrame:
    """Per cent of the target that is reached, within 0 and 100."""
    share = F.coalesce(F.try_divide(F.col("value") * 100.0, F.col("target")), F.lit(0.0))
    return values.join(targets.select(key, "target"), key).select(key, "value", "target", F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)).alias("progress"))


def summary(values: DataFrame, compared: DataFrame, found: DataFrame) -> DataFrame:
    """One row: KPIs, comparisons, improvements, and insights by severity."""
    by = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("success", "warning", "info")], F.count("*").alias("insights"))
    return values.agg(F.count("*").alias("kpis")).crossJoin(compared.agg(F.count("*").alias("comparisons"), F.count_if("improved").alias("improved"))).crossJoin(by)  # one row each


def custom(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(kpi_id, value) of KPIs of one's own, each an aggregate over the rows; a null aggregate is no KPI."""
    if not measures:
        return df.sparkSession.createDataFrame([], "kpi_id string, value double")
    row = df.agg(*[m.cast("double").alias(f"m{i}") for i, m in enumerate(measures.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kpi_id"), F.col(f"m{i}").alias("value")) for i, k in enumerate(measures)]))).where("value IS NOT NULL")


def alerts(values: DataFrame, thresholds: DataFrame, key: str = "kpi_id") -> DataFrame:
    """critical before warning before normal, from critical_low/high and warning_low/high."""
    v = F.col("value")
    return values.join(thresholds, key, "left").select(
        key, "value",
        F.when((v <= F.col("critical_low")) | (v >= F.col("critical_high")), "critical").when((v <= F.col("warning_low")) | (v >= F.col("warning_high")), "warning").otherwise("normal").alias("status"),
    )


def sparkline(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Values scaled to 0..100 in each series; 50 where all are equal."""
    ends = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(ends, key).select(key, order, F.coalesce(F.try_divide((F.col(value) - F.col("_lo")) * 100.0, F.col("_hi") - F.col("_lo")), F.lit(50.0)).alias("scaled"))


def history(df: DataFrame, key: str, order: str, keep: int = 50) -> DataFrame:
    """The latest ``keep`` values of each KPI."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def point_changes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """% change from the point before: 0 after a zero, null at the start."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return df.select(key, order, value, F.when(before.isNotNull(), F.coalesce(F.try_divide((F.col(value) - before) * 100.0, before), F.lit(0.0))).alias("change_percent"))


def ranked(kpis: DataFrame, scores: dict[str, float], most: int = 10) -> DataFrame:
    """The KPIs of the highest category score, ties by id."""
    table = F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), F.lit(float(v)))])
    return kpis.withColumn("score", F.coalesce(table[F.col("category")], F.lit(0.0))).orderBy(F.desc("score"), "kpi_id").limit(most)


def rolling_trend(df: DataFrame, keys: list[str], order: list[str], value: str, last: int = 10, keep: int = 50) -> DataFrame:
    """Every point of a KPI's history with points (``keep`` at most) and the trend of the latest ``last`` values up to it."""
    upto = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_i", F.row_number().over(upto)).withColumn("_v", F.col(value).cast("double"))
    w = Window.partitionBy(*keys).orderBy("_i").rowsBetween(1 - last, 0)
    change = F.col("_v") - F.first("_v").over(w)
    percent = F.coalesce(F.try_divide(change * 100.0, F.first("_v").over(w)), F.lit(0.0))
    volatility = F.coalesce(F.try_divide(F.stddev_pop("_v").over(w), F.abs(F.avg("_v").over(w))), F.lit(0.0))
    strength = F.coalesce(F.nanvl(F.abs(F.corr(F.col("_i").cast("double"), F.col("_v")).over(w)), F.lit(0.0)), F.lit(0.0))
    facts = numbered.select(*df.columns, "_i", change.alias("change"), percent.alias("percent"), volatility.alias("volatility"), strength.alias("strength"))
    short = F.col("_i") < 3
    zero = lambda c: F.when(short, 0.0).otherwise(F.col(c)).alias(c)
    return facts.select(
        *df.columns, F.least(F.col("_i"), F.lit(keep)).alias("points"), zero("change"), zero("percent"), zero("volatility"), zero("strength"),
        F.when(short, "STABLE").when(F.col("volatility") > 0.3, "VOLATILE").when(F.abs("percent") < 5, "STABLE").when(F.col("percent") > 0, "UP").otherwise("DOWN").alias("direction"),
    )


# What a KPI is worth by its category (3 for others), for a word in its name, and for a common type.
RELEVANCE = {"business": 10, "summary": 8, "time_series": 7, "categorical": 6, "quality": 5}
NAME_BONUS, NAME_WORDS = 5, ("revenue", "profit", "sales", "customer")
TYPE_BONUS, COMMON_TYPES = 3, ("sum", "average", "count")


def relevant(kpis: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` KPIs (kpi_id, category, kpi_type) of the highest score by category, name and type, ties by id."""
    table = F.create_map(*[x for k, v in RELEVANCE.items() for x in (F.lit(k), F.lit(v))])
    named = F.lit(False)
    for word in NAME_WORDS:
        named = named | F.lower("kpi_id").contains(word)
    score = F.coalesce(table[F.col("category")], F.lit(3)) + F.when(named, NAME_BONUS).otherwise(0) + F.when(F.col("kpi_type").isin(*COMMON_TYPES), TYPE_BONUS).otherwise(0)
    return kpis.withColumn("score", score).orderBy(F.desc("score"), "kpi_id").limit(most)
