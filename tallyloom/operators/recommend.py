"""Which charts suit a table: roles of the columns, patterns, weighted scores and configurations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import charts, profile
from .templates import numeric_columns
from .types import detect

# Words in a column's name that make it temporal, and what a pattern weighs for each chart.
TEMPORAL_WORDS = ("date", "time", "timestamp", "year", "month", "day")
CHART_WEIGHTS = {
    "bar": {"categorical": 0.9, "categorical_numerical": 0.8, "distribution": 0.6},
    "line": {"time_series": 0.9, "numerical_numerical": 0.7, "correlation": 0.6},
    "pie": {"categorical": 0.7, "distribution": 0.8},
    "scatter": {"numerical_numerical": 0.9, "correlation": 0.8},
    "histogram": {"distribution": 0.9, "numerical": 0.8},
    "heatmap": {"correlation": 0.9, "categorical_numerical": 0.6},
}
_TEMPORAL_TYPES = ("date", "timestamp", "timestamp_ntz")


def column_roles(df: DataFrame) -> DataFrame:
    """name, place, kind, unique_values, nulls, cardinality, and whether a column is categorical, numerical or temporal.

    Texts count as dates or numbers if all their values read so; numbers are categories with at most ten
    values over at most half the rows, dates never, and other columns always.
    """
    kinds = dict(df.dtypes)
    texts = [c for c in df.columns if kinds[c] == "string"]
    facts = profile.columns(df).select("name", "unique_values", "nulls", "total")
    declared = {c: "number" if c in numeric_columns(df) else "date" if kinds[c] in _TEMPORAL_TYPES else "boolean" if kinds[c] == "boolean" else "text" for c in df.columns}
    known = F.create_map(*[F.lit(x) for kv in declared.items() for x in kv])
    place = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    if texts:
        read = detect(df, texts).select("name", F.when(F.col("data_type") == "DATE", "date").when(F.col("data_type") == "NUMBER", "number").alias("reads_as"))
        facts = facts.join(read, "name", "left")
    else:
        facts = facts.withColumn("reads_as", F.lit(None).cast("string"))
    rows = facts.withColumn("kind", F.coalesce("reads_as", known[F.col("name")])).withColumn("place", place[F.col("name")])
    share = F.coalesce(F.try_divide(F.col("unique_values").cast("double"), F.col("total")), F.lit(0.0))
    category = F.when(F.col("kind") == "number", (F.col("unique_values") <= 10) & (share <= 0.5)).otherwise(F.col("kind") != "date")
    temporal = F.lit(False)
    for w in TEMPORAL_WORDS:
        temporal = temporal | F.lower("name").contains(w)
    return rows.select(
        "name", "place", "kind", "unique_values", "nulls", share.alias("cardinality"), category.alias("categorical"), (F.col("kind") == "number").alias("numerical"), ((F.col("kind") == "date") | temporal).alias("temporal")
    )


def recommendations(roles: DataFrame, most: int = 5) -> DataFrame:
    """chart, score and place of the charts that suit columns of these roles, best first."""
    n = roles.agg(
        F.count_if("categorical").alias("c"), F.count_if("numerical").alias("n"), F.count_if("temporal").alias("t"),
        F.count_if(F.col("categorical") & (F.col("unique_values") <= 8)).alias("few"), F.count_if(F.col("categorical") & (F.col("unique_values") > 10)).alias("many"),
    )  # one row
    shown = {
        "time_series": (F.col("t") > 0) & (F.col("n") > 0), "categorical": F.col("c") > 0, "numerical": F.col("n") > 0, "categorical_numerical": (F.col("c") > 0) & (F.col("n") > 0),
        "numerical_numerical": F.col("n") >= 2, "correlation": F.col("n") >= 2, "distribution": (F.col("n") == 1) & (F.col("c") == 0),
    }
    raised = {
        "line": F.when(shown["time_series"], 1.5).otherwise(1.0), "pie": F.pow(F.lit(1.2), F.col("few")) * F.pow(F.lit(0.5), F.col("many")),
        "histogram": F.when(shown["distribution"], 1.3).otherwise(1.0), "scatter": F.when(F.col("n") >= 2, 1.2).otherwise(1.0),
    }
    rated = []
    for i, (chart, weights) in enumerate(CHART_WEIGHTS.items()):
        total = sum((F.when(shown[p], w).otherwise(0.0) for p, w in weights.items()), F.lit(0.0))
        hits = sum((shown[p].cast("int") for p in weights), F.lit(0))
        rated.append(F.struct((F.try_divide(total, hits) * raised.get(chart, F.lit(1.0))).alias("score"), F.lit(-i).alias("order"), F.lit(chart).alias("chart")))
    best = F.slice(F.sort_array(F.filter(F.array(*rated), lambda r: r["score"].isNotNull()), asc=False), 1, most)
    return n.select(F.posexplode(best).alias("place", "r")).select((F.col("place") + 1).alias("place"), "r.chart", "r.score")


@dataclass(frozen=True)
class ChartConfig:
    """What to draw: columns, aggregation and colour."""

    chart: str
    x: str
    y: str | None = None
    colour: str | None = None
    aggregation: str = "count"


def configuration(chart: str, categorical: list[str], numerical: list[str], temporal: list[str]) -> ChartConfig:
    """The columns for a chart, from those of each role in the order of the table; a table where none fits."""
    first = lambda *groups: next((c for g in groups for c in g), None)
    label, number = first(categorical, numerical), first(numerical)
    if chart == "bar" and label:
        return ChartConfig(chart, label, number, aggregation="sum" if number else "count")
    if chart == "line" and first(temporal, numerical):
        return ChartConfig(chart, first(temporal, numerical), number, aggregation="avg" if number else "count")
    if chart == "pie" and label:
        return ChartConfig(chart, label)
    if chart == "scatter" and number:
        return ChartConfig(chart, number, numerical[1] if len(numerical) > 1 else number, first(categorical), "none")
    if chart == "histogram" and first(numerical, categorical):
        return ChartConfig(chart, first(numerical, categorical))
    if chart == "heatmap" and label and (len(categorical) > 1 or number):
        return ChartConfig(chart, label, categorical[1] if len(categorical) > 1 else number)
    return ChartConfig("table", first(categorical, numerical, temporal) or "data", aggregation="none")


def configurations(df: DataFrame, most: int = 3) -> list[ChartConfig]:
    """Configurations of the charts that suit a table best."""
    roles = sorted(column_roles(df).collect(), key=lambda r: r["place"])  # a row for each column
    by = {k: [r["name"] for r in roles if r[k]] for k in ("categorical", "numerical", "temporal")}
    best = recommendations(df.sparkSession.createDataFrame(roles, "name string, place int, kind string, unique_values long, nulls long, cardinality double, categorical boolean, numerical boolean, temporal boolean"), most)
    return [configuration(r["chart"], **by) for r in best.orderBy("place").collect()]


def drawn(df: DataFrame, config: ChartConfig) -> DataFrame:
    """The data behind a configured chart."""
    if config.chart in ("bar", "pie"):
        return charts.bar(df, config.x, config.y, config.aggregation)
    if config.chart == "line" and config.y:
        return charts.bar(df, config.x, config.y, config.aggregation)
    if config.chart == "line":
        return charts.line(df, config.x)
    if config.chart == "scatter":
        return df.select(*dict.fromkeys(c for c in (config.x, config.y, config.colour) if c))
    if config.chart == "histogram":
        return charts.histogram(df, config.x)
    if config.chart == "heatmap":
        return df.groupBy(config.x, config.y).agg(F.count("*").alias("count"))
    return df


def headline(df: DataFrame) -> DataFrame:
    """rows, mean and max of the first numeric column, and quality (100 less the per cent missing): one row."""
    numbers = numeric_columns(df)
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    facts = [F.count("*").alias("rows"), missing.alias("missing")]
    first = F.col(f"`{numbers[0]}`").cast("double") if numbers else F.lit(None).cast("double")
    row = df.agg(*facts, F.avg(first).alias("mean"), F.max(first).alias("most"))
    return row.select("rows", "mean", "most", F.coalesce(100 - F.try_divide(F.col("missing") * 100.0, F.col("rows") * len(df.columns)), F.lit(100.0)).alias("quality"))
