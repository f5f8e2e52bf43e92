"""Column profiles, quality scores and issue scans, each from one aggregate over all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ranks
from .templates import numeric_columns

PER_AGGREGATE = 40


def _per_column(df: DataFrame, columns: list[str], fields) -> DataFrame:
    """One row per column with the aggregates that ``fields(column)`` names; wide tables in several passes."""
    out = None
    for i in range(0, len(columns), PER_AGGREGATE):
        some = columns[i : i + PER_AGGREGATE]
        row = df.agg(*[F.struct(F.lit(c).alias("name"), *[v.alias(k) for k, v in fields(c).items()]).alias(f"s{j}") for j, c in enumerate(some)])
        rows = row.select(F.inline(F.array(*[f"s{j}" for j in range(len(some))])))
        out = rows if out is None else out.unionByName(rows)
    return out


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """name, unique_values: values of each column are combined before they are sent, in rows of one value."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v")) for c in names])).alias("x")).select("x.*")
    return cells.where("v IS NOT NULL").distinct().groupBy("name").agg(F.count("*").alias("unique_values"))


def columns(df: DataFrame, names: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """total, nulls, distinct, shares, nullable (over 5 % null), primary-key candidate, categorical."""
    names = names or df.columns
    if approximate:
        raw = _per_column(df, names, lambda c: {"total": F.count("*"), "non_nulls": F.count(c), "unique_values": F.approx_count_distinct(c)})
    else:
        raw = _per_column(df, names, lambda c: {"total": F.count("*"), "non_nulls": F.count(c)})
        raw = raw.join(distinct_counts(df, names), "name", "left").na.fill(0, ["unique_values"])
    share = lambda a, b: F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))
    nulls = F.col("total") - F.col("non_nulls")
    return raw.select(
        "name", "total", nulls.alias("nulls"), "non_nulls", "unique_values", share(nulls, F.col("total")).alias("null_percent"),
        share(F.col("unique_values"), F.col("non_nulls")).alias("unique_percent"), (share(nulls, F.col("total")) > 5).alias("nullable"),
        ((F.col("unique_values") == F.col("total")) & (nulls == 0) & (F.col("total") > 0)).alias("primary_key_candidate"),
        ((F.col("unique_values") <= 20) & (F.col("unique_values") < F.col("non_nulls"))).alias("categorical"),
    )


def numbers(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    def fields(c: str) -> dict[str, Column]:
        v = F.col(c).cast("double")
        return {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_samp(v), "is_integer": F.bool_and(v == F.floor(v)), "has_decimals": F.bool_or(v != F.floor(v))}

    names = names or numeric_columns(df)
    if not names:
        return _per_column(df, names, fields)
    middle = ranks.quantiles(df, names, [0.5])
    known = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(middle[c][0]).cast("double"))])
    return _per_column(df, names, fields).withColumn("median", known[F.col("name")])


def nullability(df: DataFrame, names: list[str]) -> DataFrame:
    """name and nullable of each column, as ``columns`` has it, without counting distinct values."""
    raw = _per_column(df, names, lambda c: {"total": F.count("*"), "non_nulls": F.count(c)})
    return raw.select("name", (F.coalesce(F.try_divide((F.col("total") - F.col("non_nulls")) * 100.0, "total"), F.lit(0.0)) > 5).alias("nullable"))


# Shapes of text that are reported.
SHAPES = {
    "code": r"^[A-Z]{2,3}\d{3,6}$", "ssn": r"^\d{3}-\d{2}-\d{4}$", "phone": r"^\d{3}-\d{3}-\d{4}$",
    "email": r"^[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}$", "zip": r"^\d{5}(-\d{4})?$", "full_name": r"^[A-Z][a-z]+ [A-Z][a-z]+$",
}


def texts(df: DataFrame, names: list[str]) -> DataFrame:
    def fields(c: str) -> dict[str, Column]:
        t = F.col(c).cast("string")
        cased = F.upper(t) != F.lower(t)
        shapes = F.array_compact(F.array(*[F.when(F.avg(t.rlike(p).cast("double")) >= 0.5, F.lit(k)) for k, p in SHAPES.items()]))
        return {
            "min_length": F.min(F.length(t).cast("long")), "max_length": F.max(F.length(t).cast("long")), "avg_length": F.avg(F.length(t)), "special": F.bool_or(t.rlike(r"[^a-zA-Z0-9\s]")),
            "all_upper": F.bool_and(cased & (t == F.upper(t))), "all_lower": F.bool_and(cased & (t == F.lower(t))), "shapes": F.array_join(shapes, ","),
        }

    return _per_column(df, names, fields)


def dates(df: DataFrame, names: list[str]) -> DataFrame:
    def fields(c: str) -> dict[str, Column]:
        ts = F.col(c).cast("timestamp")
        return {"first": F.min(ts), "last": F.max(ts), "range_days": F.datediff(F.max(ts), F.min(ts)).cast("long"), "has_time": F.bool_or(F.date_trunc("day", ts) != ts)}

    return _per_column(df, names, fields)


#: Formats of date texts with their shapes, in the order in which they win ties.
DATE_FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"), ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("MM-dd-yyyy", r"^\d{2}-\d{2}-\d{4}$"), ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"), ("dd.MM.yyyy", r"^\d{2}\.\d{2}\.\d{4}$"), ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
)


def text_dates(df: DataFrame, names: list[str]) -> DataFrame:
    """name, format, first, last, range_days, unread and mixed of columns of date texts.

    Every value votes for the formats that read it, and the format of most votes reads the column: where days over 12
    occur they settle whether days or months come first. ``unread`` is the share that it does not read, and
    ``mixed`` says whether another format reads some of those. Equal values are read once. A column without a date has no row.
    """
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.col(f"`{c}`").cast("string")).alias("v")) for c in names]))).where("v <> ''")
    distinct = cells.groupBy("name", "v").agg(F.count("*").alias("n"))
    read = [F.when(F.col("v").rlike(shape), F.try_to_timestamp("v", F.lit(fmt))).cast("date") for fmt, shape in DATE_FORMATS]
    voted = distinct.select("name", "n", *[r.alias(f"d{i}") for i, r in enumerate(read)])
    mask = sum((F.when(F.col(f"d{i}").isNotNull(), 1 << i).otherwise(0) for i in range(len(read))), F.lit(0)).alias("mask")
    ends = [f(f"d{i}").alias(f"{e}{i}") for i in range(len(read)) for e, f in (("lo", F.min), ("hi", F.max))]
    kinds = voted.select("name", "n", mask, *[f"d{i}" for i in range(len(read))]).groupBy("name", "mask").agg(F.sum("n").alias("n"), *ends)  # a row for each set of formats
    whole = [x for i in range(len(read)) for x in (F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(f"n{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"))]
    facts = kinds.groupBy("name").agg(F.sum("n").alias("total"), F.collect_list("mask").alias("masks"), *whole)
    votes = F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("place"), F.lit(fmt).alias("format"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, (fmt, _) in enumerate(DATE_FORMATS)])
    best = facts.withColumn("best", F.array_max(votes)).where("best.n > 0")
    own = F.pow(F.lit(2.0), -F.col("best.place")).cast("int")
    return best.select(
        "name", "best.format", F.col("best.lo").alias("first"), F.col("best.hi").alias("last"), F.datediff("best.hi", "best.lo").cast("long").alias("range_days"),
        (1 - F.col("best.n") / F.col("total")).alias("unread"), F.exists("masks", lambda m: (m != 0) & (m.bitwiseAND(own) == 0)).alias("mixed"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    """missing, missing_percent and over_half of each column."""
    raw = _per_column(df, df.columns, lambda c: {"total": F.count("*"), "missing": F.count("*") - F.count(c)})
    share = F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("total")), F.lit(0.0))
    return raw.select("name", "total", "missing", share.alias("missing_percent"), (share > 50).alias("over_half"))


def quality_scores(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """completeness, validity, consistency and uniqueness of each column of a semantic type."""

    def fields(c: str) -> dict[str, Column]:
        t = F.trim(F.col(c).cast("string"))
        valid = {
            "NUMBER": S.number_from_text(t).isNotNull(), "DATE": S.parse_date(t).isNotNull(), "BOOLEAN": S.parse_boolean(t).isNotNull(),
            "CURRENCY": S.parse_currency(t).isNotNull(), "PERCENTAGE": S.parse_percentage(t).isNotNull(), "TEXT": F.length(t) > 0,
        }[kinds[c]]
        lengths = 1 - F.try_divide(F.countDistinct(F.length(t)), F.least(F.lit(10), F.count(t)))
        return {
            "completeness": F.coalesce(F.try_divide(F.count(c), F.count("*")), F.lit(0.0)), "validity": F.coalesce(F.avg(F.when(t.isNotNull(), valid.cast("double"))), F.lit(0.0)),
            "consistency": F.coalesce(lengths if kinds[c] == "TEXT" else F.avg(F.when(t.isNotNull(), valid.cast("double"))), F.lit(0.0)),
            "uniqueness": F.coalesce(F.try_divide(F.countDistinct(c), F.count("*")), F.lit(0.0)),
        }

    return _per_column(df, list(kinds), fields)


def issues(df: DataFrame) -> DataFrame:
    """Counts per column: empty cells, numbers kept as text, edge spaces, recognition artefacts."""

    def fields(c: str) -> dict[str, Column]:
        t = F.col(c).cast("string")
        return {
            "empty": F.count_if(t.isNull() | (F.trim(t) == "")), "numeric_text": F.count_if(S.plain_double(F.regexp_replace(t, "[$,%]", "")).isNotNull()),
            "edge_spaces": F.count_if(t != F.trim(t)), "artefacts": F.count_if(t.rlike(r"[|\\]")),
        }

    return _per_column(df, df.columns, fields)


def validation_findings(df: DataFrame) -> DataFrame:
    """finding and column: constant, all unique, missing values; and the number of repeated rows."""
    p = columns(df)
    found = F.array_compact(F.array(
        F.when(F.col("unique_values") <= 1, F.lit("constant")), F.when((F.col("unique_values") == F.col("total")) & (F.col("total") > 1), F.lit("all_unique")), F.when(F.col("nulls") > 0, F.lit("missing")),
    ))
    repeated = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum("count") - F.count("*"), F.lit(0)).alias("n"))
    return p.select(F.explode(found).alias("finding"), F.col("name").alias("column"), F.col("nulls").alias("n")).unionByName(
        repeated.where("n > 0").select(F.lit("duplicate_rows").alias("finding"), F.lit(None).cast("string").alias("column"), "n")
    )


def top_values(df: DataFrame, names: list[str], n: int = 10) -> DataFrame:
    """The n most frequent values of each column."""
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "name", "value").where("value IS NOT NULL")
    counts = cells.groupBy("name", "value").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("count"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def filter_definitions(df: DataFrame, most: int = 50) -> DataFrame:
    """The widget for each column: select, range, date_range or search; none for useless columns."""
    kinds = dict(df.dtypes)
    p = columns(df)
    numeric, temporal = numeric_columns(df), [c for c, t in kinds.items() if t in ("date", "timestamp", "timestamp_ntz")]
    name = F.col("name")
    widget = (
        F.when((F.col("null_percent") > 80), None)
        .when(name.isin(numeric), F.when(F.col("unique_values") <= 10, "select").otherwise("range"))
        .when(name.isin(temporal), "date_range").when(F.col("unique_values") <= 20, "select").when(F.col("unique_values") <= most, "search")
    )
    return p.select("name", widget.alias("widget"), "unique_values").where("widget IS NOT NULL")
