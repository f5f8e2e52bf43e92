"""Projections, predicates and row or column edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMPARE = {
    "equals": "eq", "is": "eq", "=": "eq", ">": "gt", "greater than": "gt", "<": "lt", "less than": "lt", ">=": "ge", "at least": "ge", "minimum": "ge",
    "<=": "le", "at most": "le", "maximum": "le", "!=": "ne", "contains": "contains", "starts_with": "starts", "ends_with": "ends",
}


def predicate(column: str, operator: str, value) -> Column:
    """One comparison with a typed literal; text operators take the value as it is, without wildcards."""
    kind = _COMPARE.get(operator)
    if kind is None:
        raise ValueError(f"unknown operator {operator!r}")
    c = F.col(column)
    text = c.cast("string")
    return {
        "eq": lambda: c == F.lit(value), "ne": lambda: c != F.lit(value), "gt": lambda: c > F.lit(value), "lt": lambda: c < F.lit(value),
        "ge": lambda: c >= F.lit(value), "le": lambda: c <= F.lit(value), "contains": lambda: text.contains(str(value)),
        "starts": lambda: text.startswith(str(value)), "ends": lambda: text.endswith(str(value)),
    }[kind]()


def where_all(df: DataFrame, filters: list[tuple]) -> DataFrame:
    """Rows that meet every (column, operator, value)."""
    return df.where(reduce(lambda a, b: a & b, [predicate(*f) for f in filters])) if filters else df


def widget_filter(df: DataFrame, kind: str, column: str, value) -> DataFrame:
    """A dashboard filter: select (a list), range (both ends included) or search (regex, any case).

    Columns that do not exist are passed over; missing values never match a search.
    """
    if column not in df.columns:
        return df
    c = F.col(column)
    if kind == "select":
        return df.where(c.isin(list(value))) if value else df
    if kind == "range":
        return df.where(c.between(*value)) if len(value) == 2 else df
    if kind == "search":
        return df.where(c.cast("string").rlike("(?i)" + value)) if value else df
    raise ValueError(f"unknown filter {kind!r}")


def active_filters(df: DataFrame, filters: list[tuple]) -> DataFrame:
    """All filters (kind, column, value), one on top of another."""
    return reduce(lambda d, f: widget_filter(d, *f), filters, df)


def search_everywhere(df: DataFrame, term: str) -> DataFrame:
    """Rows of which any column matches, in any case."""
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string").rlike("(?i)" + term), F.lit(False)) for c in df.columns]))


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows, and then columns, that hold nothing."""
    rows = df.na.drop(how="all")
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns]).first()
    return rows.select(*[c for c in rows.columns if counts[c]])


def promote_header(df: DataFrame, row_id: str, number: int) -> DataFrame:
    """Row ``number`` becomes the header and goes; blanks are ``col_i``, repeats get ``_1``, ``_2``."""
    names = [c for c in df.columns if c != row_id]
    row = df.where(F.col(row_id) == number).select(*names).first()
    seen: dict[str, int] = {}
    fresh = []
    for i, value in enumerate(row):
        name = str(value).strip() if value is not None and str(value).strip() else f"col_{i}"
        seen[name] = seen.get(name, -1) + 1
        fresh.append(f"{name}_{seen[name]}" if seen[name] else name)
    rest = df.where(F.col(row_id) != number)
    return rest.select(row_id, *[F.col(f"`{a}`").alias(b) for a, b in zip(names, fresh, strict=True)])


def preview(df: DataFrame, n: int = 1000) -> DataFrame:
    return df.limit(n)


def page(df: DataFrame, keys: list[str], offset: int, size: int) -> DataFrame:
    return df.orderBy(*keys).offset(offset).limit(size)


def ends(df: DataFrame, key: str) -> DataFrame:
    """First and last row by ``key``, as one row of two structs."""
    row = F.struct(*df.columns)
    return df.agg(F.min_by(row, key).alias("first_row"), F.max_by(row, key).alias("last_row"))


def replace_text(df: DataFrame, column: str, find: str, put: str) -> DataFrame:
    """Literal find and replace."""
    return df.withColumn(column, F.replace(F.col(column), F.lit(find), F.lit(put)))


def replace_matched(df: DataFrame, column: str, pattern: str, put: str, literal: str | None = None) -> DataFrame:
    """In rows whose text holds ``pattern`` every match, or every ``literal``, becomes ``put`` (taken as it is); a flag ``replaced``.

    Nulls stay and are not counted. ``replaced_rows`` counts the flags.
    """
    t = F.col(column).cast("string")
    hit = F.coalesce(t.rlike(pattern), F.lit(False))
    as_is = put.replace("\\", "\\\\").replace("$", "\\$")
    new = F.regexp_replace(t, pattern, as_is) if literal is None else F.replace(t, F.lit(literal), F.lit(put))
    return df.withColumn("replaced", hit).withColumn(column, F.when(F.col("replaced"), new).otherwise(t))


def replaced_rows(df: DataFrame) -> DataFrame:
    """rows and replaced: one row."""
    return df.agg(F.count("*").alias("rows"), F.count_if("replaced").alias("replaced"))


def text_operation(column: str, kind: str) -> Column:
    c = F.col(column)
    return {
        "trim": F.trim(c), "upper": F.upper(c), "lower": F.lower(c), "strip_special": F.regexp_replace(c, r"[^a-zA-Z0-9\s]", ""),
        "to_number": F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double"),
    }[kind]


def query_checks(queries: DataFrame, columns: list[str]) -> DataFrame:
    """Per row of (query_id, sql, used_columns): error and warning flags, valid, confidence.

    Dangerous words count only as words of their own.
    """
    sql = F.upper("sql")
    unknown = F.size(F.array_except(F.coalesce("used_columns", F.array().cast("array<string>")), F.array(*[F.lit(c) for c in columns])))
    danger = sql.rlike(r"\b(DROP|DELETE|TRUNCATE|ALTER|CREATE|INSERT|UPDATE)\b")
    errors = unknown + (~sql.rlike(r"\bSELECT\b")).cast("int") + (~sql.rlike(r"\bFROM\b")).cast("int") + danger.cast("int")
    return queries.select(
        "query_id", unknown.alias("unknown_columns"), danger.alias("dangerous"), errors.alias("n_errors"),
        (sql.contains("SELECT *") & ~sql.contains("LIMIT")).alias("unbounded"), (errors == 0).alias("valid"),
        F.greatest(F.lit(0.0), 1 - 0.2 * errors).alias("confidence"),
    )


#: Cells of the span of row numbers that are numbered apart.
CELLS = 4096


def without_rows(df: DataFrame, number: str, rows: list[int] | DataFrame) -> DataFrame:
    """Without the rows of these numbers (a list, or a frame of one column); the others are numbered anew, in order, from 0."""
    gone = rows if isinstance(rows, DataFrame) else df.sparkSession.createDataFrame([(int(r),) for r in rows], "n long")
    gone = gone.select(F.col(gone.columns[0]).cast("long").alias("_gone"))
    left = df.join(gone, F.col(number).cast("long") == F.col("_gone"), "left_anti")
    return renumbered(left, number)


def renumbered(df: DataFrame, number: str) -> DataFrame:
    """Rows numbered 0, 1, 2 ... in the order of ``number``, a whole number.

    The span of the numbers is cut into CELLS even stretches. A row's stretch follows from its number alone, so
    that the count of the stretches and the numbering inside them, which are jobs of their own, cannot differ. Rows
    without a number come last; equal numbers come in no fixed order, and belong to one stretch.
    """
    low, high = df.agg(F.min(number), F.max(number)).first()
    if low is None:
        low = high = 0
    width = (int(high) - int(low)) // CELLS + 1
    cell = F.coalesce(F.expr(f"(CAST(`{number}` AS BIGINT) - {int(low)}L) DIV {width}L"), F.lit(CELLS + 1).cast("long"))
    placed = df.withColumn("_cell", cell)
    # CELLS + 1 rows at most
    before = placed.groupBy("_cell").agg(F.count("*").alias("_n")).select(
        "_cell", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(number)) - 1
    fresh = (F.col("_before") + F.col("_inside")).cast(df.schema[number].dataType)
    return placed.withColumn("_inside", inside).join(F.broadcast(before), "_cell").withColumn(number, fresh).select(*df.columns)


def with_default_column(df: DataFrame, name: str, value=None) -> DataFrame:
    """A column of one value; an existing name is refused."""
    if name in df.columns:
        raise ValueError(f"there is a column {name}")
    return df.withColumn(name, F.lit(value))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed; unknown ones and names that clash are refused."""
    unknown = [c for c in names if c not in df.columns]
    after = [names.get(c, c) for c in df.columns]
    if unknown or len(set(after)) < len(after):
        raise ValueError(f"unknown columns {unknown}, or names that clash in {after}")
    return df.withColumnsRenamed(names)


def with_row(df: DataFrame, values: dict) -> DataFrame:
    """One more row; columns not named are null."""
    row = df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(row)


def safe_limit(sql: Column, most: int = 1000) -> Column:
    """A limit after statements that take every column and have none."""
    bare = F.regexp_replace(F.trim(sql), r";\s*$", "")
    open_ended = sql.rlike(r"(?is)^\s*SELECT\s+\*") & ~sql.rlike(r"(?i)\bLIMIT\b")
    return F.when(open_ended, F.concat(bare, F.lit(f" LIMIT {most}"))).otherwise(sql)
