"""Schema descriptors as rows: validation, diff, compatibility, drift, versions and ancestry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import profile
from .types import profile_type


def describe(df: DataFrame, names: list[str] | None = None, samples: int = 5, order: str | None = None) -> DataFrame:
    """name, data_type, nullable, unique_values and sample values of each column."""
    names = names or df.columns
    facts = profile.columns(df, names).join(profile_type(df, names), "name")
    rank = F.col(order) if order else F.monotonically_increasing_id()
    cells = df.select(rank.alias("_o"), *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(names)])
    # the first few of each column by the order, equal places by value; no column is sorted for them
    tops = [cells.where(F.col(f"_{i}").isNotNull()).select(F.lit(c).alias("name"), "_o", F.col(f"_{i}").alias("v")).orderBy("_o", "v").limit(samples) for i, c in enumerate(names)]
    first = reduce(DataFrame.unionByName, tops).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "v"))), lambda x: x["v"]).alias("samples"))
    return facts.join(first, "name", "left")


def descriptor(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """name, nullable (over 5 % null) and data_type of each column: what ``diff`` compares."""
    names = names or df.columns
    return profile.nullability(df, names).join(profile_type(df, names), "name")


def validate(profile_rows: DataFrame, total_rows: int) -> DataFrame:
    """severity and problem: repeated or empty names, negative counts, more distinct values than rows."""
    repeated = profile_rows.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select(F.lit("error").alias("severity"), F.concat(F.lit("duplicate column: "), "name").alias("problem"))
    found = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.struct(F.lit("error").alias("severity"), F.lit("empty column name").alias("problem"))),
        F.when(F.col("unique_values") < 0, F.struct(F.lit("error").alias("severity"), F.concat(F.lit("negative count: "), "name").alias("problem"))),
        F.when(F.col("unique_values") > total_rows, F.struct(F.lit("warning").alias("severity"), F.concat(F.lit("more values than rows: "), "name").alias("problem"))),
    ))
    return profile_rows.select(F.inline(found)).unionByName(repeated)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change and severity of every column that was added, removed, retyped or became (not) nullable."""
    o = old.select(F.col("name"), F.col("data_type").alias("old_type"), F.col("nullable").alias("old_nullable"))
    n = new.select(F.col("name"), F.col("data_type").alias("new_type"), F.col("nullable").alias("new_nullable"))
    both = o.join(n, "name", "full_outer")

    def change(test: Column, kind: str, severity: Column | str) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("change"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity")))

    retype = F.when((F.col("new_type") == "TEXT") | (F.col("old_type") == "TEXT"), "major").otherwise("minor")
    found = F.array_compact(F.array(
        change(F.col("old_type").isNull(), "ADDED", "minor"), change(F.col("new_type").isNull(), "REMOVED", "major"),
        change(F.col("old_type") != F.col("new_type"), "TYPE_CHANGED", retype),
        change(F.col("old_nullable") != F.col("new_nullable"), "NULLABLE_CHANGED", F.when(F.col("new_nullable"), "minor").otherwise("major")),
    ))
    return both.select("name", F.inline(found))


def compatibility(changes: DataFrame) -> DataFrame:
    """One row: level, number of changes, of major and of breaking ones, with what to do.

    identical without changes, incompatible with a breaking one, major or minor by the worst severity,
    compatible if none of them is more than that.
    """
    count = lambda s: F.count_if(F.col("severity") == s)
    row = changes.agg(F.count("*").alias("changes"), count("breaking").alias("breaking"), count("major").alias("major"), count("minor").alias("minor"))
    level = F.when(F.col("changes") == 0, "identical").when(F.col("breaking") > 0, "incompatible").when(F.col("major") > 0, "major").when(F.col("minor") > 0, "minor").otherwise("compatible")
    advice = F.when(F.col("changes") == 0, "none").when(F.col("breaking") + F.col("major") == 0, "add columns with defaults").otherwise("migrate data")
    return row.select(level.alias("level"), "changes", "major", "breaking", advice.alias("strategy"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change in null share and in distinct values of every common column."""
    o, n = profile.columns(old), profile.columns(new)
    return o.select("name", F.col("null_percent").alias("a"), F.col("unique_values").alias("b"), F.col("total").alias("t")).join(
        n.select("name", F.col("null_percent").alias("c"), F.col("unique_values").alias("d"), F.col("total").alias("u")), "name"
    ).select("name", (F.col("c") - F.col("a")).alias("null_percent_change"), (F.col("d") - F.col("b")).alias("unique_change"), (F.col("u") - F.col("t")).alias("row_change"))


def versions(rows: DataFrame, table: str = "table_name", version: str = "version") -> DataFrame:
    """Every version with the one that follows it; the last is active."""
    following = F.lead(version).over(Window.partitionBy(table).orderBy(version))
    return rows.withColumn("next_version", following).withColumn("active", F.col("next_version").isNull())


def ancestry(rows: DataFrame, version: str) -> DataFrame:
    """version, depth: the chain of parents of ``version``, itself first, until none is left or new."""
    chain, seen, want, depth = [], set(), [version], 0
    while want:
        found = rows.where(F.col("version").isin(want)).select("version", "parent_version").collect()  # the rows of one step
        chain += [(r["version"], depth) for r in found]
        seen.update(want)
        want = sorted({r["parent_version"] for r in found if r["parent_version"] is not None} - seen)
        depth += 1
    return rows.sparkSession.createDataFrame(chain, f"version {rows.schema['version'].dataType.simpleString()}, depth int")


def digest(profile_rows: DataFrame) -> DataFrame:
    """SHA-256 of the names, types and nullability in the order of the names: one row."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "name", "data_type", F.col("nullable").cast("string"))))
    return profile_rows.agg(F.sha2(F.array_join(parts, "|"), 256).alias("hash"))


def prompt_rows(profile_rows: DataFrame) -> DataFrame:
    """A description and a suggested question for each column."""
    kind = F.col("data_type")
    about = F.concat("name", F.lit(": "), F.lower(kind), F.when(F.col("nullable"), ", may be missing").otherwise(""), F.when(F.col("primary_key_candidate"), ", identifies rows").otherwise(""))
    ask = F.when(kind.isin("NUMBER", "CURRENCY", "PERCENTAGE"), F.concat(F.lit("What is the total of "), "name", F.lit("?"))).when(kind == "DATE", F.concat(F.lit("How do records change over "), "name", F.lit("?")))
    return profile_rows.select("name", about.alias("description"), ask.otherwise(F.concat(F.lit("How are records spread over "), "name", F.lit("?"))).alias("question"))
