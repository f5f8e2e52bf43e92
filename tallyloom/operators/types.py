"""Semantic column types: detection by one aggregate over whole columns, and conversion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Texts that stand for a missing value.
SENTINELS = (
    "", " ", "NULL", "null", "None", "none", "N/A", "n/a", "NA", "na", "NaN", "nan", "-", "--", "---", "?", "unknown", "Unknown", "UNKNOWN", "#N/A", "#NULL!",
)
KINDS = ("BOOLEAN", "CURRENCY", "PERCENTAGE", "DATE", "NUMBER")
# Words of which a column's profile allows two.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "1", "0", "on", "off", "t", "f", "enabled", "disabled")


@dataclass(frozen=True)
class TypeConfig:
    """threshold 1.0: a type must fit every value; below: the best type that fits so many."""

    threshold: float = 1.0
    formats: tuple[str, ...] = S.DATE_FORMATS
    sentinels: tuple[str, ...] = SENTINELS


def present(column: str, sentinels=SENTINELS) -> Column:
    """The trimmed text, null where it is missing."""
    c = F.col(column).cast("string")
    return F.when(~F.trim(c).isin(*[s.strip() for s in sentinels]), F.trim(c))


def tests(text: Column, config: TypeConfig = TypeConfig()) -> dict[str, Column]:
    """Whether a value reads as each type; null for a missing one."""
    made = {
        "BOOLEAN": F.lower(text).isin(*S.TRUE_WORDS, *S.FALSE_WORDS),
        "CURRENCY": text.rlike(r"^-?[$€£¥₹]\s*-?[0-9][0-9,]*(\.[0-9]+)?$"),
        "PERCENTAGE": text.rlike(r"^-?[0-9]+(\.[0-9]+)?\s*%$"),
        "DATE": S.parse_date(text, config.formats).isNotNull(),
        "NUMBER": S.plain_double(F.replace(text, F.lit(","), F.lit(""))).isNotNull(),
    }
    return {k: F.when(text.isNotNull(), test) for k, test in made.items()}


def detect(df: DataFrame, columns: list[str] | None = None, config: TypeConfig = TypeConfig()) -> DataFrame:
    """name, data_type, confidence and non_missing of each column, from one pass over all of it."""
    columns = columns or df.columns
    made = []
    for c in columns:
        text = present(c, config.sentinels)
        made.append(F.struct(F.lit(c).alias("name"), F.count(text).alias("non_missing"), *[F.avg(t.cast("double")).alias(k) for k, t in tests(text, config).items()]).alias(f"s_{c}"))
    rows = df.agg(*made).select(F.inline(F.array(*[f"s_{c}" for c in columns])))
    fit = F.array_max(F.filter(F.array(*[F.struct(F.coalesce(F.col(k), F.lit(0.0)).alias("share"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)]), lambda s: s["share"] >= config.threshold))
    return rows.withColumn("fit", fit).select(
        "name", F.coalesce("fit.kind", F.lit("TEXT")).alias("data_type"), F.coalesce("fit.share", F.lit(1.0)).alias("confidence"), "non_missing"
    )


def converted(column: str, kind: str, config: TypeConfig = TypeConfig()) -> Column:
    """The column as its type; what does not parse becomes null."""
    text = present(column, config.sentinels)
    return {
        "BOOLEAN": lambda: S.parse_boolean(text), "CURRENCY": lambda: S.parse_currency(text), "PERCENTAGE": lambda: S.parse_percentage(text),
        "DATE": lambda: S.parse_date(text, config.formats), "NUMBER": lambda: S.plain_double(F.replace(text, F.lit(","), F.lit(""))), "TEXT": lambda: text,
    }[kind]()


def standardise_types(df: DataFrame, config: TypeConfig = TypeConfig()) -> DataFrame:
    """Every string column converted to the type detected for it."""
    strings = [c for c, t in df.dtypes if t == "string"]
    kinds = {r["name"]: r["data_type"] for r in detect(df, strings, config).collect()} if strings else {}  # a row per column
    return df.select(*[converted(c, kinds[c], config).alias(c) if c in kinds else c for c in df.columns])


def profile_type(df: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """The profile's rule: first type that fits ``least`` of the values; equal-length digit strings are TEXT."""
    made = []
    for c in columns:
        text = F.trim(F.col(c).cast("string"))
        t = tests(text)
        word = F.array_position(F.array(*[F.lit(w) for w in BOOLEAN_WORDS]), F.lower(text)).cast("int")
        words = word > 0
        # how many are told apart matters only where all are words, of which there are few: a bit for each
        kinds = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), word)))
        made.append(F.struct(
            F.lit(c).alias("name"), (F.coalesce(F.bool_and(words), F.lit(False)) & (kinds <= 2)).alias("b"),
            *[F.coalesce(F.avg(t[k].cast("double")), F.lit(0.0)).alias(k) for k in KINDS[1:]],
            (F.coalesce(F.bool_and(text.rlike("^[0-9]{4,}$")), F.lit(False)) & (F.min(F.length(text)) == F.max(F.length(text)))).alias("identifier"),
        ).alias(f"s_{c}"))
    rows = df.agg(*made).select(F.inline(F.array(*[f"s_{c}" for c in columns])))
    kind = F.when(F.col("b"), "BOOLEAN")
    for k in KINDS[1:4]:
        kind = kind.when(F.col(k) >= least, k)
    return rows.select("name", kind.when((F.col("NUMBER") >= least) & ~F.col("identifier"), "NUMBER").otherwise("TEXT").alias("data_type"))


def coerce_numbers(df: DataFrame, least: float = 0.8) -> DataFrame:
    """Text columns of which more than ``least`` of the present values are numbers become numbers; others stay as they are."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    number = {c: S.plain_double(F.replace(present(c), F.lit(","), F.lit(""))) for c in texts}
    row = df.agg(*[F.try_divide(F.count(number[c]), F.count(present(c))).alias(f"s{i}") for i, c in enumerate(texts)]).first()
    chosen = {c for i, c in enumerate(texts) if (row[i] or 0) > least}
    return df.select(*[number[c].alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def quick_numeric(cells: DataFrame, keys: list[str], first: int = 10, least: float = 0.7) -> DataFrame:
    """Columns of which more than ``least`` of the filled cells in the first rows are numbers, by (keys, col_no)."""
    head = cells.where((F.col("row_no") < first) & (F.trim("value") != ""))
    return head.groupBy(*keys, "col_no").agg((F.avg(S.number_from_text(F.col("value")).isNotNull().cast("double")) > least).alias("numeric"))
