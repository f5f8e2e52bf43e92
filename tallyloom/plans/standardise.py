"""Raw table to clean table: types, then missing values, then duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, filters, missing, types


def standardise(df: DataFrame, order: str, policies: dict | None = None, fuzzy: float | None = None) -> DataFrame:
    """Typed, filled and without repeated rows; ``order`` is the row number that says which row is first."""
    body = [c for c in df.columns if c != order]
    typed = types.standardise_types(missing.sentinels_to_null(df))
    filled = missing.apply_policies(typed, missing.default_policies(typed) if policies is None else policies)
    unique = dedup.exact(filled, order, body)
    return dedup.fuzzy(unique, order, body, fuzzy) if fuzzy else unique


def auto_clean(df: DataFrame, order: str, share: float = 0.8) -> DataFrame:
    """Empty rows and columns dropped, texts trimmed, repeats removed, columns mostly of numbers converted."""
    body = [c for c in df.columns if c != order]
    kept = filters.drop_empty(df.where(F.coalesce(*[F.col(c).cast("string") for c in body]).isNotNull()))
    strings = [c for c, t in kept.dtypes if t == "string"]
    trimmed = kept.select(*[F.trim(c).alias(c) if c in strings else c for c in kept.columns])
    number = lambda c: F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")
    facts = trimmed.agg(*[F.coalesce(F.try_divide(F.count(number(c)), F.count(c)), F.lit(0.0)).alias(c) for c in strings]).first() if strings else {}
    typed = trimmed.select(*[number(c).alias(c) if c in strings and facts[c] > share else c for c in trimmed.columns])
    return dedup.exact(typed, order, [c for c in typed.columns if c != order])
