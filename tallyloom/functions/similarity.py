"""String similarity: edit distance on the JVM, sequence matching in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks; not symmetric, the earlier text comes first."""
    return F.pandas_udf(_ratios, "double")(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(1.0))


def similarity(a: Column, b: Column) -> Column:
    """The larger of both measures; edit distance only for texts of at most 50 characters."""
    short = (F.length(a) <= 50) & (F.length(b) <= 50)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(sequence_ratio(a, b), F.when(short, edit_similarity(a, b)).otherwise(0.0)))
