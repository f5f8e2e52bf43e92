"""A question about a table to a lazy DataFrame, by intent and templates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..operators import templates
from ..operators.text import FAMILIES, FUNCTIONS


def _first(text: str, table, default=None):
    return next((name for name, words in table if any(w in text for w in words)), default)


def answer(df: DataFrame, question: str) -> DataFrame:
    """The template that the question's keywords choose, over the columns that it names."""
    text = question.lower()
    named = [c for c in df.columns if c.lower() in text or c.lower().replace("_", " ") in text]
    kind, function = _first(text, FAMILIES, "DESCRIPTIVE"), _first(text, FUNCTIONS)
    numbers = templates.numeric_columns(df)
    values = [c for c in named if c in numbers] or numbers[:1]
    keys = [c for c in named if c not in numbers] or [c for c, t in df.dtypes if t == "string"][:1]
    times = [c for c, t in df.dtypes if t in ("date", "timestamp", "timestamp_ntz")]
    if kind == "AGGREGATION":
        return templates.aggregate(df, function, values)
    if kind == "COMPARISON" and keys:
        return templates.compare_groups(df, values, keys[0])
    if kind == "TREND" and times:
        return templates.trend(df, times[0], values[0])
    if kind == "DISTRIBUTION" and keys:
        return templates.distribution(df, keys[0])
    if kind == "RANKING":
        number = re.search(r"\d+", text)
        low = any(w in text for w in ("bottom", "worst", "lowest"))
        return templates.rank(df, [*values, *keys], int(number.group()) if number else 10, low)
    return templates.select(df, named or None)
