"""What a model's answer holds: titled sections, suggestions, diagnosis fields, explaining sentences, and how sure they are.

Everything is a projection with built-in functions; only sections of one title, of which the last counts, are grouped.
A null answer holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How sections, suggestions and fields of a diagnosis are written, and words that tell what a part is.
NUMBERED_SECTION = r"\d+\.\s*([^:\n]+):\s*([^\n]+)"
BULLET_SECTION = r"[-*]\s*([^:]+):\s*([^\n]+(?:\n(?![-*])[^\n]*)*)"
NUMBERED = r"\d+\.\s*([^\n]+)"
BULLET = r"[-*]\s*([^\n]+(?:\n(?![-*])[^\n]*)*)"
FIELDS = (
    ("cause", r"(?i)(?:cause|reason|problem):\s*([^\n]+(?:\n(?!(?:fix|solution|prevent))[^\n]*)*)"),
    ("solution", r"(?i)(?:fix|solution|resolve):\s*([^\n]+(?:\n(?!(?:cause|prevent))[^\n]*)*)"),
    ("prevention", r"(?i)(?:prevent|avoid|tips?):\s*([^\n]+(?:\n(?!(?:cause|fix))[^\n]*)*)"),
)
ANALYSIS_WORDS = ("insights", "analysis", "findings", "patterns", "trends", "recommendations", "conclusions", "observations")
EXPLAINING_WORDS = ("explanation", "because", "due to", "this means", "in other words", "specifically", "for example", "this shows")
ACTION_WORDS = ("analyze", "investigate", "compare", "review", "examine", "calculate", "measure", "track", "monitor", "implement")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _titled(text: Column, pattern: str) -> Column:
    return F.transform(F.arrays_zip(_all(text, pattern, 1).alias("title"), _all(text, pattern, 2).alias("content")), lambda x: F.struct(_trimmed(x["title"]).alias("title"), _trimmed(x["content"]).alias("content")))


def _section_list(text: Column) -> Column:
    """(title, content) of numbered sections, else of bullets, else of paragraphs that speak of an analysis."""
    filled = F.filter(F.transform(F.split(text, "\n\n"), _trimmed), lambda p: p != "")
    numbered = F.transform(filled, lambda p, i: F.struct(F.concat(F.lit("Analysis "), (i + 1).cast("string")).alias("title"), p.alias("content")))
    telling = F.filter(numbered, lambda p: _any(F.lower(p["content"]), ANALYSIS_WORDS))
    first, second = _titled(text, NUMBERED_SECTION), _titled(text, BULLET_SECTION)
    return F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(telling)


def sections(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, place, title and content of each section; of one title the first place and the last content."""
    rows = answers.where(F.col(text).isNotNull()).select(key, F.posexplode(_section_list(F.col(text))).alias("place", "s"))
    return rows.groupBy(key, F.col("s.title").alias("title")).agg(F.min("place").alias("place"), F.max_by(F.col("s.content"), "place").alias("content")).select(key, "place", "title", "content")


def _suggestion_list(text: Column) -> Column:
    numbered = _all(text, NUMBERED)
    return F.transform(F.when(F.size(numbered) > 0, numbered).otherwise(_all(text, BULLET)), _trimmed)


def suggestions(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, place, suggestion and actionable of numbered suggestions, else of bullets."""
    rows = answers.where(F.col(text).isNotNull()).select(key, F.posexplode(_suggestion_list(F.col(text))).alias("place", "suggestion"))
    return rows.withColumn("actionable", _any(F.lower("suggestion"), ACTION_WORDS))


def _field(text: Column, pattern: str) -> Column:
    return F.nullif(_trimmed(F.regexp_extract(text, pattern, 1)), F.lit(""))


def diagnosis(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, cause, solution, prevention (null where an answer has none) and confidence."""
    rows = answers.select(key, *[_field(F.col(text), p).alias(n) for n, p in FIELDS])
    worth = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, w in (("cause", 0.3), ("solution", 0.4), ("prevention", 0.1))), F.lit(0.2))
    return rows.withColumn("confidence", F.least(F.lit(1.0), worth))


def _explaining(text: Column) -> Column:
    sentences = F.transform(F.split(text, "[.!?]+"), _trimmed)
    return F.filter(sentences, lambda s: (F.length(s) > 10) & _any(F.lower(s), EXPLAINING_WORDS))


def explanations(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, place and sentence of the sentences that explain."""
    return answers.where(F.col(text).isNotNull()).select(key, F.posexplode(_explaining(F.col(text))).alias("place", "sentence"))


def clarity(text: Column) -> Column:
    """0.8, 0.6 or 0.4 by the mean length of what stands between full stops, in words."""
    pieces = F.split(text, "[.!?]+")
    words = F.aggregate(pieces, F.lit(0), lambda n, s: n + F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    mean = words / F.size(pieces)
    return F.when(mean.between(10, 25), 0.8).when(mean.between(5, 35), 0.6).otherwise(0.4)


def judged(answers: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each answer: what it holds, and its confidence as an analysis, explanation, suggestion and diagnosis."""
    t = F.col(text)
    low = F.lower(t)
    facts = answers.where(t.isNotNull()).select(
        key, F.size(F.array_distinct(F.transform(_section_list(t), lambda s: s["title"]))).alias("sections"), F.size(_suggestion_list(t)).alias("suggestions"),
        F.size(F.filter(_suggestion_list(t), lambda s: _any(F.lower(s), ACTION_WORDS))).alias("actionable"), F.size(_explaining(t)).alias("explaining"),
        F.exists(_explaining(t), lambda s: _any(F.lower(s), ("because", "due to"))).alias("has_reasoning"), F.exists(_explaining(t), lambda s: _any(F.lower(s), ("example", "for instance"))).alias("has_examples"),
        low.contains("insight").alias("has_insights"), low.contains("recommend").alias("has_recommendations"), t.rlike(r"\d").alias("has_numbers"), clarity(t).alias("clarity"),
        *[_field(t, p).isNotNull().alias(f"has_{n}") for n, p in FIELDS],
    )
    gain = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    analysis = 0.3 + F.when(F.col("sections") > 0, 0.3).otherwise(0.0) + gain("has_insights", 0.2) + gain("has_recommendations", 0.2) + gain("has_numbers", 0.1)
    return facts.select(
        "*", F.least(F.lit(1.0), analysis).alias("analysis_confidence"), F.least(F.lit(0.9), F.col("explaining") * 0.2 + 0.3).alias("explanation_confidence"),
        F.least(F.lit(0.9), F.col("suggestions") * 0.15 + 0.4).alias("suggestion_confidence"),
        F.least(F.lit(1.0), 0.2 + gain("has_cause", 0.3) + gain("has_solution", 0.4) + gain("has_prevention", 0.1)).alias("diagnosis_confidence"),
    )
