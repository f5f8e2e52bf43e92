"""Jobs over columns of text: question intent and features, mentions, filters, SQL blocks, metrics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import answers
from . import mentions as column_names

# Keywords of each aggregation, and keyword families, in the order in which they are tried.
FUNCTIONS = (
    ("SUM", ("sum", "total", "add")), ("COUNT", ("count", "number", "how many")), ("AVG", ("average", "avg", "mean")), ("MIN", ("minimum", "min", "lowest")),
    ("MAX", ("maximum", "max", "highest")), ("MEDIAN", ("median", "middle")), ("STD", ("standard deviation", "std")),
)
FAMILIES = (
    ("AGGREGATION", tuple(w for _, words in FUNCTIONS for w in words)),
    ("COMPARISON", ("compare", "versus", "vs", "against", "difference", "between")),
    ("TREND", ("trend", "over time", "change", "growth", "decline", "pattern")),
    ("FILTERING", ("where", "filter", "show", "only", "exclude", "include")),
    ("RANKING", ("top", "bottom", "best", "worst", "highest", "lowest", "rank")),
    ("DISTRIBUTION", ("distribution", "spread", "breakdown", "proportion", "percentage")),
    ("STATISTICAL", ("describe", "summary", "statistics", "stats")),
)
# Keywords and patterns that weigh for each class of question.
WEIGHTED = (
    ("AGGREGATION", ("sum", "total", "add up", "count", "how many", "number of", "average", "mean", "avg", "minimum", "min", "maximum", "max", "median", "standard deviation", "std"),
     (r"what.*(is|are).*(total|sum|count|average|mean)", r"how many.*", r"calculate.*(sum|total|average|mean)", r"find.*(minimum|maximum|min|max)")),
    ("FILTERING", ("where", "filter", "show", "display", "only", "exclude", "include", "with", "without", "having"),
     (r"show.*where.*", r"filter.*by.*", r"only.*with.*", r"exclude.*", r"records.*where.*")),
    ("COMPARISON", ("compare", "versus", "vs", "against", "difference", "between", "higher", "lower", "better", "worse", "more", "less"),
     (r"compare.*with.*", r".*vs.*", r"difference between.*", r"which.*higher.*", r".*better than.*")),
    ("TREND", ("trend", "over time", "change", "growth", "decline", "increase", "decrease", "pattern", "evolution", "monthly", "yearly", "daily", "weekly"),
     (r".*over time.*", r"trend.*", r"change.*over.*", r"growth.*", r".*monthly.*", r".*yearly.*")),
    ("RANKING", ("top", "bottom", "best", "worst", "highest", "lowest", "rank", "first", "last", "leading", "trailing"),
     (r"top \d+.*", r"bottom \d+.*", r"best.*", r"worst.*", r"highest.*", r"lowest.*")),
    ("DISTRIBUTION", ("distribution", "spread", "breakdown", "proportion", "percentage", "share", "composition", "split"),
     (r"distribution.*", r"breakdown.*", r"what percentage.*", r"proportion.*", r"how.*distributed.*")),
    ("STATISTICAL", ("describe", "summary", "statistics", "stats", "overview", "analysis", "insights", "correlation", "relationship"),
     (r"describe.*", r"summary.*", r"statistics.*", r"correlation.*", r"relationship.*")),
)
# What makes a question simple (-1), harder (+1) or hard (+2), and what joins conditions.
INDICATORS = (
    (-1, ("count", "sum", "show", "list", "what is")), (1, ("average", "compare", "filter", "group by", "where")),
    (2, ("correlation", "trend", "distribution", "statistical", "multiple", "join", "relationship")),
)
CONDITIONS = ("and", "or", "where", "having", "group by")


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _first(text: Column, table) -> Column:
    out = None
    for name, words in table:
        out = F.when(_any(text, words), name) if out is None else out.when(_any(text, words), name)
    return out


def _first_word(text: Column, table) -> Column:
    """The name of the first word, in the order of the words, that the text has."""
    return _first(text, [(name, (w,)) for name, words in table for w in words])


def intents(questions: DataFrame, text: str = "text") -> DataFrame:
    """question_type, aggregation and number of every question; keywords match inside words."""
    t = F.lower(text)
    return questions.select(
        "*", _first(t, FAMILIES).otherwise("DESCRIPTIVE").alias("question_type"), _first_word(t, FUNCTIONS).alias("aggregation"),
        F.try_to_number(F.nullif(F.regexp_extract(t, r"([0-9]+)", 1), F.lit("")), F.lit("9999999999")).cast("long").alias("number"),
    )


def weighted_types(questions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Best class by keywords (0.2 each, at most 0.6) and patterns (0.3 each, at most 0.4), and its score.

    DESCRIPTIVE with 0.5 where none reaches 0.3; of equal classes the one that is listed first.
    """
    # what a pattern begins or ends with any text for is found without; hundreds of tests in one expression are never
    # compiled, so that words and patterns that are plain text are counted as lists
    asked = questions.select(key, F.lower(F.trim(text)).alias("_text"))

    def hits(found: list[str]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(w) for w in found]), lambda w: F.col("_text").contains(w)))

    def weight(words, patterns) -> Column:
        bare = [p.removeprefix(".*").removesuffix(".*") for p in patterns]
        plain = [p for p in bare if re.escape(p).replace("\\ ", " ") == p]
        matched = sum((F.col("_text").rlike(p).cast("int") for p in bare if p not in plain), hits(plain))
        return F.least(F.lit(0.6), hits(list(words)) * F.lit(0.2)) + F.least(F.lit(0.4), matched * F.lit(0.3))

    scores = [F.struct(F.round(weight(words, patterns), 6).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("kind")) for i, (name, words, patterns) in enumerate(WEIGHTED)]
    rated = asked.select(key, F.array_max(F.array(*scores)).alias("best"))
    return rated.select(key, F.when(F.col("best.score") < 0.3, "DESCRIPTIVE").otherwise(F.col("best.kind")).alias("kind"), F.when(F.col("best.score") < 0.3, 0.5).otherwise(F.col("best.score")).alias("score"))


def complexity(text: Column, columns: list[str]) -> Column:
    """simple, medium or complex by indicators, more than two columns, and more than one condition."""
    t = F.lower(F.trim(text))
    score = sum((F.when(_any(t, words), weight).otherwise(0) for weight, words in INDICATORS), F.lit(0))
    score = score + F.when(sum((t.contains(c.lower()).cast("int") for c in columns), F.lit(0)) > 2, 1).otherwise(0)
    score = score + F.when(sum((t.contains(c).cast("int") for c in CONDITIONS), F.lit(0)) > 1, 1).otherwise(0)
    return F.when(score <= 0, "simple").when(score <= 2, "medium").otherwise("complex")


def aggregation_targets(mentioned: DataFrame, questions: DataFrame, key: str, numeric: list[str], text: str = "text") -> DataFrame:
    """The mentioned columns of questions that ask for an aggregation; a number's confidence counts 1.2 times, at most 1."""
    asked = questions.select(key, _first_word(F.lower(text), FUNCTIONS).alias("aggregation")).where("aggregation IS NOT NULL")
    raised = F.when(F.col("name").isin(numeric), F.least(F.lit(1.0), F.col("confidence") * 1.2)).otherwise(F.col("confidence"))
    return mentioned.join(asked, key).select(key, "name", "aggregation", raised.alias("confidence"))


def features(questions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Length, words, marks and complexity of every question."""
    t = F.lower(text)
    parts = sum((_any(t, words).cast("int") for _, words in FAMILIES), F.lit(0))
    return questions.select(
        key, F.length(text).cast("long").alias("length"), F.size(F.split(F.trim(text), r"\s+")).cast("long").alias("words"), t.rlike("[0-9]").alias("has_number"), F.col(text).contains("?").alias("has_mark"),
        parts.alias("families"), F.when(parts == 0, "simple").when(parts <= 2, "moderate").otherwise("complex").alias("complexity"),
    )


def mentions(questions: DataFrame, columns: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Columns (``name``) that a question names: as they are 1.0, with spaces 0.9, by words (half or more) 0.7 of the share."""
    return column_names.named(questions, columns, key, text)


def fuzzy_columns(questions: DataFrame, columns: DataFrame, key: str, text: str, least: float = 0.6) -> DataFrame:
    """The best similarity of any word of a question to each column name."""
    return column_names.alike(questions, columns, key, text, least)


def filter_phrases(questions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """column, operator and value of phrases such as 'where a > 3' and "with b is 'x'"."""
    pattern = r"(?i)(?:where|with|and)\s+([A-Za-z_]\w*)\s*(>=|<=|!=|=|>|<|is|equals|contains|greater than|less than|at least|at most)\s*'?([\w.\-]+(?: (?-i:[A-Z][a-z][\w.\-]*))*)'?"
    part = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("column"), part(2).alias("operator"), part(3).alias("value"))
    return questions.select(key, F.explode(zipped).alias("f")).select(key, F.col("f.column").alias("column"), F.lower("f.operator").alias("operator"), F.col("f.value").alias("value"))


def sql_blocks(messages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Distinct SQL statements of a text, with what they use."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)\b(SELECT\b.*?)(?:;|$)"), F.lit(1))
    one = F.explode(F.array_distinct(F.transform(found, lambda s: F.upper(F.trim(F.regexp_replace(s, r"\s+", " "))))))
    return messages.select(key, one.alias("sql")).select(
        key, "sql", F.col("sql").rlike(r"\b(SUM|AVG|COUNT|MIN|MAX)\s*\(").alias("has_aggregation"), F.col("sql").contains("GROUP BY").alias("has_grouping"),
        F.col("sql").contains("WHERE").alias("has_filter"), F.col("sql").contains("ORDER BY").alias("has_order"),
    )


def metrics(messages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Numbers with a unit (%, $, K, M, units of time) in a text, in order."""
    pattern = r"(\$?)\s*([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)\s*(?:(%|percent\b|dollars\b|seconds\b|minutes\b|hours\b|days\b|rows\b|records\b)|([KM])\b)?"
    part = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("sign"), part(2).alias("digits"), part(3).alias("unit"), part(4).alias("scale"))
    told = F.filter(zipped, lambda m: (m["sign"] != "") | (m["unit"] != "") | (m["scale"] != ""))
    rows = messages.select(key, F.posexplode(told).alias("place", "m"))
    scale = F.when(F.col("m.scale") == "K", 1e3).when(F.col("m.scale") == "M", 1e6).otherwise(1.0)
    unit = F.when(F.col("m.unit") != "", F.col("m.unit")).when(F.col("m.sign") != "", "$").otherwise(F.col("m.scale"))
    return rows.select(key, "place", (F.replace(F.col("m.digits"), F.lit(","), F.lit("")).cast("double") * scale).alias("value"), unit.alias("unit"))


def answer_features(messages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sentences, words, steps, explanation words and the clarity of an answer."""
    t = F.col(text)
    sentences = F.size(F.filter(F.split(t, r"[.!?]+\s*"), lambda s: F.length(F.trim(s)) > 0))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda s: s != ""))
    steps = F.regexp_count(t, F.lit(r"(?m)^\s*(?:[0-9]+\.|[-*])\s"))
    return messages.select(key, sentences.alias("sentences"), words.alias("words"), steps.alias("steps"), _any(F.lower(t), ("because", "therefore", "due to")).alias("explains"), answers.clarity(t).alias("clarity"))


_SPANS = (("number", re.compile(r"-?\d+(?:\.\d+)?")), ("quoted", re.compile(r"'([^']*)'|\"([^\"]*)\"")), ("date", re.compile(r"\d{4}-\d{2}-\d{2}")), ("operator", re.compile(r">=|<=|!=|=|>|<|\b(?:greater than|less than|equals|contains)\b", re.IGNORECASE)))


def _entity_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if not isinstance(t, str) else sorted(({"kind": k, "text": m.group(0), "first": m.start(), "last": m.end()} for k, p in _SPANS for m in p.finditer(t)), key=lambda x: (x["first"], x["kind"])))


def entities(questions: DataFrame, key: str, text: str = "text", columns: DataFrame | None = None) -> DataFrame:
    """Numbers, dates, operators and quoted values with their places, and the columns that are named if ``columns`` is given."""
    if columns is not None:
        found = column_names.spans(questions, columns, key, text).select(key, "kind", "text", "first", "last")
        return entities(questions, key, text).unionByName(found)
    return questions.select(key, F.explode(F.pandas_udf(_entity_spans, "array<struct<kind:string,text:string,first:int,last:int>>")(F.col(text))).alias("e")).select(key, "e.*")


def filter_conditions(spans: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """For every named column (key, name, last) the nearest operator after it and the nearest value after that."""
    ops = spans.where("kind = 'operator'").select(key, F.struct(F.col("first"), "text", "last").alias("op"))
    near = named.join(ops, key).where(F.col("op.first") >= F.col("last")).groupBy(key, "name", "last").agg(F.min("op").alias("op"))
    values = spans.where("kind IN ('number', 'quoted', 'date')").select(key, F.struct(F.col("first"), "text").alias("v"))
    return near.join(values, key).where(F.col("v.first") >= F.col("op.last")).groupBy(key, "name").agg(F.min_by(F.col("op.text"), "v").alias("operator"), F.min("v")["text"].alias("value"))


def last_turns(messages: DataFrame, conv: str, turn: str, text: str, n: int = 5) -> DataFrame:
    """Turns, and the last ``n`` texts in order, of each conversation."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    recent = messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, text))).alias("_l"))
    return messages.groupBy(conv).agg(F.count("*").alias("interactions")).join(recent, conv).select(conv, "interactions", F.transform("_l", lambda x: x[text]).alias("recent"))


def conversation_summary(messages: DataFrame, conv: str, turn: str, text: str, confidence: str, n: int = 5) -> DataFrame:
    """Turns, the last ``n`` texts in order and the mean confidence (0 where none is known) of each conversation."""
    sure = messages.groupBy(conv).agg(F.coalesce(F.avg(confidence), F.lit(0.0)).alias("confidence"))
    return last_turns(messages, conv, turn, text, n).join(sure, conv)


def combined_answers(parts: DataFrame, key: str, numbers: list[str], most: int = 5) -> DataFrame:
    """One row per ``key``: sums of the numeric fields, mean confidence and the first ``most`` different suggestions.

    ``parts``: key, place, confidence, suggestions (an array) and the numbers.
    """
    said = parts.select(key, "place", F.posexplode("suggestions").alias("i", "s")).groupBy(key, "s").agg(F.min(F.struct("place", "i")).alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    first = said.withColumn("_r", rank).where(F.col("_r") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", "s"))).alias("_s"))
    facts = parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in numbers], F.avg("confidence").alias("confidence"), F.count("*").alias("answers"))
    return facts.join(first, key, "left").withColumn("suggestions", F.coalesce(F.transform("_s", lambda x: x["s"]), F.array().cast("array<string>"))).drop("_s")
