"""Where texts name columns: a multi-pattern automaton for spans, joins on words for the rest.

Names are looked for as they are and with spaces for underscores. Up to ``MOST_BYTES`` of them become one automaton in
every task, which passes over a text once, however many names there are. A larger set of names meets the texts by a
join on the first characters of each form, and finds the same spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import similarity

#: Bytes of names that are sent to every task.
MOST_BYTES = 16 << 20
#: First characters of a form by which a large set of names is joined.
HEAD = 4
#: What a name is worth as it is, with spaces, and by a share of its words, and the least such share.
EXACT, SPACED, BY_WORDS, LEAST_SHARE = 1.0, 0.9, 0.7, 0.5


def _forms(columns: DataFrame) -> DataFrame:
    """name, form and confidence: two forms of each name, or one where they are alike."""
    name = F.lower("name")
    exact, spaced = F.struct(name.alias("form"), F.lit(EXACT).alias("confidence")), F.struct(F.replace(name, F.lit("_"), F.lit(" ")).alias("form"), F.lit(SPACED).alias("confidence"))
    both = F.when(name.contains("_"), F.array(exact, spaced)).otherwise(F.array(exact))
    return columns.where("name IS NOT NULL AND name <> ''").select("name").distinct().select("name", F.inline(both))


def occurrences(questions: DataFrame, columns: DataFrame, key: str, text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """key, name, confidence, first and last (from 0, end excluded) of every place where a lower-cased text holds a form of a name."""
    forms = _forms(columns).cache()
    try:
        size = forms.select(F.sum(F.octet_length("form") + F.octet_length("name"))).first()[0] or 0
        low = questions.select(key, F.lower(text).alias("_low")).where("_low IS NOT NULL")
        if size > most_bytes:
            return _by_heads(low, forms, key)
        rows = [tuple(r) for r in forms.collect()]  # at most ``most_bytes``
        return low.mapInPandas(_finder(rows, key), f"{key} {questions.schema[key].dataType.simpleString()}, name string, confidence double, first int, last int")
    finally:
        forms.unpersist()


def _finder(rows: list[tuple], key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for name, form, confidence in rows:
            machine.add_word(form, (*machine.get(form, ()), (name, confidence, len(form))))
        if rows:
            machine.make_automaton()
        for pdf in batches:
            out = []
            for k, low in zip(pdf[key], pdf["_low"], strict=True):
                for end, found in machine.iter(low) if rows else ():
                    out += [(k, name, confidence, end + 1 - n, end + 1) for name, confidence, n in found]
            yield pd.DataFrame(out, columns=[key, "name", "confidence", "first", "last"])

    return run


def _by_heads(low: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """The same by a join on the first ``HEAD`` characters of a form, or all of a shorter one."""
    headed = forms.withColumn("_head", F.substring("form", 1, HEAD))
    sizes = [r[0] for r in headed.select(F.length("_head")).distinct().collect()]  # HEAD numbers at most
    places = F.flatten(F.array(*[_heads(n) for n in sorted(sizes)]))
    asked = low.select(key, "_low", F.inline(places))
    met = asked.join(headed, "_head").where(F.substr("_low", F.col("_at") + 1, F.length("form")) == F.col("form"))
    return met.select(key, "name", "confidence", F.col("_at").alias("first"), (F.col("_at") + F.length("form")).cast("int").alias("last"))


def _heads(n: int) -> Column:
    """Every stretch of ``n`` characters of a text with its place."""
    last = F.length("_low") - n
    stretch = lambda i: F.struct(F.substr("_low", i + 1, F.lit(n)).alias("_head"), i.alias("_at"))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), stretch)).otherwise(F.array().cast("array<struct<_head:string,_at:int>>"))


def spans(questions: DataFrame, columns: DataFrame, key: str, text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Places of names in texts that do not overlap, the longest first, then the first; key, kind (column), text, name, first, last and confidence."""
    found = occurrences(questions, columns, key, text, most_bytes).groupBy(key).agg(F.collect_list(F.struct("name", "confidence", "first", "last")).alias("all"))
    # what one text holds: the longest, then the earliest, then the surest, then the smallest name
    order = F.array_sort(F.transform("all", lambda x: F.struct((x["first"] - x["last"]).alias("less"), x["first"].alias("first"), (-x["confidence"]).alias("unsure"), x["name"].alias("name"), x["last"].alias("last"))))
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["first"] < y["last"]) & (y["first"] < x["last"]))
    none = F.slice(order, 1, 0)
    kept = F.aggregate(order, none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    rows = found.select(key, F.inline(kept))
    return rows.join(questions.select(key, F.lower(text).alias("_low")), key).select(
        key, F.lit("column").alias("kind"), F.substr("_low", F.col("first") + 1, F.col("last") - F.col("first")).alias("text"), "name", "first", "last", (-F.col("unsure")).alias("confidence")
    )


def named(questions: DataFrame, columns: DataFrame, key: str, text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """key, name and the best confidence of every column that a text names: as it is, with spaces, or by half of its words or more.

    Words of texts and names meet by an equi-join, so that only texts that share a word with a name are looked at.
    """
    whole = occurrences(questions, columns, key, text, most_bytes).select(key, "name", "confidence")
    parts = columns.where("name IS NOT NULL").select("name").distinct().withColumn("_words", F.array_distinct(F.split(F.replace(F.lower("name"), F.lit("_"), F.lit(" ")), " ")))
    by_word = parts.select("name", F.size("_words").alias("_n"), F.explode("_words").alias("_word")).where("_word <> ''")
    said = questions.select(key, F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), " +"))).alias("_word"))
    share = said.join(by_word, "_word").groupBy(key, "name").agg((F.count("*") / F.first("_n")).alias("_share"))
    some = share.where(F.col("_share") >= LEAST_SHARE).select(key, "name", (F.col("_share") * BY_WORDS).alias("confidence"))
    return whole.unionByName(some).groupBy(key, "name").agg(F.max("confidence").alias("confidence"))


def alike(questions: DataFrame, columns: DataFrame, key: str, text: str, least: float = 0.6) -> DataFrame:
    """key, name and similarity: the best of any word of a text to each column name, from ``least`` on.

    Each distinct word is compared once, and only with names whose length and letters leave it a chance: the
    similarity is twice the letters in common order over all letters, which cannot exceed the letters in common.
    """
    words = questions.select(key, F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9_]+"))).alias("word")).where(F.length("word") > 2)
    names = columns.where("name IS NOT NULL").select("name", F.lower("name").alias("_low")).distinct()
    size = lambda c: F.length(c)
    # a word of n letters only suits names of n (1 - d) to n (1 + d) letters: joined on that length
    low, high = least / (2 - least), (2 - least) / least
    lengths = F.sequence(F.ceil(size("word") * low - 1e-9).cast("int"), F.floor(size("word") * high + 1e-9).cast("int"))
    met = words.select("word").distinct().select("word", F.explode(lengths).alias("_length")).join(names.withColumn("_length", size("_low")), "_length")
    in_common = F.aggregate(
        F.array_distinct(F.split("word", "")), F.lit(0),
        lambda n, c: n + F.when(c == "", 0).otherwise(F.least(size("word") - size(F.replace(F.col("word"), c)), size("_low") - size(F.replace(F.col("_low"), c)))),
    )
    near = met.where(2 * in_common >= least * (size("word") + size("_low")) - 1e-9).select("word", "name", similarity(F.col("word"), F.col("_low")).alias("s")).where(F.col("s") >= least)
    return words.join(near, "word").groupBy(key, "name").agg(F.max("s").alias("similarity"))


def best_names(mentioned: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The ``most`` surest columns of each text, ties by name."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "name"))
    return mentioned.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")
