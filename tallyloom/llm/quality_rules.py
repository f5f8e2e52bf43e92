"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Measures are counts, and a rule bounds one count against another in thousandths, so that every
verdict is integer arithmetic. A null text has no words. Words are maximal runs outside
``\\x20 \\x09-\\x0D``; lines are split at ``\\n`` and count only if they hold a word.

Defined results: null, empty and white-space texts have zero counts and fail the base rule; very
long texts are measured whole; repeated rows, with a doc_id or without, are judged alike; a count on the
bound of a rule passes; an empty table gives no rows; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is it that for was on with as be by at from this are or an not "
    "le la les de des du et un une en que qui dans pour sur avec est par au pas "
    "der die das und ist ein eine zu den von mit nicht auf im für sich dem des "
    "el los las y en un una con por para del se su como es lo al"
).split()


@dataclass(frozen=True)
class Rule:
    """``low`` to ``high`` thousandths of ``per`` are allowed for ``count``; None: no bound."""

    name: str
    count: str
    per: str
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2000, 12000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("shouting_marks", "n_marks", "n_words", None, 300),
    Rule("capitals", "n_capitals", "word_chars", None, 400),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 800),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    split = docs.select("doc_id", text.alias("text"), _words(text).alias("words"), lines.alias("lines"))
    n = F.size("words")
    high = F.lit(-(1 << 32)).cast("long")

    # three-word windows as hash and place in one long; equal hashes are neighbours once sorted
    def window(i: Column) -> Column:
        return F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))

    hashed = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<long>"))
    counted = split.select(
        "doc_id", "words", n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(hashed).alias("hashed"),
    )
    beside = F.filter(
        "hashed",
        lambda h, j: F.coalesce(h.bitwiseXOR(F.get("hashed", j - 1)).bitwiseAND(high) == 0, F.lit(False))
        | F.coalesce(h.bitwiseXOR(F.get("hashed", j + 1)).bitwiseAND(high) == 0, F.lit(False)),
    )
    others = [c for c in counted.columns if c not in ("words", "hashed")]
    maybe = counted.select(*others, "words", beside.alias("maybe"))
    # equal hashes are only candidates: the windows themselves decide
    spelled = F.transform(
        "maybe",
        lambda h: F.struct(
            F.array_join(F.slice("words", h.bitwiseAND(F.lit((1 << 32) - 1).cast("long")).cast("int") + 1, 3), " ").alias("w"),
            h.bitwiseAND(F.lit((1 << 32) - 1).cast("long")).alias("i"),
        ),
    )
    spelt = maybe.select(*others, F.sort_array(spelled).alias("spelt"))
    twice = F.filter(
        "spelt",
        lambda x, j: F.coalesce(x["w"] == F.get("spelt", j - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get("spelt", j + 1)["w"], F.lit(False)),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return spelt.select(*others, F.size(covered).cast("long").alias("n_repeat_words"))


def _broken(rule: Rule) -> Column:
    count, per = 1000 * F.col(rule.count), F.col(rule.per)
    tests = [count < rule.low * per] if rule.low is not None else []
    tests += [count > rule.high * per] if rule.high is not None else []
    return tests[0] | tests[1] if len(tests) == 2 else tests[0]


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, all counts, ``base_failed``, ``kept`` and the names of the rules that a text breaks."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(_broken(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return measures(docs).withColumn("base_failed", base).withColumn("broken_rules", broken).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)
    )


def report(docs: DataFrame) -> DataFrame:
    """The columns of query op1."""
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_marks", "n_capitals", "n_stop_words", "n_lines", F.array_join("broken_rules", ",").alias("broken_rules"),
    )


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns; each row is judged by its own text."""
    row = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    # the row number keeps the filter above the measures, which would else be copied into it
    judged_rows = judged(row, rules).withColumn("_place", F.monotonically_increasing_id())
    return judged_rows.where(F.col("kept") & (F.col("_place") >= 0)).select("doc_id.*")


def _sql() -> str:
    white = "[ \\t-\\r]+"
    rules = [
        (r.name, " OR ".join([f"1000 * {r.count} < {r.low} * {r.per}"] * (r.low is not None) + [f"1000 * {r.count} > {r.high} * {r.per}"] * (r.high is not None)))
        for r in RULES
    ]
    names = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{white}'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \\t-\\r]')) AS lines,
         row_number() OVER () AS r
  FROM documents),
windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS i FROM split)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(regexp_extract_all(text, '[!?]')) AS BIGINT) AS n_marks,
         CAST(len(regexp_extract_all(text, '\\p{{Lu}}')) AS BIGINT) AS n_capitals,
         CAST(len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS BIGINT) AS n_stop_words,
         CAST(len(lines) AS BIGINT) AS n_lines
  FROM split LEFT JOIN repeated USING (r)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         concat_ws(',', {names}) AS broken_rules
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken_rules = '' AS kept, n_marks, n_capitals, n_stop_words, n_lines, broken_rules
FROM judged"""


ORACLE_SQL = _sql()
