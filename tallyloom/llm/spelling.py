"""Spelling variant grouping: near words by pivotal grams, with Spark joins.

Words are counted over all documents. Two words are near if one insertion, deletion or replacement makes one
the other. Their bigrams have one order for all words, rare ones first; the three rarest of a word (and what
equals the third) are its prefix, and a dynamic programme over the prefix picks its two pivots, the pair of
disjoint bigrams that fewest words hold. One edit spoils at most one of two disjoint bigrams, so that of two
near words the one whose prefix ends earlier has a pivot that stands in the prefix of the other.

Where a pivot survives, the edit lies beyond it or before it. Its place from the start of both words is then
the same, and all that comes before it too, or its place from their ends and all that follows. These position
limits leave the rest of the word, in which exactly one edit may lie: pivots and prefix grams are indexed by
side, head or tail, and the rest with one character left out or none. A word has some 3 entries a character, a
common head or tail gathers nothing, and what meets differs by one edit or, seldom, two, which the verification
sorts out.

The form of a word is its near word of most occurrences (ties: smallest in code-point order) if it has five
times as many or more; the root follows forms to the last one, by pointer doubling.

Defined results: null and empty texts have no words; very long texts are read whole; a null doc_id counts as
an empty one in the hash; repeated rows count again; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import staged

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of so many runs loses a character.
DAMAGED = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: How many times as frequent a form is as its word.
FORM_RATIO = 5
#: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
PREFIX = 3


def _without(text: Column, at: Column) -> Column:
    """A text less its code point ``at`` (from 1)."""
    return F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of every word that is long and frequent enough."""
    runs = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), runs)
    hashed = found.select("run", F.crc32(F.concat("name", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run") + 1).cast("int")
    words = hashed.select(F.when(F.col("h") % DAMAGED == 0, _without(F.col("run"), at)).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letter(char: Column) -> Column:
    code = F.ascii(char)
    return F.when(code < 128, code - ord("a")).otherwise(code - 0xC0 + 26)


def _codes(word: Column) -> Column:
    """The number of the bigram at each place of a word."""
    letters = F.transform(F.split(word, ""), _letter)
    return F.transform(F.sequence(F.lit(0), F.length(word) - 2), lambda i: letters[i] * LETTERS + letters[i + 1])


def _ranked(words: DataFrame) -> DataFrame:
    """The words (word, n) beside grams: rank in the order, words that hold it and place of each bigram."""
    spark = words.sparkSession
    coded = words.withColumn("codes", _codes(F.col("word")))
    held = coded.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count("*").alias("held"))
    counts = [0] * LETTERS**2
    for row in held.collect():  # one row for each of LETTERS ** 2 bigrams at most
        counts[row["code"]] = row["held"]
    order = sorted(range(len(counts)), key=lambda code: (counts[code], code))
    ranks = [0] * len(order)
    for rank, code in enumerate(order):
        ranks[code] = rank
    table = spark.createDataFrame([(ranks, counts)], "ranks array<int>, held array<long>")
    gram = lambda code, at: F.struct(F.col("ranks")[code].alias("rank"), at.alias("at"), F.col("held")[code].alias("held"))
    return coded.crossJoin(F.broadcast(table)).select("word", "n", F.transform("codes", gram).alias("grams"))


def _pivots(prefix: str) -> Column:
    """(cost, first, second): the two disjoint bigrams of the prefix that the fewest words hold, by their places.

    The cheapest bigram that ends before each one is the table of the first step, and the cheapest sum the second's.
    """
    one = lambda g: F.array_min(F.transform(F.filter(prefix, lambda x: x["at"] <= g["at"] - 2), lambda x: F.struct(x["held"], x["at"])))
    two = F.transform(prefix, lambda g: F.struct((one(g)["held"] + g["held"]).alias("cost"), one(g)["at"].alias("first"), g["at"].alias("second")))
    return F.array_min(F.filter(two, lambda x: x["cost"].isNotNull()))


def _keys(word: Column, at: Column, head: bool) -> Column:
    """Hashes of what stands on one side of a bigram, itself included, and of the rest whole or less one character."""
    anchor = F.substr(word, F.lit(1), at + 2) if head else F.substr(word, at + 1)
    rest = F.substr(word, at + 3) if head else F.substr(word, F.lit(1), at)
    variants = F.transform(F.sequence(F.lit(0), F.length(rest)), lambda i: F.when(i == 0, rest).otherwise(_without(rest, i)))
    return F.transform(F.array_distinct(variants), lambda x: F.xxhash64(F.lit(head), anchor, x))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: words (word, n) that differ by exactly one edit."""
    third = F.array_sort("grams")[PREFIX - 1]["rank"]
    prefixed = _ranked(words).select("word", "n", F.filter("grams", lambda g: g["rank"] <= third).alias("prefix"))
    chosen = prefixed.select("word", "n", "prefix", _pivots("prefix").alias("pivots"))
    word = F.col("word")
    pivot_keys = F.concat(_keys(word, F.col("pivots.first"), True), _keys(word, F.col("pivots.second"), False))
    prefix_keys = F.flatten(F.transform("prefix", lambda g: F.concat(_keys(word, g["at"], True), _keys(word, g["at"], False))))
    # few rows that cost much are read in few pieces: dealt out first
    chosen = chosen.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = staged(chosen.select("word", "n", pivot_keys.alias("own"), prefix_keys.alias("all")), "gram-keys")
    own = keyed.select(F.explode("own").alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    index = keyed.select(F.explode("all").alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = own.join(index.hint("merge"), "key").where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    turned = F.col("a") < F.col("b")
    side = lambda x, y: F.when(turned, F.col(x)).otherwise(F.col(y))
    return met.select(side("a", "b").alias("a"), side("a_n", "b_n").alias("a_n"), side("b", "a").alias("b"), side("b_n", "a_n").alias("b_n")).distinct()


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n of every word."""
    sides = [F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")]
    both = near_pairs(words).select(F.inline(F.array(*sides)))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = -F.col("best.less") >= FORM_RATIO * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")
    )


def grouped(docs: DataFrame) -> DataFrame:
    """The columns of query op13: word, form, root, n, n_near and form_n of every word."""
    words = staged(vocabulary(docs), "vocabulary")
    found = staged(forms(words), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    # every form is FORM_RATIO times as frequent, so that chains are short, and each turn doubles what is followed
    chain = max(1, math.ceil(math.log(most, FORM_RATIO)))
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(chain)))):
        roots = staged(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("last"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute_force(rows: list[tuple]) -> dict:
    """word → (form, root, n, n_near, form_n) of rows (doc_id, text) by comparing all words, for tests."""
    count: dict[str, int] = {}
    lower = str.maketrans(UPPER, LOWER)
    for d, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % DAMAGED == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= LEAST_LENGTH:
                count[w] = count.get(w, 0) + 1
    count = {w: n for w, n in count.items() if n >= LEAST_COUNT}

    def near(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in count.items():
        others = [x for x in count if near(w, x)]
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= FORM_RATIO * n else None
        out[w] = (n, len(others))
    for w, (n, k) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, k, count[form[w]] if form[w] else None)
    return out
