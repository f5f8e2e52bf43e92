"""Filter interaction audit: what each of five filters removes, for every order in which they may be applied.

Every document becomes a mask of the filters that it fails, and Spark counts documents, good ones and toxic
ones by part and mask: 32 cells a part at most. From there on a Gray-code walk goes through all 32 sets of
active filters, toggling one filter at a time: each cell keeps a counter of its active failures, and the
survivors change only by the cells whose counter leaves or reaches zero. The 32 states are stored, and
every step of each of the 120 orders is the difference of two of them.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * ``[A-Z]`` > 5 * code points; D any of
``#$%&*|``; E the same text under a smaller doc_id anywhere in the table. Words are maximal runs outside
``\\x20 \\x09-\\x0D``.

Defined results: a null text counts as empty, and empty texts fail A alone, and E if there is one of a smaller
doc_id; very long texts are measured whole; a null doc_id counts as the largest, so that such a row fails E if
any row with a doc_id has its text, and has no label; rows that repeat a doc_id do not fail E by each other; a
doc_id is good or toxic if any row of ``labels`` says so; a null source and an empty one are one part; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import WHITE, digest_of, with_groups
from .scratch import staged

LETTERS = "ABCDE"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATES = 1 << len(LETTERS)
WEIGHTS = ("n", "good", "toxic")
#: Parts whose rows are made at once.
PARTS_AT_ONCE = 64
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _own_failures() -> list[Column]:
    """Of the columns text, words and distinct: what fails A to D."""
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    return [
        F.size("words") < 50,
        100 * F.col("distinct") < 65 * F.size("words"),
        100 * capitals > 5 * F.length("text"),
        F.col("text").rlike("[#$%&*|]"),
    ]


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (bit i: fails letter i) of every document."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, WHITE), "").alias("words"))
    counted = split.withColumn("distinct", F.size(F.array_distinct("words")))
    own = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(_own_failures())), F.lit(0))
    rows = staged(counted.select("doc_id", "part", own.cast("int").alias("own"), digest_of(F.col("text")).alias("digest")), "failures")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    later = (F.col("doc_id") > F.col("first_id")) | (F.col("doc_id").isNull() & F.col("first_id").isNotNull())
    met = with_groups(rows, staged(first, "first-ids"), "digest", rows.count())
    return met.select("doc_id", "part", F.when(later, F.col("own") + STATES // 2).otherwise(F.col("own")).alias("mask"))


def _dense(column: str) -> Column:
    """A map by mask as an array of STATES numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda m: F.coalesce(F.col(column)[m], F.lit(0).cast("long")))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, as arrays of one number for each mask, n, good and toxic."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    one = F.lit(1).cast("long").alias("n")
    named = masked.where("doc_id IS NOT NULL").join(said, "doc_id", "left").select("part", "mask", one, "good", "toxic")
    # rows without a doc_id have no label and need not meet in one task
    rows = named.unionByName(masked.where("doc_id IS NULL").select("part", "mask", one), allowMissingColumns=True)
    counted = rows.groupBy("part", "mask").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in WEIGHTS])
    by_part = counted.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in WEIGHTS])
    return by_part.select("part", *[_dense(c).alias(c) for c in WEIGHTS])


def survivors(counts: np.ndarray) -> np.ndarray:
    """What survives each set of active filters; counts and result: (parts, 32, weights)."""
    states = np.empty_like(counts)
    failing = np.zeros(STATES, np.int64)
    running = counts.sum(axis=1)
    states[:, 0] = running
    for k in range(1, STATES):
        active = k ^ (k >> 1)
        bit = k & -k  # the filter that this step of the Gray code toggles
        touched = np.flatnonzero(np.arange(STATES) & bit)
        if active & bit:
            running = running - counts[:, touched[failing[touched] == 0]].sum(axis=1)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            running = running + counts[:, touched[failing[touched] == 0]].sum(axis=1)
        states[:, active] = running
    return states


ORDERS = np.array(list(itertools.permutations(range(len(LETTERS)))))
NAMES = ["".join(LETTERS[i] for i in order) for order in ORDERS]


def _report(parts: list[str], states: np.ndarray) -> pd.DataFrame:
    """A row for each part, order and step."""
    after = np.cumsum(1 << ORDERS, axis=1)
    before = after - (1 << ORDERS)
    lost = states[:, before] - states[:, after]  # (parts, orders, steps, weights)
    removed = lost[..., 0]
    fails = (states[:, [0]] - states[:, 1 << np.arange(len(LETTERS))])[..., 0]
    alone = (states[:, STATES - 1 - (1 << np.arange(len(LETTERS)))] - states[:, [STATES - 1]])[..., 0]
    shapley = np.stack([np.where(ORDERS == f, removed, 0).sum(axis=(1, 2)) for f in range(len(LETTERS))], axis=1)
    p, o, s = removed.shape
    return pd.DataFrame(
        {
            "part": np.repeat(np.array(parts, object), o * s),
            "filter_order": np.tile(np.repeat(np.array(NAMES, object), s), p),
            "step": np.tile(np.arange(1, s + 1, dtype=np.int32), p * o),
            "kept": states[:, after][..., 0].ravel(),
            "removed": removed.ravel(),
            "redundant": (fails[:, ORDERS] - removed).ravel(),
            "unique_fails": alone[:, ORDERS].ravel(),
            "good_lost": lost[..., 1].ravel(),
            "toxic_lost": lost[..., 2].ravel(),
            "shapley": shapley[:, ORDERS].ravel(),
        }
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op12: 600 rows for each part."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), PARTS_AT_ONCE):
                some = pdf.iloc[at : at + PARTS_AT_ONCE]
                counts = np.stack([np.stack(some[c].to_list()) for c in WEIGHTS], axis=2)
                yield _report(some["part"].to_list(), survivors(counts))

    return cells(masks(docs), labels).mapInPandas(walk, RESULT)


ORACLE_SQL = """
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
                 min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
masked AS (
  SELECT doc_id, part,
         (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > first_id, first_id IS NOT NULL)::INT AS mask
  FROM split),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masked LEFT JOIN said USING (doc_id) GROUP BY part, mask),
parts AS (SELECT DISTINCT part FROM counted),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, step, bit, (SELECT coalesce(sum(x.bit), 0) FROM letters x WHERE instr(filter_order, x.letter) < step)::INT AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step), letters WHERE substr(filter_order, step, 1) = letter),
found AS (
  SELECT p.part, filter_order, step, s.bit,
         coalesce(sum(n) FILTER ((mask & (s.earlier | s.bit)) = 0), 0) AS kept,
         coalesce(sum(n) FILTER ((mask & s.earlier) = 0 AND (mask & s.bit) <> 0), 0) AS removed,
         coalesce(sum(n) FILTER ((mask & s.earlier) <> 0 AND (mask & s.bit) <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = s.bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER ((mask & s.earlier) = 0 AND (mask & s.bit) <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER ((mask & s.earlier) = 0 AND (mask & s.bit) <> 0), 0) AS toxic_lost
  FROM parts p CROSS JOIN steps s JOIN counted USING (part) GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM found"""


def brute_force(rows: list[tuple], labels: dict) -> dict:
    """(part, filter_order, step) to the counts of rows (doc_id, source, text), by applying every order, for tests."""
    smallest: dict[str, int] = {}
    for d, _, t in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    out: dict[tuple, list] = {}
    for part in {s or "" for _, s, _ in rows}:
        docs = []
        for d, s, t in rows:
            if (s or "") == part:
                t = t or ""
                w = [x for x in t.encode().split() if x]
                e = t in smallest and (d is None or d > smallest[t])
                caps = sum(c in CAPITALS for c in t)
                docs.append((d, [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * caps > 5 * len(t), any(c in "#$%&*|" for c in t), e]))
        shapley = [0] * len(LETTERS)
        for order in itertools.permutations(range(len(LETTERS))):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                fails = [x for x in docs if x[1][f]]
                shapley[f] += len(gone)
                key = (part, "".join(LETTERS[i] for i in order), step)
                seen = [labels.get(d, (0, 0)) for d, _ in gone]
                out[key] = [len(left), len(gone), len(fails) - len(gone), sum(sum(x[1]) == 1 for x in fails), sum(q == 1 for q, _ in seen), sum(x == 1 for _, x in seen), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}
