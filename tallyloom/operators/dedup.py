"""Exact and fuzzy duplicates of rows and values, repeated headers, names for generic columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import squeeze
from ..functions.similarity import edit_similarity, similarity
from ..sources import shared


def exact(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """The first row, by ``order``, of each set of equal rows."""
    names = columns or [c for c in df.columns if c != order]
    w = Window.partitionBy(*names).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def row_text(columns: list[str]) -> Column:
    """A row as one text: values lower-cased, squeezed and joined by bars; missing ones empty."""
    return F.concat_ws("|", *[F.coalesce(squeeze(F.col(c).cast("string")), F.lit("")) for c in columns])


def repeated_headers(df: DataFrame, columns: list[str], least: float = 0.9) -> Column:
    """Whether ``least`` of the header names occur among the row's values."""
    names = F.array_distinct(F.array(*[F.lit(re.sub(r"\s+", " ", c.strip().lower())) for c in columns]))
    values = F.array_distinct(F.array_compact(F.array(*[squeeze(F.col(c).cast("string")) for c in columns])))
    return F.size(F.array_intersect(values, names)) / F.size(names) >= least


def without_headers(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    return df.where(~repeated_headers(df, columns, least))


def candidates(df: DataFrame, key: str, text: str, threshold: float, block: Column | None = None, edit_only: bool = False) -> DataFrame:
    """Pairs (a, b), a before b, of texts of one block that may be similar: all that are, and others."""
    spoiled = lambda n: F.floor(F.lit((1 if edit_only else 2) * (1 - threshold)) * n + 1e-9).cast("int")
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), (block if block is not None else F.lit(0)).alias("g"), F.length(text).alias("n")).where("t IS NOT NULL")
    met = _by_stretches(rows, threshold, spoiled)
    if any(n // (_spoiled(n, threshold, edit_only) + 1) < 2 for n in range(1, 400) if _spoiled(n, threshold, edit_only)):
        met = met.unionByName(_by_characters(rows, threshold, spoiled))
    return met.distinct()


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.85, block: Column | None = None, edit_only: bool = False) -> DataFrame:
    """Pairs (a, b, similarity) with a before b, of texts in one block.

    Neither measure exceeds twice the characters in common order over both lengths. The longer of two similar texts,
    of n characters, thus differs from the other in at most ``2 (1 - threshold) n`` single insertions and deletions
    (edits of any kind, and half as many, where only they count). It is cut into one stretch more than that: one of
    them stands whole in the other text, not further off than the differences allow. Stretches are the keys, and
    only where they would be single characters, at low thresholds, texts meet by characters instead.
    """
    pairs = candidates(df, key, text, threshold, block, edit_only)
    own, other = df.select(F.col(key).alias("a"), F.col(text).alias("ta")), df.select(F.col(key).alias("b"), F.col(text).alias("tb"))
    whole = pairs.join(own, "a").join(other, "b").where(_may_reach(threshold))
    score = edit_similarity(F.col("ta"), F.col("tb")) if edit_only else similarity(F.col("ta"), F.col("tb"))
    return whole.select("a", "b", score.alias("similarity")).where(F.col("similarity") >= threshold)


#: Characters up to which edits are counted before Python looks at a pair.
COUNTED = 200


def _may_reach(threshold: float) -> Column:
    """Whether texts ta and tb may be similar, by the characters in common and by edits.

    Single insertions and deletions are never fewer than edits, so that the characters in common order are at most
    half of what the edits leave of both lengths.
    """
    both = F.length("ta") + F.length("tb")
    common = 2 * F.size(F.array_intersect(_characters(F.col("ta")), _characters(F.col("tb")))) >= F.lit(threshold) * both - 1e-9
    long_ = F.greatest(F.length("ta"), F.length("tb")) > COUNTED
    return (long_ | (F.levenshtein("ta", "tb") <= F.lit(1 - threshold) * both + 1e-9)) & common


def _close_pairs(df: DataFrame, key: str, text: str, threshold: float, block: Column | None = None) -> DataFrame:
    """The pairs (a, b) of ``similar_pairs`` without their measure: Python only looks at those that edits leave open."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), (block if block is not None else F.lit(0)).alias("g"))
    met = candidates(rows, "k", "t", threshold, F.col("g"))
    own, other = rows.select(F.col("k").alias("a"), F.col("t").alias("ta")), rows.select(F.col("k").alias("b"), F.col("t").alias("tb"))
    whole = met.join(own, "a").join(other, "b").where(_may_reach(threshold))
    short = F.greatest(F.length("ta"), F.length("tb")) <= 50
    path = shared.folder(df.sparkSession, "pairs")
    whole.withColumn("sure", short & (edit_similarity(F.col("ta"), F.col("tb")) >= threshold)).write.parquet(path)
    written = df.sparkSession.read.parquet(path)
    left = written.where("NOT sure").where(similarity(F.col("ta"), F.col("tb")) >= threshold)
    return written.where("sure").select("a", "b").unionByName(left.select("a", "b"))


def _spoiled(n: int, threshold: float, edit_only: bool) -> int:
    return int((1 if edit_only else 2) * (1 - threshold) * n + 1e-9)


def _least_share(threshold: float) -> float:
    """How much shorter a text may be that is similar."""
    return threshold / (2 - threshold)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")


def _by_stretches(rows: DataFrame, threshold: float, spoiled) -> DataFrame:
    """Candidates (a, b): a stretch of the longer text occurs in the other near its place."""
    parts = spoiled(F.col("n")) + 1
    width = lambda n: F.floor(n / (spoiled(n) + 1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.floor(i * F.col("n") / parts).cast("int"))
    long_ = rows.where((width(F.col("n")) >= 2) | (spoiled(F.col("n")) == 0)).select(F.col("k").alias("x"), "g", F.col("n").alias("nx"), (parts - 1).alias("far"), width(F.col("n")).alias("w"), "t", F.explode(cut).alias("px"))
    long_ = long_.select("x", "g", "nx", "far", "w", "px", F.substr("t", F.col("px") + 1, F.col("w")).alias("stretch"))
    # the widths that texts as long as this one, or as much longer as they may be, are cut by
    most = F.floor(F.col("n") / F.lit(_least_share(threshold)) + 1e-9).cast("int")
    widths = F.array_distinct(F.transform(F.sequence(F.col("n"), most), lambda n: F.when((width(n) >= 2) | (spoiled(n) == 0), width(n)).otherwise(-1)))
    short = rows.withColumn("w", F.explode(widths)).where("w >= 0 AND w <= n")
    short = short.select(F.col("k").alias("y"), "g", F.col("n").alias("ny"), "w", "t", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("w"))).alias("py"))
    short = short.select("y", "g", "ny", "w", "py", F.substr("t", F.col("py") + 1, F.col("w")).alias("stretch"))
    near = (F.col("ny") <= F.col("nx")) & (F.col("ny") >= F.lit(_least_share(threshold)) * F.col("nx") - 1e-9) & (F.abs(F.col("px") - F.col("py")) <= F.col("far"))
    return _ordered(long_.join(short, ["g", "w", "stretch"]).where(near & (F.col("x") != F.col("y"))).select("x", "y"))


def _by_characters(rows: DataFrame, threshold: float, spoiled) -> DataFrame:
    """Candidates (a, b) of which the longer text would be cut into single characters.

    A text's characters, numbered by occurrence, are read in one order, high numbers first; two texts that reach the
    threshold share one of the first ``n - ceil(low n) + 1``, and meet in steps of a geometric scale of lengths.
    """
    low = _least_share(threshold)
    step = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / -F.log(F.lit(low)) + 1e-9).cast("int")
    first = F.slice(_characters(F.col("t")), 1, (F.col("n") - F.ceil(F.lit(low) * F.col("n") - 1e-9) + 1).cast("int"))
    keyed = rows.where("n > 0").select("k", "g", "n", step.alias("s"), F.explode(first).alias("m"))
    left = keyed.select(F.col("k").alias("x"), "g", "m", F.col("n").alias("nx"), F.explode(F.array(F.col("s") - 1, F.col("s"), F.col("s") + 1)).alias("s"))
    right = keyed.select(F.col("k").alias("y"), "g", "m", "s", F.col("n").alias("ny"))
    longer = F.greatest("nx", "ny")
    single = (spoiled(longer) > 0) & (F.floor(longer / (spoiled(longer) + 1)) < 2)
    near = (F.least("nx", "ny") >= F.lit(low) * longer - 1e-9) & single & (F.col("x") < F.col("y"))
    return _ordered(left.join(right, ["g", "s", "m"]).where(near).select("x", "y"))


def _characters(text: Column) -> Column:
    """A number for each character and the count of it so far, descending."""
    code = F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1)))))
    ordered = F.array_sort(code)
    numbered = F.transform(ordered, lambda c, i: (i + 2 - F.array_position(ordered, c)).cast("long") * (1 << 21) + c)
    return F.sort_array(numbered, asc=False)


def _leaders(pdf: pd.DataFrame) -> pd.DataFrame:
    """In row order: a row not yet taken leads and takes what is like it and not yet taken."""
    like: dict = {}
    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        like.setdefault(a, []).append(b)
    taken: dict = {}
    for a in sorted(set(pdf["a"]) | set(pdf["b"])):
        if a not in taken:
            for b in sorted(like.get(a, ())):
                if b not in taken:
                    taken[b] = a
                    taken.setdefault(a, a)
    return pd.DataFrame({"row": list(taken), "leader": [taken[k] for k in taken]}).astype("int64")


def leader_groups(pairs: DataFrame) -> DataFrame:
    """(row, leader) by greedy clustering in row order within each connected component of the pairs.

    Labels take the least of their neighbours and then that one's own, so that the rounds grow with the logarithm
    of a component's width; each round is written to the shared folder, which cuts its lineage.
    """
    spark = pairs.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = shared.folder(spark, "labels")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = written(pairs.select("a", "b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = edges.select(F.explode(F.array("a", "b")).alias("row")).distinct().withColumn("c", F.col("row"))
    while True:
        least = both.join(label.withColumnRenamed("row", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        nearer = label.join(least, label["row"] == least["a"]).select("row", "c", F.least("c", "m").alias("m"))
        of_label = label.select(F.col("row").alias("m"), F.col("c").alias("mm"))
        fresh = written(nearer.join(of_label, "m").select("row", F.least("m", "mm").alias("c"), (F.least("m", "mm") < F.col("c")).alias("moved")))
        label = fresh.drop("moved")
        if not fresh.where("moved").limit(1).count():
            break
    grouped = edges.join(label.withColumnRenamed("row", "a"), "a")
    return grouped.groupBy("c").applyInPandas(_leaders, "row long, leader long")


def fuzzy(df: DataFrame, order: str, columns: list[str], threshold: float = 0.85, block: Column | None = None) -> DataFrame:
    """Without the rows that a similar earlier row leads."""
    texts = df.select(F.col(order).alias("k"), row_text(columns).alias("t"), (block if block is not None else F.lit(0)).alias("g"))
    # equal rows have the same likes, so the first of them stands for all
    first = texts.groupBy("t", "g").agg(F.min("k").alias("f"))
    follow = leader_groups(_close_pairs(first, "f", "t", threshold, F.col("g"))).where("row <> leader").select(F.col("row").alias("f"))
    copies = texts.join(first, ["t", "g"]).where("k <> f").select("k")
    return df.join(copies.unionByName(follow.select(F.col("f").alias("k"))).withColumnRenamed("k", order), order, "left_anti")


def similar_values(df: DataFrame, column: str, threshold: float = 0.85) -> DataFrame:
    """Groups of spellings of a column: leader, values and rows; a repeated value alone is a group."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    numbered = counts.withColumn("k", F.xxhash64("value")).withColumn("t", squeeze(F.col("value")))
    lead = leader_groups(_close_pairs(numbered, "k", "t", threshold))
    grouped = numbered.join(lead, numbered["k"] == lead["row"], "left").withColumn("leader", F.coalesce("leader", "k"))
    return grouped.groupBy("leader").agg(F.array_sort(F.collect_list("value")).alias("spellings"), F.sum("n").alias("rows")).where("rows > 1").drop("leader")


_GENERIC = re.compile(r"^(unnamed: ?\d+|\d+|col(umn)? ?_?\d+|[a-z])$", re.IGNORECASE)
# What the first values of a column say about its name.
_NAMES = (
    (r"^[\w.+-]+@[\w-]+\.[\w.]+$", "Email"), (r"^[$€£¥₹]\s*[\d,.]+$", "Currency"), (r"^[\d.]+\s*%$", "Percentage"),
    (r"^\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}$", "Phone"), (r"^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})$", "Date"),
)


def meaningful_names(df: DataFrame, order: str) -> DataFrame:
    """Generic column names replaced by what the first ten values look like."""
    generic = [c for c in df.columns if c != order and _GENERIC.match(c)]
    if not generic:
        return df
    first = df.orderBy(order).limit(10).select(*[f"`{c}`" for c in generic]).collect()  # ten rows
    used, names = {c for c in df.columns if c not in generic}, {}
    for c in generic:
        values = [str(r[c]).strip() for r in first if r[c] is not None and str(r[c]).strip()]
        share = lambda p: sum(bool(re.match(p, v)) for v in values) > 0.7 * len(values) if values else False  # noqa: E731, B023
        name = next((n for p, n in _NAMES if share(p)), None)
        if name is None:
            name = "Amount" if share(r"^-?[\d,]*\.?\d+$") else "Category" if values and len(set(values)) < 0.5 * len(values) else "Description" if values and sum(map(len, values)) > 30 * len(values) else "Name"
        fresh, k = name, 2
        while fresh in used:
            fresh, k = f"{name}_{k}", k + 1
        used.add(fresh)
        names[c] = fresh
    return df.withColumnsRenamed(names)


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, after and removed: one row."""
    return before.agg(F.count("*").alias("rows_before")).crossJoin(after.agg(F.count("*").alias("rows_after"))).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def pipeline(df: DataFrame, order: str, threshold: float = 0.85, block: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Names, exact copies, repeated headers and similar rows, one after another, and a row for each step (step, rows_before, rows_after, removed)."""
    names = [c for c in df.columns if c != order]
    log, n = [], df.count()
    for step, run in (
        ("names", lambda d: meaningful_names(d, order)), ("exact", lambda d: exact(d, order, [c for c in d.columns if c != order])),
        ("headers", lambda d: without_headers(d, [c for c in d.columns if c != order])), ("fuzzy", lambda d: fuzzy(d, order, [c for c in d.columns if c != order], threshold, block)),
    ):
        if names:
            df = run(df)
        left = df.count()
        log.append((step, n, left, n - left))
        n = left
    return df, df.sparkSession.createDataFrame(log, "step string, rows_before long, rows_after long, removed long")  # four rows
