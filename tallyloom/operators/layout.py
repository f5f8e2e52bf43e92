"""Words on a page to tables: lines, rows, column bounds, regions, cells, headers, fragments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, gap: float, out: str) -> DataFrame:
    """Numbers runs of rows whose ``value`` is within ``gap`` of the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.abs(F.col(value) - F.lag(value).over(w)) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def lines(words: DataFrame, keys: list[str], order: list[str], gap: float = 10) -> DataFrame:
    return islands(words, keys, order, "y", gap, "line")


def rows_by_running_mean(words: DataFrame, keys: list[str], gap: float = 15) -> DataFrame:
    """Sorted by y, a word joins the row if it is within ``gap`` of the mean y of the row so far.

    Words pass sorted by page; a task keeps the mean of one row.
    """

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, row, total, n = None, 0, 0.0, 0
        for pdf in batches:
            out = []
            for key, y in zip(zip(*[pdf[k] for k in keys], strict=True), pdf["y"].tolist(), strict=True):
                if key != page:
                    page, row, total, n = key, 0, 0.0, 0
                elif abs(y - total / n) > gap:
                    row, total, n = row + 1, 0.0, 0
                total, n = total + y, n + 1
                out.append(row)
            yield pdf.assign(row_no=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return words.repartition(*keys).sortWithinPartitions(*keys, "y", "x").mapInPandas(assign, f"{fields}, row_no int")


def column_bounds(words: DataFrame, keys: list[str], gap: float = 30) -> DataFrame:
    """Clusters of word starts, a new one where the gap is over ``gap``: number and whole-number mean."""
    starts = words.select(*keys, "x").distinct()
    return islands(starts, keys, ["x"], "x", gap, "col_no").groupBy(*keys, "col_no").agg(F.floor(F.avg("x")).cast("int").alias("bound"))


def column_edges(words: DataFrame, keys: list[str], gap: float = 30, edge: float = 10) -> DataFrame:
    """Column bounds of a page with its edges: col_no from 0, bound.

    Clusters of word starts, a new one where the gap is over ``gap``, lie at the whole-number mean of their words. The first
    start is put before them where it is over ``edge`` to the left, and the last end of a word after them likewise. Centres
    are never within ``gap`` of each other, since their clusters are not.
    """
    starts = words.groupBy(*keys, "x").agg(F.count("*").alias("_n"))
    mean = (F.sum(F.col("x") * F.col("_n")) / F.sum("_n")).cast("int")
    centres = islands(starts, keys, ["x"], "x", gap, "_c").groupBy(*keys, "_c").agg(mean.alias("bound"))
    extent = words.groupBy(*keys).agg(F.min("x").cast("int").alias("_lo"), F.max(F.col("x") + F.col("width")).cast("int").alias("_hi"))
    inner = centres.groupBy(*keys).agg(F.array_sort(F.collect_list("bound")).alias("_b")).join(extent, keys)  # at most the width of a page over the gap
    none = F.array().cast("array<int>")
    left = F.when(F.element_at("_b", 1) > F.col("_lo") + edge, F.array("_lo")).otherwise(none)
    right = F.when(F.element_at("_b", -1) < F.col("_hi") - edge, F.array("_hi")).otherwise(none)
    return inner.select(*keys, F.posexplode(F.concat(left, F.col("_b"), right)).alias("col_no", "bound"))


def block_tables(blocks: DataFrame, keys: list[str], gap: float = 20) -> DataFrame:
    """The table region of a page of blocks: x, y, width, height, rows and blocks; pages without one have no row.

    A block within ``gap`` of the y before it is in the same row. Rows of one block do not count; a table has two rows
    or more, on a page of at least four blocks.
    """
    page = Window.partitionBy(*keys)
    placed = islands(blocks.withColumn("_page", F.count("*").over(page)), keys, ["y", "x"], "y", gap, "_row")
    wide = placed.withColumn("_blocks", F.count("*").over(Window.partitionBy(*keys, "_row"))).where("_blocks >= 2 AND _page >= 4")
    ends = wide.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("_right"), F.max(F.col("y") + F.col("height")).alias("_low"), F.countDistinct("_row").alias("rows"), F.count("*").alias("blocks"))
    return ends.where("rows >= 2").select(*keys, "x", "y", (F.col("_right") - F.col("x")).alias("width"), (F.col("_low") - F.col("y")).alias("height"), "rows", "blocks")


def words_in_regions(words: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Words whose centre (whole-number halves) lies inside a region of the same page."""
    cx, cy = F.col("x") + F.floor(F.col("width") / 2), F.col("y") + F.floor(F.col("height") / 2)
    r = regions.select(*keys, "region_id", *[F.col(c).alias(f"r_{c}") for c in ("x", "y", "width", "height")])
    return words.join(r, keys).where(cx.between(F.col("r_x"), F.col("r_x") + F.col("r_width")) & cy.between(F.col("r_y"), F.col("r_y") + F.col("r_height"))).drop("r_x", "r_y", "r_width", "r_height")


def to_cells(words: DataFrame, keys: list[str], row: str, gap: float = 30) -> DataFrame:
    """Cells (row, column, text, confidence) of each page: a word goes to the last bound not right of its centre."""
    # the words of a page are a bounded group
    word = F.struct("x", "width", F.col(row).alias("row_no"), "text", "confidence")
    pages = words.groupBy(*keys).agg(F.collect_list(word).alias("_w"), F.array_sort(F.collect_set("x")).alias("_x"))
    # starts that begin a cluster, and the whole-number mean of each
    begins = F.filter("_x", lambda x, i: (i == 0) | (x - F.get("_x", i - 1) > gap))
    cluster = lambda b, i: F.filter("_x", lambda x: (x >= b) & F.coalesce(x < F.get("_b", i + 1), F.lit(True)))
    mean = lambda xs: F.floor(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))
    bounded = pages.withColumn("_b", begins).withColumn("_m", F.transform("_b", lambda b, i: mean(cluster(b, i))))
    centre = F.col("x") + F.floor(F.col("width") / 2)
    placed = bounded.select(*keys, "_m", F.inline("_w")).withColumn("col_no", F.greatest(F.size(F.filter("_m", lambda m: m <= centre)) - 1, F.lit(0)))
    return placed.groupBy(*keys, "row_no", "col_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("text"), F.avg("confidence").alias("confidence"),
    )


def grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with empty ones where a row has no word under a column."""
    # the cells of a page are a bounded group
    pages = cells.groupBy(*keys).agg(
        F.collect_set("row_no").alias("_r"), F.collect_set("col_no").alias("_c"), F.map_from_entries(F.collect_list(F.struct(F.struct("row_no", "col_no"), F.struct("text", "confidence")))).alias("_m")
    )
    spread = pages.select(*keys, "_c", "_m", F.explode("_r").alias("row_no")).select(*keys, "_m", "row_no", F.explode("_c").alias("col_no"))
    own = F.try_element_at("_m", F.struct("row_no", "col_no"))
    return spread.select(*keys, "row_no", "col_no", F.coalesce(own["text"], F.lit("")).alias("text"), F.coalesce(own["confidence"], F.lit(0.0)).alias("confidence"))


def table_regions(words: DataFrame, keys: list[str], row: str, least: float = 0.5) -> DataFrame:
    """Boxes of runs of rows of which each overlaps the one before in ``least`` of the narrower width; two rows at least."""
    box = words.groupBy(*keys, row).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("y0", row)
    overlap = F.least("x1", F.lag("x1").over(w)) - F.greatest("x0", F.lag("x0").over(w))
    narrow = F.least(F.col("x1") - F.col("x0"), F.lag("x1").over(w) - F.lag("x0").over(w))
    new = F.coalesce((F.coalesce(F.try_divide(overlap, narrow), F.lit(0.0)) < least).cast("int"), F.lit(0))
    first = F.row_number().over(w) == 1
    runs = box.withColumn("_new", F.when(first, 0).otherwise(new)).withColumn("region", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return runs.groupBy(*keys, "region").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("right"), F.max("y1").alias("bottom"), F.count("*").alias("rows"), F.min("n").alias("least_n"), F.max("n").alias("most_n")).where("rows >= 2 AND right - x >= 100 AND bottom - y >= 50 AND least_n / most_n >= 0.5").drop("least_n", "most_n")


def fragments(tables: DataFrame, least: float = 0.8) -> DataFrame:
    """(table_id, leader): tables of equal width of which ``least`` of the headers agree by place follow the first such.

    Equal lists of headers stand for one another. Lists of n that agree in ``least`` of their places differ in k at
    most; the places are dealt into k + 1 groups, of which one agrees whole, and is the key.
    """
    t = tables.select("table_id", F.transform("headers", lambda h: F.lower(F.trim(h))).alias("h"))
    lists = t.where(F.size("h") > 0).groupBy("h").agg(F.min("table_id").alias("first")).withColumn("n", F.size("h"))
    groups = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int") + 1
    group = lambda g: F.filter(F.col("h"), lambda _, i: i % groups == g)
    keys = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.when(~F.exists(group(g), lambda x: x.isNull()), F.to_json(group(g))))
    keyed = lists.select("h", "first", "n", F.posexplode(keys).alias("group", "key")).where("key IS NOT NULL")
    other = keyed.select(F.col("h").alias("g"), F.col("first").alias("leader"), "n", "group", "key")
    same = F.size(F.filter(F.arrays_zip("h", "g"), lambda p: p["h"] == p["g"]))
    pairs = keyed.join(other, ["n", "group", "key"]).where((F.col("leader") <= F.col("first")) & (same >= least * F.col("n") - 1e-9))
    lead = pairs.groupBy("h").agg(F.min("leader").alias("leader"))
    return t.join(lead, "h", "left").select("table_id", F.coalesce(F.least("leader", "table_id"), F.col("table_id")).alias("leader"))


def rectangular(tables: DataFrame, headers: list[str], cells: str = "cells") -> DataFrame:
    """Ragged rows to columns: short rows end in nulls, what is over is dropped."""
    return tables.select("*", *[F.get(cells, F.lit(i)).alias(h) for i, h in enumerate(headers)]).drop(cells)


# Words that make a cell of the first row a header.
HEADER_WORDS = (
    "name", "title", "description", "type", "category", "id", "number", "date", "time", "amount", "price", "cost", "total", "sum", "count",
    "quantity", "status", "state", "location", "address", "phone", "email",
)


def marked_headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with ``is_header``: those of row 0 that read like headers, else those that are set like them, else all filled ones.

    Like headers read cells with a header word, a final colon, or at most 20 letters and blanks that are no
    personal name; set like them are cells in capitals (two characters or more) or with every word begun by one.
    """
    t = F.trim("text")
    word = F.lit(False)
    for w in HEADER_WORDS:
        word = word | F.lower(t).contains(w)
    reads = (t != "") & (word | t.endswith(":") | ((F.length(t) <= 20) & ~t.rlike("^[A-Z][a-z]+ [A-Z][a-z]+$") & t.rlike(r"^[a-zA-Z\s]+$")))
    cased = F.upper(t) != F.lower(t)
    looks = cased & (((t == F.upper(t)) & (F.length(t) > 1)) | (t.rlike("[A-Z]") & ~t.rlike("[A-Za-z][A-Z]") & ~t.rlike("(^|[^A-Za-z])[a-z]")))
    over = Window.partitionBy(*keys)
    top = F.col("row_no") == 0
    judged = cells.withColumn("_a", top & reads).withColumn("_b", top & looks).withColumn("_any_a", F.bool_or("_a").over(over)).withColumn("_any_b", F.bool_or("_b").over(over))
    chosen = F.when(F.col("_any_a"), F.col("_a")).when(F.col("_any_b"), F.col("_b")).otherwise(top & (t != ""))
    return judged.withColumn("is_header", chosen).drop("_a", "_b", "_any_a", "_any_b")


def header_names(marked: DataFrame, keys: list[str]) -> DataFrame:
    """The name of each column up to the last header; Column_i where it has none."""
    heads = marked.where("is_header").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col_no", F.trim("text")))).alias("_h"), F.max("col_no").alias("_last"))
    spread = heads.select(*keys, "_h", F.explode(F.sequence(F.lit(0), F.col("_last").cast("int"))).alias("col_no"))
    own = F.nullif(F.try_element_at("_h", F.col("col_no")), F.lit(""))
    return spread.select(*keys, "col_no", F.coalesce(own, F.concat(F.lit("Column_"), (F.col("col_no") + 1).cast("string"))).alias("header"))


def merged_fragments(tables: DataFrame, rows: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows (table_id, row_no, cells) of matching fragments under their leader, numbered on, with the mean confidence of the fragments.

    ``tables``: table_id, headers and confidence.
    """
    led = fragments(tables, least).join(tables.select("table_id", "confidence"), "table_id")
    facts = led.groupBy("leader").agg(F.avg("confidence").alias("confidence"), F.count("*").alias("fragments"))
    own = rows.join(led.select("table_id", "leader"), "table_id")
    number = F.row_number().over(Window.partitionBy("leader").orderBy("table_id", "row_no")) - 1
    return own.select(F.col("leader").alias("table_id"), number.alias("row_no"), "cells", F.col("leader")).join(facts, "leader").drop("leader")


def union_of(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns differ; what a table lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sure_words(words: DataFrame, least: float = 0.3) -> DataFrame:
    """Words with a confidence above ``least`` (0 to 1) and some text."""
    return words.where((F.col("confidence") > least) & (F.trim("text") != ""))


def header_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Names of the columns from row 0; blank ones are Column_i."""
    return cells.where("row_no = 0").select(*keys, "col_no", F.when(F.trim("text") == "", F.concat(F.lit("Column_"), F.col("col_no").cast("string"))).otherwise(F.trim("text")).alias("header"))


def word_confidence(text: Column, confidence: Column, width: Column, height: Column) -> Column:
    """Recognition confidence adjusted by length, letters, odd patterns and shape, within 0..1."""
    letters = text.rlike("[aeiouAEIOU]") & text.rlike("[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]")
    odd = F.regexp_count(text, F.lit("[a-z][A-Z]")) + F.regexp_count(text, F.lit("[0-9][a-zA-Z]")) > 1
    shape = F.try_divide(width.cast("double"), height)
    factor = F.when(F.length(text) == 1, 0.8).when(F.length(text) == 2, 0.9).otherwise(1.0)
    factor = factor * F.when(letters, 1.1).otherwise(1.0) * F.when(odd, 0.9).otherwise(1.0) * F.when((shape > 20) | (shape < 0.1), 0.8).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence * factor))


def page_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """Mean word confidence scaled by the length of the text, the number of words and the spread, within 0..1."""
    facts = words.groupBy(*keys).agg(
        F.avg("confidence").alias("m"), F.stddev_pop("confidence").alias("s"), F.count("*").alias("n"), (F.sum(F.length(F.trim("text"))) + F.count("*") - 1).alias("chars")
    )
    factor = F.when(F.col("chars") > 10, 1.05).when(F.col("chars") < 3, 0.8).otherwise(1.0)
    factor = factor * F.when(F.col("n") > 5, 1.02).when(F.col("n") == 1, 0.9).otherwise(1.0)
    factor = factor * F.when(F.col("s") < 0.1, 1.05).when(F.col("s") > 0.3, 0.95).otherwise(1.0)
    return facts.select(*keys, F.col("n").alias("words"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m") * factor)).alias("confidence"))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


#: Fixed value: by how much the score of another engine must be higher to be preferred to the first.
DEAD_BAND = 0.05


def better_result(results: DataFrame, keys: list[str], engine: str = "engine", preferred: str | None = None) -> DataFrame:
    """The engine of the higher mean confidence plus a tenth of the relative length of its text.

    With a ``preferred`` engine, another one is only taken if its score is higher by more than DEAD_BAND.
    """
    longest = F.max("length").over(Window.partitionBy(*keys))
    score = F.col("confidence") + 0.1 * F.coalesce(F.try_divide(F.col("length").cast("double"), longest), F.lit(0.0))
    scored = results.withColumn("_s", score)
    if preferred is None:
        return scored.groupBy(*keys).agg(F.max_by(engine, F.struct("_s", engine)).alias("engine"), F.max("_s").alias("score"))
    best = scored.groupBy(*keys).agg(F.max(F.struct("_s", engine)).alias("best"), F.max(F.when(F.col(engine) == preferred, F.struct("_s", engine))).alias("own"))
    taken = F.when(F.col("best._s") - F.col("own._s") <= DEAD_BAND + 1e-12, F.col("own")).otherwise(F.col("best"))
    return best.select(*keys, taken[engine].alias("engine"), taken["_s"].alias("score"))


def structure_confidence(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of cell confidence (of cells that have some), evenness of filled cells a row, headers, and size.

    ``is_header``, if the cells have it, marks header cells.
    """
    sure = F.col("confidence") > 0
    head = F.col("is_header") if "is_header" in cells.columns else F.lit(False)
    rows = cells.groupBy(*keys, "row_no").agg(
        F.count_if(F.trim("text") != "").alias("n"), F.sum(F.when(sure, F.col("confidence"))).alias("c"), F.count_if(sure).alias("k"), F.max("col_no").alias("last"), F.bool_or(head).alias("head")
    )
    facts = rows.groupBy(*keys).agg(
        F.try_divide(F.sum("c"), F.sum("k")).alias("cell"), F.greatest(F.lit(0.0), F.coalesce(1 - F.try_divide(F.stddev_pop("n"), F.avg("n")), F.lit(0.0))).alias("even"),
        F.when(F.bool_or("head"), 0.8).otherwise(0.5).alias("headed"), F.count("*").alias("rows"), (F.max("last") + 1).alias("width"),
    )
    size = F.when(F.col("width") < 2, 0.5).when(F.col("rows") >= 3, 0.9).when(F.col("rows") >= 2, 0.7).otherwise(0.5)
    factors = F.array_compact(F.array(F.col("cell"), F.col("even"), F.col("headed"), size))
    return facts.select(*keys, F.least(F.lit(1.0), F.aggregate(factors, F.lit(0.0), lambda a, x: a + x) / F.size(factors)).alias("confidence"))
