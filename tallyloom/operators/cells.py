"""Jobs on the long cell table (table_id, row_no, col_no, header, value): checks, corrections, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cell patterns by type, any case, in the order that breaks ties.
CELL_TYPES = (
    ("NUMBER", (r"^\d+$", r"^\d+\.\d+$", r"^-?\d+\.?\d*$", r"^\d{1,3}(,\d{3})*(\.\d+)?$")),
    ("DATE", (r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^[A-Za-z]{3}\s+\d{1,2},?\s+\d{4}$")),
    ("BOOLEAN", (r"^(true|false)$", r"^(yes|no)$", r"^(y|n)$", r"^(1|0)$")),
    ("CURRENCY", (r"^\$\d+\.?\d*$", r"^\d+\.?\d*\s*(USD|EUR|GBP)$", r"^[€£¥]\d+\.?\d*$")),
    ("PERCENTAGE", (r"^\d+\.?\d*%$", r"^0\.\d+$")),
)
# Letters that recognition mistakes for digits.
LOOKALIKES = (("O", "0"), ("l", "1"), ("I", "1"), ("S", "5"), ("G", "6"), ("B", "8"))
# What looks wrong in a cell.
SUSPICIOUS = (r"[0-9][a-zA-Z][0-9]", r"[a-zA-Z][0-9][a-zA-Z]", r"[Il1]{2,}", r"[O0]{3,}", r"[^\p{L}\p{N}_\s.,;:!?()-]")
NUMERIC = ("NUMBER", "CURRENCY", "PERCENTAGE")
LONG_HEADER = 50


def type_pattern(kind: str) -> str:
    """One pattern for a type."""
    return "(?i)" + "|".join(f"(?:{p})" for p in dict(CELL_TYPES)[kind])


def column_types(cells: DataFrame) -> DataFrame:
    """The type that most, and at least half, of a column's filled cells have, else TEXT."""
    v = F.trim("value")
    facts = cells.where(v != "").groupBy("table_id", "col_no").agg(*[F.avg(v.rlike(type_pattern(k)).cast("double")).alias(k) for k, _ in CELL_TYPES])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("share"), F.lit(-i).alias("place"), F.lit(k).alias("kind")) for i, (k, _) in enumerate(CELL_TYPES)]))
    return facts.select("table_id", "col_no", F.when(best["share"] >= 0.5, best["kind"]).otherwise("TEXT").alias("data_type"))


def suspicious(value: Column) -> Column:
    return value.rlike("|".join(SUSPICIOUS))


def off_type(value: Column, kind: Column) -> Column:
    """Whether a filled value is none of its column's type; any text is TEXT."""
    out = F.lit(False)
    for k, _ in CELL_TYPES:
        out = out | ((kind == k) & ~value.rlike(type_pattern(k)))
    return out


def suggestion(value: Column, kind: Column) -> Column:
    """The value as it should read, by the type of its column, or null if it stays.

    Look-alike letters of numeric columns become digits; white space is trimmed and squeezed; numbers
    lose inner spaces and all but the last of several dots, amounts all but digits, marks and symbols.
    """
    letters, digits = ("".join(x) for x in zip(*LOOKALIKES, strict=True))
    read = F.when(kind.isin(*NUMERIC), F.translate(value, letters, digits)).otherwise(value)
    squeezed = F.trim(F.regexp_replace(read, r"\s+", " "))
    number = (
        F.when(squeezed.rlike(r"^\d+ \d+$"), F.replace(squeezed, F.lit(" "), F.lit("")))
        .when(squeezed.rlike(r"^[^,]*\.[^,.]*\.[^,.]{0,2}$"), F.regexp_replace(squeezed, r"\.(?=.*\.)", ""))
        .otherwise(squeezed)
    )
    tidy = F.when(kind == "NUMBER", number).when(kind == "CURRENCY", F.regexp_replace(squeezed, r"[^\d.,$€£¥]", "")).otherwise(squeezed)
    return F.when((F.trim(value) != "") & (tidy != value), tidy)


def checks(cells: DataFrame) -> DataFrame:
    """Suggestion, confidence and issues of every filled cell."""
    typed = cells.join(column_types(cells), ["table_id", "col_no"], "left").where(F.trim("value") != "")
    v = F.trim("value")
    judged = typed.select(
        "table_id", "row_no", "col_no", "value", "data_type", suggestion(F.col("value"), F.col("data_type")).alias("suggested"),
        off_type(v, F.col("data_type")).alias("off"), suspicious(F.col("value")).alias("odd"),
    )
    factor = lambda test, by: F.when(test, by).otherwise(1.0)
    proposed = F.col("suggested").isNotNull()
    issues = F.array_compact(F.array(F.when(proposed, F.lit("suggestion")), F.when(F.col("off"), F.lit("off_type")), F.when(F.col("odd"), F.lit("suspicious"))))
    return judged.select(
        "table_id", "row_no", "col_no", "value", "data_type", "suggested",
        (factor(proposed, 0.8) * factor(F.col("off"), 0.7) * factor(F.col("odd"), 0.8)).alias("confidence"), F.array_join(issues, ",").alias("issues"),
    )


def structure(cells: DataFrame) -> DataFrame:
    """Structural facts of each table, and how many structural and quality issues they make.

    Structural: under two columns, ragged rows, repeated headers, empty headers. Quality: generic
    headers, each overlong or untrimmed header, each column of which over a tenth is off its type,
    empty rows, repeated rows.
    """
    cell = F.lower(F.trim("value"))
    rows = cells.groupBy("table_id", "row_no").agg(
        F.count("*").alias("n"), F.count_if(F.trim("value") != "").alias("filled"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", cell.alias("v")))), lambda x: x["v"]), "|").alias("signature"),
    )
    # equal rows meet first, so that no distinct list is held for a table
    kinds = rows.groupBy("table_id", "signature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_if(F.col("filled") == 0).alias("empty"))
    body = kinds.groupBy("table_id").agg(
        F.sum("k").alias("rows"), F.max("hi").alias("most"), F.min("lo").alias("least"), F.sum("empty").alias("empty_rows"), (F.sum("k") - F.count("*")).alias("duplicate_rows"),
    )
    names = cells.select("table_id", "col_no", "header").distinct()
    heads = names.groupBy("table_id").agg(
        F.count("*").alias("width"), F.count_if(F.trim("header") == "").alias("empty_headers"), (F.count("*") - F.countDistinct(F.lower(F.trim("header")))).alias("duplicate_headers"),
        F.count_if(F.col("header").startswith("Column_")).alias("generic_headers"),
        (F.count_if(F.length(F.trim("header")) > LONG_HEADER) + F.count_if(F.trim("header") != F.col("header"))).alias("untidy_headers"),
    )
    filled = cells.where(F.trim("value") != "").join(column_types(cells), ["table_id", "col_no"])
    mixed = filled.groupBy("table_id", "col_no").agg((F.count_if(off_type(F.trim("value"), F.col("data_type"))) > 0.1 * F.count("*")).cast("int").alias("mixed")).groupBy("table_id").agg(F.sum("mixed").alias("mixed_columns"))
    joined = body.join(heads, "table_id").join(mixed, "table_id", "left").na.fill(0, ["mixed_columns"])
    ragged = (F.col("most") != F.col("width")) | (F.col("least") != F.col("width"))
    one = lambda c: (F.col(c) > 0).cast("long")
    return joined.select(
        "table_id", "rows", "width", "empty_rows", "duplicate_rows", ragged.alias("ragged"), "empty_headers", "duplicate_headers", "generic_headers", "untidy_headers", "mixed_columns",
        ((F.col("width") < 2).cast("long") + ragged.cast("long") + one("duplicate_headers") + one("empty_headers")).alias("structure_issues"),
        (one("generic_headers") + F.col("untidy_headers") + F.col("mixed_columns") + one("empty_rows") + one("duplicate_rows")).alias("quality_issues"),
    )


def score(cells: DataFrame, confidence: DataFrame) -> DataFrame:
    """Table confidence less 0.2, 0.1 and 0.05 for each structural, quality and cell issue; valid from 0.7 without the first."""
    bad = checks(cells).groupBy("table_id").agg(F.count_if(F.col("issues") != "").alias("cell_issues"))
    joined = confidence.join(structure(cells), "table_id").join(bad, "table_id", "left").na.fill(0, ["cell_issues"])
    value = F.greatest(F.lit(0.0), F.col("confidence") - F.col("structure_issues") * F.lit(0.2) - F.col("quality_issues") * F.lit(0.1) - F.col("cell_issues") * F.lit(0.05))
    return joined.select("table_id", value.alias("score"), "structure_issues", "quality_issues", "cell_issues", ((value >= 0.7 - 1e-12) & (F.col("structure_issues") == 0)).alias("valid"))


def corrected(cells: DataFrame, corrections: DataFrame) -> DataFrame:
    """Cells with the latest correction of each (action replace, blank or delete_row); rows numbered anew.

    Corrections refer to the table as it was.
    """
    w = Window.partitionBy("table_id", "row_no", "col_no").orderBy(F.desc("seq"))
    latest = corrections.where("action <> 'delete_row'").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("table_id", "row_no", "col_no", "action", "new_value")
    gone = corrections.where("action = 'delete_row'").select("table_id", "row_no").distinct()
    kept = cells.join(gone, ["table_id", "row_no"], "left_anti").join(latest, ["table_id", "row_no", "col_no"], "left")
    value = F.when(F.col("action") == "replace", F.col("new_value")).when(F.col("action") == "blank", "").otherwise(F.col("value"))
    number = F.dense_rank().over(Window.partitionBy("table_id").orderBy("row_no")) - 1 + F.min("row_no").over(Window.partitionBy("table_id"))
    return kept.select("table_id", number.cast("int").alias("row_no"), "col_no", "header", value.alias("value"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells that differ by place, missing equal to missing, and those that one version alone has."""
    place = ["table_id", "row_no", "col_no"]
    o, n = old.select(*place, F.col("value").alias("old_value"), F.lit(True).alias("_o")), new.select(*place, F.col("value").alias("new_value"), F.lit(True).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed")
    both = o.join(n, place, "full_outer").where(F.col("_o").isNull() | F.col("_n").isNull() | ~F.col("old_value").eqNullSafe(F.col("new_value")))
    return both.select(*place, "old_value", "new_value", kind.alias("change"))


def shapes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows and columns of each table in both versions."""
    size = lambda df, tag: df.groupBy("table_id").agg((F.max("row_no") + 1).alias(f"{tag}_rows"), (F.max("col_no") + 1).alias(f"{tag}_columns"))
    return size(old, "old").join(size(new, "new"), "table_id", "full_outer").na.fill(0)


def correction_status(log: DataFrame) -> DataFrame:
    """Accepted, rejected and open corrections of each session, and the confidence they add."""
    return log.groupBy("session_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("state") == "accepted").alias("accepted"), F.count_if(F.col("state") == "rejected").alias("rejected"),
        F.count_if(~F.col("state").isin("accepted", "rejected")).alias("open"), F.least(F.lit(0.3), F.count_if(F.col("state") == "accepted") * F.lit(0.05)).alias("gain"),
    )


def split_span(df: DataFrame, key: str) -> DataFrame:
    """Word boxes of a text span (text, x, width), shared out by the length of the words."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    total = F.aggregate("ws", F.lit(0), lambda a, w: a + F.length(w))
    spread = df.withColumn("ws", words).withColumn("chars", total).select(key, "x", "width", "chars", F.posexplode("ws").alias("place", "word"))
    before = F.coalesce(F.sum(F.length("word")).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = F.col("width") * 0.02 * F.col("place")
    return spread.select(key, "place", "word", (F.col("x") + F.floor(F.col("width") * before / F.col("chars") + gap)).cast("int").alias("x"), F.floor(F.col("width") * F.length("word") / F.col("chars")).cast("int").alias("width"))


def sanity(pages: DataFrame, key: str) -> DataFrame:
    """Flags of a page result (text, confidence)."""
    special = F.try_divide(F.regexp_count("text", F.lit(r"[^A-Za-z0-9_ \n\t.,!?-]")).cast("double"), F.length("text"))
    return pages.select(key, (F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), (F.col("confidence") < 0.3).alias("doubtful"), F.coalesce((F.length("text") > 100) & (special > 0.2), F.lit(False)).alias("garbled"))
