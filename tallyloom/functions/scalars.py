"""Scalar column functions: numbers, dates and formats in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats in the order in which they are tried.
DATE_FORMATS = (
    "yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy",
)
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TRUE_WORDS = ("true", "yes", "y", "1", "on")
FALSE_WORDS = ("false", "no", "n", "0", "off")


def squeeze(c: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def plain_double(c: Column) -> Column:
    """DOUBLE where the text is an ordinary number, else null ('nan', '1d' and 'Infinity' are not)."""
    return F.when(F.trim(c).rlike(PLAIN_NUMBER), F.expr("1.0D") * F.trim(c).try_cast("double"))


def number_from_text(c: Column) -> Column:
    """Number left after commas, dollar and percent signs are taken away."""
    return plain_double(F.regexp_replace(c, "[$%,]", ""))


def all_numbers(c: Column) -> Column:
    """Every number in a text, in order, as an array of doubles."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(-?[0-9]+\.?[0-9]*)"), F.lit(1)), lambda x: x.cast("double"))


_SHAPES = (("yyyy", "[0-9]{4}"), ("MMMM", "[A-Za-z]+"), ("MMM", "[A-Za-z]+"), ("MM", "[0-9]{2}"), ("dd", "[0-9]{2}"), ("M", "[0-9]{1,2}"), ("d", "[0-9]{1,2}"), ("HH", "[0-9]{2}"), ("mm", "[0-9]{2}"), ("ss", "[0-9]{2}"))


def date_shape(format_: str) -> str:
    """A pattern that every text of a date format has."""
    return "^" + re.sub("|".join(k for k, _ in _SHAPES), lambda m: dict(_SHAPES)[m.group()], re.escape(format_).replace("\\-", "-").replace("\\ ", " ")) + "$"


def parse_date(c: Column, formats=DATE_FORMATS) -> Column:
    """The date by the first format that fits; a format is only tried on texts of its shape, and none on texts that no date is like."""
    text = F.trim(c)
    like = F.length(text).between(6, 40) & text.rlike("[0-9][-/ ,:]|[-/ ][0-9]")
    return F.when(like, F.coalesce(*[F.when(text.rlike(date_shape(f)), F.try_to_date(text, f)) for f in formats]))


def parse_currency(c: Column) -> Column:
    return plain_double(F.regexp_replace(c, "[$€£¥₹,\\s]", ""))


def parse_percentage(c: Column) -> Column:
    return plain_double(F.regexp_replace(c, "[%\\s]", "")) / 100


def parse_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def date_format_of(c: Column) -> Column:
    """Name of the format that a date text has, or null."""
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), "%Y-%m-%d").when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), "%m/%d/%Y")
        .when(c.rlike(r"^\d{2}-\d{2}-\d{4}$"), "%m-%d-%Y").when(c.rlike(r"^\d{4}/\d{2}/\d{2}$"), "%Y/%m/%d")
    )


def file_size_text(c: Column) -> Column:
    """'0 B', '1.5 KB', '3.0 MB' and so on."""
    out = F.when(c == 0, "0 B")
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        out = out.when(c < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", c / F.lit(1024.0**power)))
    return out.otherwise(F.format_string("%.1f TB", c / F.lit(1024.0**4)))


def kpi_text(value: Column, kind: str = "number") -> Column:
    """K and M suffixes, currency and percent signs for a KPI value."""
    if kind == "percentage":
        return F.format_string("%.1f%%", value)
    sign = "$" if kind == "currency" else ""
    return (
        F.when(F.abs(value) >= 1e6, F.concat(F.lit(sign), F.format_string("%.1f", value / 1e6), F.lit("M")))
        .when(F.abs(value) >= 1e3, F.concat(F.lit(sign), F.format_string("%.1f", value / 1e3), F.lit("K")))
        .otherwise(F.concat(F.lit(sign), F.format_string("%.2f", value)))
    )


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, '<>:"/\\|?*', "_________"), r"^[. ]+|[. ]+$", "")


def sane_name(c: Column) -> Column:
    """Lower-case identifier made of letters, digits and single underscores."""
    base = F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_]", "_"), "_+", "_")
    base = F.regexp_replace(base, "^_|_$", "")
    return F.lower(F.when(base == "", "column").when(base.rlike("^[0-9]"), F.concat(F.lit("col_"), base)).otherwise(base))


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of the JSON of the columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def encrypted(c: Column, key: Column) -> Column:
    """Base64 of AES-GCM; each call has its own initialisation vector."""
    return F.base64(F.aes_encrypt(c.cast("binary"), key, F.lit("GCM")))


def decrypted(c: Column, key: Column) -> Column:
    """The text again, or null if the key or the data is wrong."""
    return F.try_aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")


def endpoint_class(path: Column) -> Column:
    out = F.when(path.contains("upload"), "upload")
    for name in ("export", "chat", "dashboard"):
        out = out.when(path.contains(name), name)
    return out.otherwise("api")


def weighted_confidence(scores: Column) -> Column:
    """Aggregate: each score weighs as much as it says."""
    return F.coalesce(F.try_divide(F.sum(scores * scores), F.sum(scores)), F.lit(0.0))


def trend_text(direction: Column) -> Column:
    """increasing, decreasing, stable or volatile; stable for anything else."""
    return F.when(direction == "UP", "increasing").when(direction == "DOWN", "decreasing").when(direction == "VOLATILE", "volatile").otherwise("stable")


def comparison_text(kind: Column, difference: Column, percent: Column, improved: Column) -> Column:
    """'increased by 5.0%', or how far above or below a target a value lies."""
    size = F.format_string("%.1f%%", F.abs(percent))
    moved = F.concat(F.when(difference > 0, "increased by ").otherwise("decreased by "), size)
    target = F.when(improved, F.concat(F.lit("Target exceeded by "), F.format_string("%.1f%%", percent))).otherwise(F.concat(F.lit("Below target by "), size))
    return F.when(percent.isNull(), "No comparison available").when(kind == "target", target).otherwise(moved)


# Words in a column's name that say how its values are written.
CURRENCY_WORDS = ("revenue", "sales", "price", "cost", "profit", "income", "fee")
PERCENT_WORDS = ("rate", "percent", "ratio")


def format_kind(name: Column, most: Column) -> Column:
    """currency by the column's name, percentage by name or where no value exceeds 1, else number."""
    has = lambda words: sum((F.lower(name).contains(w).cast("int") for w in words), F.lit(0)) > 0
    return F.when(has(CURRENCY_WORDS), "currency").when(has(PERCENT_WORDS) | (most <= 1.0), "percentage").otherwise("number")


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps in one; the right one wins."""
    left, right = F.coalesce(left, F.create_map().cast("map<string,string>")), F.coalesce(right, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
