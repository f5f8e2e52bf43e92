"""Personal data: detection, classification, masking, registry, retention and access decisions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Patterns, confidence and category, in the order in which masking takes them.
PATTERNS = (
    ("card", r"\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b", 0.9), ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.95),
    ("phone", r"\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b", 0.8), ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.9),
    ("ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", 0.7), ("name", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", 0.6),
)
#: Days that data is kept; permanent is for ever.
RETENTION = {"short": 30, "medium": 365, "long": 2555}


def counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """How many hits of each kind a text has."""
    return df.select(key, *[F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).alias(f"n_{k}") for k, p, _ in PATTERNS])


#: Hits that leave a task together.
HITS_AT_ONCE = 4096


HIT = "kind string, value string, first int, last int, confidence double"


def _packed(keys: pa.Array, hits: list[tuple]) -> pa.RecordBatch:
    rows, *columns = zip(*hits, strict=True)
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), *map(pa.array, columns, kinds)], names=["key", *[c.split()[0] for c in HIT.split(", ")]])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits of (key, text), one text after another, so that a task holds one batch and few hits."""
    found = [(k, re.compile(p), c) for k, p, c in PATTERNS]
    for batch in batches:
        out: list[tuple] = []
        for i, text in enumerate(batch.column(1)):
            text = text.as_py()
            for k, p, c in found if isinstance(text, str) else ():
                for m in p.finditer(text):
                    out.append((i, k, m.group(), m.start(), m.end(), c))
                    if len(out) == HITS_AT_ONCE:
                        yield _packed(batch.column(0), out)
                        out = []
        if out:
            yield _packed(batch.column(0), out)


def spans(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every hit with its place and confidence."""
    asked = df.select(F.col(key).alias("key"), F.col(text))
    made = StructType([asked.schema[0], *StructType.fromDDL(HIT)])
    return asked.mapInArrow(_hits, made).withColumnRenamed("key", key)


def classification(text: str, kind: str = "other") -> Column:
    """RESTRICTED over 0.8, CONFIDENTIAL for any hit, INTERNAL for documents and tables, else PUBLIC."""
    c = F.col(text)
    strong, weak = [F.lit(False)], [F.lit(False)]
    for _, p, confidence in PATTERNS:
        (strong if confidence > 0.8 else weak).append(F.coalesce(c.rlike(p), F.lit(False)))
    any_of = lambda xs: F.array_contains(F.array(*xs), True)
    rest = "INTERNAL" if kind in ("document", "table", "extracted_data") else "PUBLIC"
    return F.when(any_of(strong), "RESTRICTED").when(any_of(weak), "CONFIDENTIAL").otherwise(rest)


def masked(text: str) -> Column:
    """[CARD_REDACTED] and so on, one kind after another."""
    out = F.col(text)
    for k, p, _ in PATTERNS:
        out = F.regexp_replace(out, p, f"[{k.upper()}_REDACTED]")
    return out


def registry(df: DataFrame, key: str, user: str, text: str, created: str, retention: str) -> DataFrame:
    """classification, personal-data flag, expiry and whether to encrypt, for each record."""
    level = classification(text, "document")
    days = F.create_map(*[x for k, v in RETENTION.items() for x in (F.lit(k), F.lit(v))])
    return df.select(
        key, user, level.alias("classification"), level.isin("RESTRICTED", "CONFIDENTIAL").alias("has_pii"), F.col(retention).alias("retention"),
        F.expr(f"timestampadd(DAY, 0, {created})").alias("created_at"), F.date_add(F.to_date(created), days[F.col(retention)]).alias("expires_on"), level.isin("RESTRICTED").alias("encrypted"),
    )


def retained(rows: DataFrame, today: Column, expires: str = "expires_on") -> DataFrame:
    """Without what has expired; no date means for ever."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) >= today))


def access_decisions(requests: DataFrame, records: DataFrame, key: str, today: Column) -> DataFrame:
    """allowed and reason per request (request_id, key, purpose); unknown records are denied."""
    known = F.col("classification").isNotNull()
    reason = (
        F.when(~known, "unknown record").when(F.col("expires_on") < today, "expired").when(F.col("has_pii") & ~F.col("consent"), "no consent")
        .when(~F.array_contains("purposes", F.col("purpose")), "purpose not allowed").otherwise("granted")
    )
    return requests.join(records, key, "left").select("request_id", key, (reason == "granted").alias("allowed"), reason.alias("reason"))


def report(rows: DataFrame) -> DataFrame:
    """Records by classification, all levels present, with personal and encrypted ones."""
    levels = rows.sparkSession.createDataFrame([(x,) for x in ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "RESTRICTED")], "classification string")
    found = rows.groupBy("classification").agg(F.count("*").alias("records"), F.count_if("has_pii").alias("pii"), F.count_if("encrypted").alias("encrypted"))
    return levels.join(found, "classification", "left").na.fill(0)


def compliance(rows: DataFrame, today: Column) -> DataFrame:
    """records, pii, encrypted, expired, pii_encryption_rate % (100 without personal data) and expired_present: one row."""
    pii, encrypted = F.count_if("has_pii"), F.count_if("encrypted")
    facts = rows.agg(F.count("*").alias("records"), pii.alias("pii"), encrypted.alias("encrypted"), F.count_if(F.col("expires_on") < today).alias("expired"))
    return facts.withColumn("pii_encryption_rate", F.coalesce(F.try_divide(F.col("encrypted") * 100.0, F.col("pii")), F.lit(100.0))).withColumn("expired_present", F.col("expired") > 0)


def retention_counts(rows: DataFrame) -> DataFrame:
    """Records by retention, all kinds present."""
    kinds = rows.sparkSession.createDataFrame([(k,) for k in (*RETENTION, "permanent")], "retention string")
    return kinds.join(rows.groupBy("retention").agg(F.count("*").alias("records")), "retention", "left").na.fill(0)


def subject_export(rows: DataFrame, user: str, value) -> DataFrame:
    return rows.where(F.col(user) == value)
