"""Exact dedup over a persistent index of digests, bucketed and sorted by hash, with Spark joins alone.

A text's digest is the SHA-256 of the text with every run of ``\\x20 \\x09-\\x0D`` replaced by one space. The
index is a Parquet table in a shared folder, bucketed and sorted by digest, with one row (digest, keep_id,
batch) for each distinct text. A new batch is reduced to its distinct digests, meets the index by a
sort-merge anti-join that does not shuffle the index, and what is new is written once and then appended. A
batch that is appended again adds nothing.

Of equal texts the row of the smallest doc_id of the first batch that holds one stays; later batches only
lose rows to it. Digests of many rows are sent to all tasks (fewer than ``MOST_HOT`` can have more than a
``MOST_HOT``-th of all rows), so that no key gathers in one task.

Defined results: a null text counts as empty; empty texts are equal to each other, and texts of white space
to a single space; very long texts are read whole; a null doc_id counts as the largest; of rows that repeat a
doc_id and a text one stays, and which one does not show; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_folder, staged

WHITE = "[ \\t-\\r]+"
MOST_HOT = 1 << 16
#: Bytes of an index row, and how many a bucket should hold.
ROW_BYTES = 48
BUCKET_BYTES = 64 << 20
#: In how many batches, by ascending doc_id, the query hands the table to its index.
BATCHES = 2


def digest_of(text: Column) -> Column:
    """The 32 bytes of SHA-256 of a text."""
    return F.unhex(F.sha2(text, 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest and row (a number of the row) of every document."""
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), WHITE, " ")
    return docs.select(F.col("doc_id").cast("long"), digest_of(normal).alias("digest"), F.monotonically_increasing_id().alias("row"))


def with_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """The rows beside the columns of their group; ``groups`` has one row for each key, with ``n`` members of ``total``."""
    bound = max(1, total // MOST_HOT)
    hot = F.broadcast(groups.where(F.col("n") > bound))  # fewer than MOST_HOT groups can be that large
    rest = rows.join(F.broadcast(groups.where(F.col("n") > bound).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(groups.where(F.col("n") <= bound).hint("merge"), key))


class DigestIndex:
    """The index in ``path``; it is made with ``buckets`` buckets if it is not there yet."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            self.buckets = spark.read.schema("buckets int").parquet(f"{self.path}/spec").first()["buckets"]
        except AnalysisException:
            self.buckets = buckets
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.path}/spec")
        self.name = f"digests_{hashlib.md5(self.path.encode()).hexdigest()}"
        self._register()

    def _register(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )

    def rows(self) -> DataFrame:
        """digest, keep_id and batch of every distinct text so far."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add the digests of ``rows`` (doc_id, digest, row) that the index does not hold yet."""
        new = _firsts(rows).join(self.rows().hint("merge"), "digest", "left_anti")
        # written before the index changes, so that a lost executor does not hold the batch against itself
        fresh = staged(new.select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(batch).alias("batch")), "fresh")
        writer = fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def decided(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """doc_id, digest, keep_id, group_size (among ``rows``) and kept of rows that the index has seen.

        With ``batch``, rows only stay if it was this batch that brought their text.
        """
        groups = _firsts(rows).join(self.rows().hint("merge"), "digest")
        stays = F.col("first.doc_id").eqNullSafe(F.col("keep_id"))
        if batch is not None:
            stays &= F.col("batch") == batch
        facts = staged(groups.select("digest", "keep_id", "n", F.when(stays, F.col("first.row")).alias("kept_row")), "groups")
        return with_groups(rows, facts, "digest", rows.count()).select(
            "doc_id", "digest", "keep_id", F.col("n").alias("group_size"), F.col("row").eqNullSafe(F.col("kept_row")).alias("kept")
        )

    def compacted(self, path: str) -> DigestIndex:
        """The same index in a new folder, with one sorted file for each bucket, however many batches made it."""
        out = DigestIndex(self.spark, path, self.buckets)
        writer = self.rows().repartition(self.buckets, "digest").write.mode("append").format("parquet")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(out.name)
        return out


def _firsts(rows: DataFrame) -> DataFrame:
    """digest, n and first (unnamed, doc_id, row) of each distinct digest."""
    return rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first"), F.count("*").alias("n"))


def new_documents(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The documents whose text the index has not seen, which it then holds; their columns stay as they are.

    Rows that repeat a doc_id and a text stay or go together here.
    """
    rows = staged(digests(docs), "digests")
    index.append(rows, batch)
    keep = index.decided(rows, batch).where("kept").select(F.struct("doc_id", "digest").alias("_kept"))
    normal = F.regexp_replace(F.coalesce(docs["text"], F.lit("")), WHITE, " ")
    same = docs["doc_id"].cast("long").eqNullSafe(keep["_kept.doc_id"]) & (digest_of(normal) == keep["_kept.digest"])
    return docs.join(keep, same, "left_semi")


def _batches(rows: DataFrame, count: int) -> Iterator[DataFrame]:
    """Rows by ascending ranges of doc_id, those without one last."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        yield rows
        return
    step = (high - low) // count + 1
    for k in range(count):
        within = (F.col("doc_id") >= low + k * step) & (F.col("doc_id") < low + (k + 1) * step)
        yield rows.where(within | F.col("doc_id").isNull() if k == count - 1 else within)


def deduplicated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The columns of query op11: all documents against a new index that takes them in batches, the smallest doc_ids first."""
    spark = docs.sparkSession
    rows = staged(digests(docs), "digests")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() * ROW_BYTES / BUCKET_BYTES))
    index = DigestIndex(spark, new_folder(spark, "index"), buckets)
    for k, part in enumerate(_batches(rows, batches)):
        index.append(part, str(k))
    return index.decided(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
WITH normal AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM normal"""


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, text_sha256) of rows (doc_id, text) in order, for tests."""
    normal = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups: dict[str, list] = {}
    for k, t in enumerate(normal):
        groups.setdefault(t, []).append((rows[k][0] is None, rows[k][0] or 0, k))
    out = []
    for k, t in enumerate(normal):
        first = min(groups[t])
        out.append((rows[k][0], rows[first[2]][0], len(groups[t]), k == first[2], hashlib.sha256(t.encode()).hexdigest()))
    return out
