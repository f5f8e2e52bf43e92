"""Asking the whole corpus about hashes, with packed messages instead of one row per hash.

Documents are dealt into parts of bounded size. A part reduces its own hashes to distinct sorted
ones and sends them, packed, to the bucket of each. A bucket answers each message with one value
per hash, in the order of the message, and the part, which makes the same hashes again, reads the
answers off. A key that a third of all documents holds costs one entry per part, not per document.

Parts and buckets grow with the square root of the corpus, up to a bound that a task can hold, so that
messages stay long: 1 TB of text makes 16 384 parts of 64 MB and 8 192 buckets, and a part of ten
million word windows sends over 1 000 hashes a message. At 100 TB it is about ten a message, each of
five bytes beside some fifty of overhead.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES = 16 << 20
MOST_PART_BYTES = 64 << 20
#: Bytes of text that one bucket answers for.
BUCKET_BYTES = 8 << 20
MOST_BUCKET_BYTES = 128 << 20
LEAST_BYTES = 1 << 20
#: Corpus from which on parts and buckets grow.
GROWS_FROM = 1 << 30
MESSAGE = "part int, bucket int, payload binary"


def sizes(total: int, asked: int) -> tuple[int, int]:
    """How many parts and buckets a corpus of ``total`` bytes has where a session asks for some partitions."""
    grown = math.sqrt(max(1.0, total / GROWS_FROM))
    parts = max(1, math.ceil(total / min(PART_BYTES * grown, MOST_PART_BYTES)), min(asked, math.ceil(total / LEAST_BYTES)))
    # a bucket's bound grows faster, so that messages stay long once parts are as large as they get
    buckets = max(1, math.ceil(total / min(BUCKET_BYTES * grown * grown, MOST_BUCKET_BYTES)), min(2 * asked, math.ceil(2 * total / LEAST_BYTES)))
    return parts, buckets


def in_parts(docs: DataFrame, *columns: str) -> tuple[DataFrame, int, int]:
    """Documents with an evenly dealt ``part``, and the numbers of parts and buckets.

    The bytes decide: parts have at most about PART_BYTES, and no fewer than LEAST_BYTES where the
    session asks for more partitions. A row is dealt by doc_id, text and the input partition that it
    comes from, so that copies of one row, or rows without a doc_id, spread over the parts as the input
    does, and a task that runs again deals alike.
    """
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n, buckets = sizes(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int").alias("part")
    return docs.select(*columns, "text", part), n, buckets


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as their first and fixed-width differences."""
    if not len(values):
        return struct.pack("<IBQ", 0, 0, 0)
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    body = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return struct.pack("<IBQ", len(values), width, int(values[0])) + body


def unpack(payload: bytes) -> np.ndarray:
    n, width, first = struct.unpack_from("<IBQ", payload)
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.zeros((n, 8), np.uint8)
    raw[1:, :width] = np.frombuffer(payload, np.uint8, offset=13).reshape(-1, width)
    steps = raw.view("<u8").ravel().astype(np.uint64)
    steps[0] = first
    return np.cumsum(steps, dtype=np.uint64)


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, indices in it, ascending) for each bucket that occurs."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[x[0]]), x) for x in np.split(order, cuts)]


def messages(part: int, rows: list[tuple[int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"part": np.full(len(rows), part, np.int32), "bucket": np.array([b for b, _ in rows], np.int32), "payload": [p for _, p in rows]})


def in_several(pdf: pd.DataFrame) -> pd.DataFrame:
    """The answer of a bucket: for each hash, a bit that says if another part sent it too."""
    sent = [unpack(p) for p in pdf["payload"]]
    again = repeated(np.concatenate(sent), 2)
    out = [np.packbits(among(values, again)).tobytes() for values in sent]
    return pd.DataFrame({"part": pdf["part"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "payload": out})


def repeated(values: np.ndarray, least: int) -> np.ndarray:
    """The values that occur ``least`` times or more, ascending."""
    s = np.sort(values)
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[at[np.diff(np.append(at, len(s))) >= least]]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values occur in ``known``, which ascends."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def bits(payload: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8), count=n).astype(bool)
