"""The corpus pipeline: rules, near-dedup, repeated spans, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of their input; the last returns the ids of each remaining text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import byte_bpe, decontamination, near_copies, quality_rules, suffix_dedup
from tallyloom.llm.scratch import staged

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Whole texts that go to Python at once, and may be long.
ROWS_AT_ONCE = "1000"


def _in_small_batches(spark: SparkSession) -> SparkSession:
    """The session, which hands whole texts to Python in batches that fit beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    return spark


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Each row is judged by its own text: null, empty and white texts go, very long ones are measured whole,
    repeated rows and those without a doc_id are judged like any other; an empty table stays empty; other
    columns, whatever their names, stay as they are.
    """
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id.

    SimHash fingerprints within two bits meet first, pairs that they miss by keys of the sets; groups are
    linked by a similarity of 0.8 or more over sets of five-word shingles. Texts without
    words are copies of each other; rows with one doc_id and one text stay or go together; a null
    doc_id counts as the largest; very long texts are compared whole; an empty table stays empty.
    """
    _in_small_batches(spark)
    return near_copies.keep_first(docs)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that documents of smaller doc_id hold are cut out of the texts.

    Each row loses what smaller doc_ids hold of its own text, and rows of one doc_id take nothing from
    each other; rows without a doc_id are the smallest and stay as they are, null and empty texts too; very
    long texts are judged whole; an empty table stays empty; ``n_chars`` counts anew, other columns stay.
    """
    return suffix_dedup.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Each row is judged by its own text, whole, with or without a doc_id; null and empty texts stay; items
    that share an id are tested each, those of fewer than five tokens are not; equal tiles take the first
    place; an empty table on either side leaves the documents as they are; other columns stay.
    """
    return decontamination.without_leaks(docs, _in_small_batches(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, their digest and the digest of the bytes that they decode to.

    Null and empty texts have no ids; very long texts are encoded whole; every row, repeated ones and those
    without a doc_id too, gives a row; an empty table gives none; other columns are left out.
    """
    _in_small_batches(spark)
    return byte_bpe.with_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", span_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: Hashes, tiles and merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None
