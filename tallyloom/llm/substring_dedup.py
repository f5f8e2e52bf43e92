"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted over the corpus.

Two passes over evenly dealt parts of the documents. The first sends the distinct window hashes of
a part to the bucket of each hash, where the parts that hold it are counted; the second makes the
hashes again, reads off which windows occur elsewhere, merges repeated windows into maximal
intervals and removes their words. Hashes have 64 bits, and two hashes are only compared within a
bucket chosen by an independent second hash, so that the key grows with the corpus. At 100 TB, some
2e13 windows in 8e5 buckets, about ten windows in all are expected to be taken for repeated ones.

Defined results: null and empty texts have no words and lose none; a text shorter than a window
loses nothing; very long texts are judged whole; repeated rows, with a doc_id or without, are separate
documents, each of which loses what it shares with the other; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import exchange, textblocks
from .textblocks import encoded

WINDOW = 35
RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_text binary"


def _hashes(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of all windows of the texts, in order."""
    found = [(np.zeros(0, np.uint64),) * 2]
    for block in textblocks.blocks(texts):
        spans = textblocks.words(block)
        at = textblocks.window_starts(spans.bounds, width)
        if len(at):
            found.append(tuple(textblocks.window_hashes(textblocks.word_hashes(block, spans, seed), at, width) for seed in (0, 1)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _distinct(texts, width: int, buckets: int):
    h, other = _hashes(texts, width)
    values, bearer, counts, order = textblocks.distinct(h)
    return values, counts, order, exchange.by_bucket((other[bearer] % np.uint64(buckets)).astype(np.int32))


def removed_words(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Every document with the words left after repeated windows of ``width`` words are removed.

    A window goes if its word sequence also starts anywhere else, in the same document or another;
    windows are judged on the input. ``kept_text`` is UTF-8, words joined by one space.
    """
    if width < 1:
        raise ValueError("a window has one word at least")
    parts, _, buckets = exchange.in_parts(docs, "doc_id")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        values, _, _, routed = _distinct(pdf["text"], width, buckets)
        return exchange.messages(int(pdf["part"].iloc[0]), [(b, exchange.pack(values[x])) for b, x in routed])

    def remove(docs_pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs_pdf):
            return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
        values, counts, order, routed = _distinct(docs_pdf["text"], width, buckets)
        again = counts > 1
        answer = dict(zip(answers["bucket"], answers["payload"], strict=True))
        for b, x in routed:
            again[x] |= exchange.bits(answer[b], len(x))
        flags = np.empty(len(order), bool)
        flags[order] = np.repeat(again, counts)
        return pd.DataFrame(_without(docs_pdf, flags, width), columns=[c.split()[0] for c in RESULT.split(", ")])

    asked = parts.groupBy("part").applyInPandas(ask, exchange.MESSAGE)
    answers = asked.groupBy("bucket").applyInPandas(exchange.in_several, exchange.MESSAGE)
    return parts.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(remove, RESULT)


def _without(pdf: pd.DataFrame, flags: np.ndarray, width: int):
    """A row for each document; flags: of all its windows in order."""
    at = 0
    for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
        words = encoded(text).split()
        n = max(len(words) - width + 1, 0)
        starts = np.flatnonzero(flags[at : at + n])
        at += n
        removed = spans = 0
        if len(starts):
            gone = textblocks.covered(starts, width, len(words))
            removed = int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            words = list(compress(words, ~gone))
        yield doc_id, len(words) + removed, removed, spans, b" ".join(words)


def digest(kept: DataFrame) -> DataFrame:
    """The columns of query op8."""
    return kept.selectExpr("doc_id", "n_words", "n_removed", "n_spans", "sha2(kept_text, 256) AS kept_sha256")


def brute_force(rows: list[tuple], width: int = WINDOW) -> dict:
    """doc_id → (n_words, n_removed, kept_sha256) from all windows in a dictionary, for tests."""
    split = [(d, encoded(t).split()) for d, t in rows]
    count: dict[tuple, int] = {}
    for _, w in split:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            count[key] = count.get(key, 0) + 1
    out = {}
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out
