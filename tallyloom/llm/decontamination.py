"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased (A-Z) runs of ASCII letters, digits and bytes outside ASCII, so that case,
punctuation and line breaks do not hide a copy. A document and an item that share seeds (windows of
``MIN_MATCH`` tokens) are candidates if the seeds cover enough of the item, which no tiling can
exceed. Candidates are tiled: the length of the longest common run of tokens not yet marked is found by
running Karp-Rabin with search lengths that close in on it, all runs of that length are marked in the order
of their places, and so on with the next length, until no run of ``MIN_MATCH`` tokens is left. Places
are never paired: equal windows share a queue of places in the document. Passages cut up and reordered are thus still covered. A document is contaminated by
an item if tiles cover ``THRESHOLD`` of the item's tokens.

Items go to the executors in blocks of about ``BLOCK_BYTES``, each of which is held against all
documents in turn, so that a benchmark of any size is tested by the same steps.

Defined results: items of fewer than ``MIN_MATCH`` tokens, null and empty ones too, are not tested;
items of one item_id and different texts are items of their own, equal rows are one item, and an item
without an id is tested like any other; null and empty documents share nothing; very long texts are
tested whole; repeated rows of a document give repeated pairs; of tiles of equal length the first of
the item, then of the document, is marked; an empty table on either side gives no pairs; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks
from .scratch import lookup

MIN_MATCH = 5
THRESHOLD = 0.8
#: Bytes of items that the executors hold at once, and the least that an item counts.
BLOCK_BYTES = 16 << 20
LEAST_ITEM = 64
PAIRS = "doc_id long, item_id long, item_tokens long, covered_tokens long, n_tiles long, coverage double"

_BREAK = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalnum():
        _BREAK[_b] = 32


def _tokens(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of texts: number of the first, bounds of the texts in tokens, token hashes."""
    for block in textblocks.blocks(texts, lower=True):
        block.data = _BREAK[block.data]
        spans = textblocks.words(block)
        yield block.first, spans.bounds, textblocks.word_hashes(block, spans)


# --- tiling -------------------------------------------------------------------------------------


def _windows(tokens: np.ndarray, marked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows without a marked token."""
    if len(tokens) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(marked)])
    starts = np.flatnonzero(taken[width:] == taken[:-width])
    return starts, textblocks.window_hashes(tokens, starts, width)


class _Sides:
    """The tokens of an item and a document, which of them are marked, and the windows both have unmarked."""

    def __init__(self, item: np.ndarray, doc: np.ndarray):
        self.item, self.doc = item, doc
        self.item_marked, self.doc_marked = np.zeros(len(item), bool), np.zeros(len(doc), bool)

    def common(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the item's windows that the document has too, and of those in the document."""
        a, ha = _windows(self.item, self.item_marked, width)
        b, hb = _windows(self.doc, self.doc_marked, width)
        in_item, in_doc = np.isin(ha, hb), np.isin(hb, ha)
        return a[in_item], ha[in_item], b[in_doc], hb[in_doc]

    def only(self, width: int) -> np.ndarray:
        """Leave what can be in a run of ``width``, and a marked token between the stretches; the places that are left."""
        _, _, b, _ = self.common(width)
        use = textblocks.covered(b, width, len(self.doc))
        left = np.flatnonzero(use | np.concatenate([[False], use[:-1]]))
        self.doc, self.doc_marked = self.doc[left], ~use[left]
        return left

    def longest(self, least: int, most: int) -> int:
        """The length of the longest common run, at most ``most``, or 0 if there is none of ``least``."""
        low, high = least - 1, most
        step = least
        while low < high:  # short runs are the rule: lengths double until one fails, and are halved from there
            width = min(step, high) if step else (low + high + 1) // 2
            if len(self.common(width)[0]):
                low, step = width, 2 * step
            else:
                high, step = width - 1, 0
        return low if low >= least else 0

    def mark(self, width: int) -> list[tuple[int, int]]:
        """Mark all runs of ``width``, by their place in the item, then in the document."""
        a, ha, b, hb = self.common(width)
        order = np.argsort(hb, kind="stable")
        places, hashes = b[order], hb[order]
        low, high = np.searchsorted(hashes, ha, "left").tolist(), np.searchsorted(hashes, ha, "right").tolist()
        next_of: dict[int, int] = {}  # of each hash, the first place that may still be free
        out = []
        free_from = 0
        for i, lo, hi in zip(a.tolist(), low, high, strict=True):
            if i < free_from:
                continue
            k = next_of.get(lo, lo)
            while k < hi:
                j = int(places[k])
                if not self.doc_marked[j : j + width].any() and (self.item[i : i + width] == self.doc[j : j + width]).all():
                    break
                k += 1
            next_of[lo] = k
            if k < hi:
                self.item_marked[i : i + width] = self.doc_marked[j : j + width] = True
                free_from = i + width
                out.append((i, j))
        return out


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, item start, document start), longest first, none overlapping."""
    sides = _Sides(item, doc)
    places = sides.only(least)
    tiles, most = [], min(len(item), len(sides.doc))
    while width := sides.longest(least, most):
        tiles += [(width, i, int(places[j])) for i, j in sides.mark(width)]
        most = width - 1
    return tiles


def _judged(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[int, int]:
    tiles = tile(item, doc, least)
    return sum(n for n, _, _ in tiles), len(tiles)


# --- items --------------------------------------------------------------------------------------


class Items:
    """Token hashes of the benchmark's items and where each seed occurs."""

    def __init__(self, rows: list[tuple], least: int):
        self.ids, self.tokens = [], []
        seeds, of, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, bounds, h in _tokens([t for _, t in rows]):
            for k in range(len(bounds) - 1):
                own = h[bounds[k] : bounds[k + 1]]
                if len(own) >= least:
                    starts = np.arange(len(own) - least + 1)
                    seeds.append(textblocks.window_hashes(own, starts, least))
                    of.append(np.full(len(starts), len(self.ids)))
                    at.append(starts)
                    self.ids.append(rows[first + k][0])
                    self.tokens.append(own)
        all_seeds, of, at = np.concatenate(seeds), np.concatenate(of), np.concatenate(at)
        order = np.argsort(all_seeds, kind="stable")
        self.seeds, self.of, self.at = all_seeds[order], of[order], at[order]
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Which of the seed hashes occur in an item."""
        maybe = np.flatnonzero(self.hint[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.seeds):
            return maybe[:0]
        k = np.minimum(np.searchsorted(self.seeds, h[maybe]), len(self.seeds) - 1)
        return maybe[self.seeds[k] == h[maybe]]

    def candidates(self, seeds: np.ndarray, least: int, threshold: float) -> list[int]:
        """Items of which the given seeds cover enough."""
        own = np.unique(seeds)
        low, high = np.searchsorted(self.seeds, own, "left"), np.searchsorted(self.seeds, own, "right")
        n = high - low
        shared = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = []
        for k in np.unique(self.of[shared]).tolist():
            starts = self.at[shared[self.of[shared] == k]]
            if textblocks.covered(starts, least, len(self.tokens[k])).sum() >= threshold * len(self.tokens[k]):
                out.append(k)
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of documents and benchmark items that they contain, with the tiles' coverage of the item."""
    return _pairs(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, least, threshold).drop("text_hash", "text_size")


def _blocks(benchmark: DataFrame, least: int) -> Iterator[list[tuple]]:
    """The distinct items that may hold ``least`` tokens, in blocks of about BLOCK_BYTES by hash."""
    size = F.octet_length("text")
    items = benchmark.select(F.col("item_id").cast("long"), "text").where(size >= 2 * least - 1).distinct()
    weight = items.agg(F.coalesce(F.sum(F.greatest(size, F.lit(LEAST_ITEM))), F.lit(0)).alias("b")).first()["b"]
    n = -(-weight // BLOCK_BYTES)
    for i in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == i).collect()]  # about BLOCK_BYTES


def _pairs(docs: DataFrame, benchmark: DataFrame, least: int, threshold: float) -> DataFrame:
    """PAIRS and hash and size of the document's text."""
    if least < 1 or not 0 < threshold <= 1:
        raise ValueError("a match has one token at least, a threshold is in (0, 1]")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("text_size"))
    schema = PAIRS + ", text_hash long, text_size int"
    out = None
    for items in _blocks(benchmark, least):
        found = rows.mapInPandas(_tester(docs.sparkSession.sparkContext.broadcast(Items(items, least)), least, threshold, schema), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _tester(table, least: int, threshold: float, schema: str):
    """Tiles the documents of a batch with the items of ``table`` (a broadcast) that they may contain."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Items = table.value
        for pdf in batches:
            rows = []
            for first, bounds, h in _tokens(pdf["text"]):
                starts = textblocks.window_starts(bounds, least)
                seeds = textblocks.window_hashes(h, starts, least)
                hit = known.hits(seeds)
                doc_of = np.searchsorted(bounds, starts[hit], "right") - 1
                for x in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(doc_of)) + 1):
                    if not len(x):
                        continue
                    d = int(doc_of[x[0]])
                    doc, row = h[bounds[d] : bounds[d + 1]], pdf.iloc[first + d]
                    for k in known.candidates(seeds[hit[x]], least, threshold):
                        n = len(known.tokens[k])
                        covered, tiles = _judged(known.tokens[k], doc, least)
                        if covered >= threshold * n:
                            rows.append((row["doc_id"], known.ids[k], n, covered, tiles, covered / n, row["text_hash"], row["text_size"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return test


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item; columns and other rows stay as they are.

    Each row is judged by its own text, whatever other rows of its doc_id hold and if it has none; null
    and empty texts stay; an empty table stays empty.
    """
    leaks = _pairs(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, MIN_MATCH, THRESHOLD)
    gone = lookup(leaks.select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash"), F.col("text_size").alias("_leak_size")).distinct(), "leaks")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_leak_id"]) & (F.xxhash64(docs["text"]) == gone["_leak_hash"]) & (F.octet_length(docs["text"]) == gone["_leak_size"])
    return docs.join(gone, same, "left_anti")


def brute_tile(item: list, doc: list, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """The tiles by looking for the longest run of unmarked tokens anew each time, for tests."""
    used_item, used_doc, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        run = [0] * (len(doc) + 1)  # of the item's next token: the length of the run that begins at each place
        for a in range(len(item) - 1, -1, -1):
            new = [0] * (len(doc) + 1)
            for b in range(len(doc) - 1, -1, -1):
                if item[a] == doc[b] and not used_item[a] and not used_doc[b]:
                    new[b] = run[b + 1] + 1
                    best = max(best, (new[b], -a, -b))
            run = new
        n, a, b = best[0], -best[1], -best[2]
        if n < least:
            return out
        used_item[a : a + n] = used_doc[b : b + n] = [True] * n
        out.append((n, a, b))


def brute_force(rows: list[tuple], items: list[tuple], least: int = MIN_MATCH, threshold: float = THRESHOLD) -> set:
    """(doc_id, item_id, covered_tokens) by tiling every pair with plain lists, for tests."""
    import re

    def split(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", low)

    out = set()
    for d, text in rows:
        doc = split(text)
        grams = {tuple(doc[k : k + least]) for k in range(len(doc) - least + 1)}
        for i, other in items:
            item = split(other)
            if len(item) < least or not any(tuple(item[k : k + least]) in grams for k in range(len(item) - least + 1)):
                continue
            covered = sum(n for n, _, _ in brute_tile(item, doc, least))
            if covered >= threshold * len(item):
                out.add((d, i, covered))
    return out
