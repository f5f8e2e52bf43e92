"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become ``FEATURES``, features become bins. Training goes round the features: in each turn a
shallow tree over the bins of one feature fits the gradient of the logistic loss and is added, at a
small step, to the feature's lookup table. Then the pairs whose quadrants explain most of what is
left get two-dimensional tables in the same way. A score is a sum of looked-up numbers.

Labels are learned from at most ``TRAIN_ROWS`` labelled doc_ids, those of the least hash, whose
crc32(doc_id) mod 5 is not 0; their features (a few numbers each) are all that reaches the driver.
Labels, lang, source and doc_id are not features.

Defined results: null and empty texts have features of zero and are scored; a null doc_id counts as
held out; without usable labels every score is 0.5; labels without a document, and null labels, are
passed over; a doc_id labelled twice counts with its larger label; of documents that repeat a doc_id
the text of the least hash is learned from, and every row is scored; very long texts are measured whole;
equal gains of two cuts take the earlier bin; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks
from .quality_rules import STOP_WORDS

TRAIN_ROWS = 30_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
STEP = 0.15
CUT = 0.3
FEATURES = (
    "log_words", "word_length", "symbols", "capitals", "digits", "marks", "other_punctuation", "beyond_ascii", "lines",
    "distinct_words", "doubled_words", "distinct_triples", "stop_words", "repeated_lines", "longest_word",
)


def _table(characters) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(characters)] = 1
    return out


_BYTES = (
    _table(b"#*$%&|<>"), _table(range(65, 91)), _table(range(48, 58)), _table(b"!?"),
    _table([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>!?"]), _table(range(128, 256)), _table(b"\n"),
)


def _stop_hashes() -> np.ndarray:
    block = next(textblocks.blocks([" ".join(STOP_WORDS)]))
    return np.sort(textblocks.word_hashes(block, textblocks.words(block)))


_STOP = _stop_hashes()


def _distinct_share(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each document the share of its items that are different."""
    keys = np.sort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    kinds = np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    return kinds / np.maximum(np.bincount(of, minlength=n), 1)


def features(texts) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = [np.zeros((0, len(FEATURES)), np.float32)]
    for block in textblocks.blocks(texts, lower=False):
        n = block.count
        begins = block.offsets[:-1]
        size = np.maximum(np.diff(block.offsets) - 1, 1)
        kinds = [np.add.reduceat(t[block.data], begins) for t in _BYTES]
        kinds[-1] = kinds[-1] - 1  # the line feed after each document
        low = textblocks.Block(block.first, textblocks.LOWER[block.data], block.offsets)
        spans = textblocks.words(low)
        words = np.diff(spans.bounds)
        per = np.maximum(words, 1)
        of = np.repeat(np.arange(n), words)
        h = textblocks.word_hashes(low, spans)
        length = spans.ends - spans.starts
        doubled = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=n)
        triples = textblocks.window_starts(spans.bounds, 3)
        place = np.minimum(np.searchsorted(_STOP, h), len(_STOP) - 1)
        longest = np.zeros(n)
        np.maximum.at(longest, of, length)
        feeds = np.flatnonzero(block.data == 10)
        line_starts = np.concatenate([[0], feeds[:-1] + 1]) if len(feeds) else feeds
        sums, downs = textblocks.prefix_hash(textblocks.BYTE_VALUES[0][block.data], textblocks.BASE)
        full = feeds > line_starts
        line_h = textblocks.mix((sums[feeds] - sums[line_starts]) * downs[line_starts])[full]
        line_of = (np.searchsorted(block.offsets, line_starts, "right") - 1)[full]
        out.append(np.stack([
            np.log1p(words), np.bincount(of, length, minlength=n) / per, kinds[0] / size, kinds[1] / size, kinds[2] / size, kinds[3] / size,
            kinds[4] / size, kinds[5] / size, kinds[6] / per, _distinct_share(h, of, n), doubled / per,
            _distinct_share(textblocks.window_hashes(h, triples, 3), np.searchsorted(spans.bounds, triples, "right") - 1, n),
            np.bincount(of[_STOP[place] == h], minlength=n) / per, 1 - _distinct_share(line_h, line_of, n), longest,
        ], axis=1).astype(np.float32))
    return np.concatenate(out)


# --- model --------------------------------------------------------------------------------------


class Model:
    """Edges of bins, one table per feature, and (i, j, table) for pairs; all sums of log odds."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: list):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = _binned(x, self.edges)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for i, j, table in self.pairs:
            total += table[bins[:, i] * PAIR_BINS // BINS, bins[:, j] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], axis=1)


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """The values of a shallow tree over consecutive bins with gradient and curvature sums g, h."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-6, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                left_g, left_h = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
                all_g, all_h = g[a:b].sum(), h[a:b].sum()
                gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), a + k + 1))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each axis."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best = (0.0, np.zeros_like(g))
    n, m = g.shape
    for a in range(1, n):
        for b in range(1, m):
            gain, value = 0.0, np.empty_like(g)
            for r0, r1 in ((0, a), (a, n)):
                for c0, c1 in ((0, b), (b, m)):
                    sg = cg[r1, c1] - cg[r0, c1] - cg[r1, c0] + cg[r0, c0]
                    sh = ch[r1, c1] - ch[r0, c1] - ch[r1, c0] + ch[r0, c0]
                    gain += _gain(sg, sh)
                    value[r0:r1, c0:c1] = _leaf(sg, sh)
            if gain > best[0]:
                best = (gain, value)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model from rows of features and labels of 0 and 1."""
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    tables = [np.zeros(BINS) for _ in range(width)]
    if len(np.unique(y)) < 2:
        return Model(base, edges, tables, [])
    bins = _binned(x, edges)
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            value = STEP * _tree(np.bincount(bins[:, j], g, BINS), np.bincount(bins[:, j], h, BINS))
            tables[j] += value
            total += value[bins[:, j]]
    coarse = bins * PAIR_BINS // BINS
    cell = lambda i, j: coarse[:, i] * PAIR_BINS + coarse[:, j]

    def grid(i, j, v):
        return np.bincount(cell(i, j), v, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    ranked = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for gain, i, j in ranked[:PAIRS] if gain > 1]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            g, h = slopes()
            value = STEP * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += value
            total += value.ravel()[cell(i, j)]
    return Model(base, edges, tables, pairs)


# --- Spark --------------------------------------------------------------------------------------


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents that are not held out."""
    chosen = (
        labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "h": pdf["h"], "x": list(features(pdf["text"]))})

    measured = texts.mapInPandas(measure, "doc_id long, quality int, h long, x array<float>")
    one = measured.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("x", "h").alias("x"))
    got = one.toPandas().sort_values("doc_id", kind="stable")  # at most ``rows`` rows
    x = np.array(got["x"].tolist(), np.float32).reshape(len(got), len(FEATURES))
    return fit(x, got["quality"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier) and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id"]].assign(score=shared.value.score(features(pdf["text"])))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double").select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels and score every document."""
    return scored(docs, train(docs, labels))
