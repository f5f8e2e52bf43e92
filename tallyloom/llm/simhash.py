"""SimHash near-dedup with pigeonring filtering.

Fingerprints are reduced to distinct ones, which are the nodes. The 64 bits form a
ring of five segments. If two fingerprints differ in at most two bits, then (pigeonring principle)
from some segment on, every chain of consecutive segments differs in no more than its share of the
budget: chains of 1..5 segments in at most 0, 0, 1, 1, 2 bits. Two whole equal segments are thus
the join key; the longer chains prune what meets there before the full Hamming check. Members of a
key are compared in tasks of bounded blocks, and each task returns a spanning forest of the links it
found, never all pairs. Components come from large-star / small-star rounds on the links.

Defined results: null, empty and white-space texts have no words and the fingerprint zero, which
links like any other; very long texts are read whole; repeated rows and equal texts share a
fingerprint; rows without a doc_id link like any other and belong to the component of the smallest doc_id
that they reach, null if none of it has one; a bit that exactly half the shingles set is 0; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks
from .components import component_ids
from .scratch import staged

SHINGLE = 3
BITS = 2
SEGMENTS = (13, 13, 13, 13, 12)
KEY_BITS = 26
#: Members of a key that are compared at once; a key with more is dealt into pairs of such blocks.
MEMBERS = 2048


def shingle_hashes(texts, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts, the hashes of all shingles and how many of them each text has."""
    for block in textblocks.blocks(texts, lower=True):
        spans = textblocks.words(block)
        counts = np.diff(spans.bounds)
        # words again, one space apart: a shingle is then one slice
        white = textblocks.WHITE[block.data]
        keep = ~white
        keep[spans.ends] = True
        data = np.where(white, np.uint8(32), block.data)[keep].tobytes()
        lengths = spans.ends - spans.starts
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(lengths) else lengths
        ends = starts + lengths
        room = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
        first = np.repeat(spans.bounds[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
        last = np.minimum(first + width - 1, np.repeat(spans.bounds[1:] - 1, room))
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(data[a:b], 42) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)], np.uint64)
        yield h, room


def _simhashes(texts, width: int) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text."""
    return np.concatenate([np.zeros(0, np.uint64), *[majority(h, room) for h, room in shingle_hashes(texts, width)]])


def majority(h: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each run of ``room`` hashes, the bits set in over half of them."""
    prints = np.zeros(len(room), np.uint64)
    full = np.flatnonzero(room)
    if not len(full):
        return prints
    begins = np.concatenate([[0], np.cumsum(room[full])[:-1]])
    planes = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(planes, begins, axis=0, dtype=np.int32)
    over = 2 * ones > room[full][:, None]
    prints[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return prints


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and print (the fingerprint as a signed long) of every document."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "print": _simhashes(pdf["text"], width).view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(make, "doc_id long, print long")


def _segment_starts() -> list[int]:
    return [sum(SEGMENTS[:i]) for i in range(len(SEGMENTS))]


def _keys(column: str) -> F.Column:
    """For each segment, its number above the bits of it and the next one."""
    out = []
    for i, at in enumerate(_segment_starts()):
        j = (i + 1) % len(SEGMENTS)
        key = F.lit(0).cast("long")
        for k, start in ((i, at), (j, _segment_starts()[j])):
            piece = F.shiftrightunsigned(column, start).bitwiseAND(F.lit((1 << SEGMENTS[k]) - 1).cast("long"))
            key = F.shiftleft(key, SEGMENTS[k]).bitwiseOR(piece)
        out.append(key.bitwiseOR(F.lit(i << KEY_BITS).cast("long")))
    return F.array(*out)


def _chain_viable(diff: np.ndarray, first: int, bits: int) -> np.ndarray:
    """Whether every chain of segments from ``first`` on stays within its share of ``bits``."""
    m, starts = len(SEGMENTS), _segment_starts()
    total = np.zeros(diff.shape, np.int64)
    ok = np.ones(diff.shape, bool)
    for length in range(1, m + 1):
        k = (first + length - 1) % m
        total += np.bitwise_count((diff >> np.uint64(starts[k])) & np.uint64((1 << SEGMENTS[k]) - 1))
        ok &= total <= length * bits // m
    return ok


def _forest(prints: np.ndarray, side: np.ndarray, first: int, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among one block (side 0) or between two."""
    root = list(range(len(prints)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    within = not len(right)
    out = []
    for n, i in enumerate(left.tolist()):
        others = left[n + 1 :] if within else right
        diff = prints[others] ^ prints[i]
        near = others[_chain_viable(diff, first, bits)]
        for j in near[np.bitwise_count(prints[near] ^ prints[i]) <= bits].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((i, j))
    return out


def dealt(seeds: DataFrame) -> DataFrame:
    """The members (key, name, ...) of every key of several, sorted by (key, pair), with their side in the pair.

    A key of more than ``MEMBERS`` is dealt into blocks; a member of block b meets block c in the pair
    (min, max) of them.
    """
    sizes = seeds.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    grouped = seeds.join(sizes, "key").withColumn("_pieces", F.ceil(F.col("_n") / MEMBERS).cast("int"))
    own = F.pmod(F.xxhash64("name"), F.col("_pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_other")
    pair = F.least("_own", "_other").cast("long") * F.col("_pieces") + F.greatest("_own", "_other")
    met = grouped.withColumn("_own", own).select("*", other).select(*seeds.columns, pair.alias("pair"), (F.col("_own") > F.col("_other")).cast("int").alias("side"))
    return met.repartition("key", "pair").sortWithinPartitions("key", "pair")


def blocks_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole runs of equal (key, pair) from batches sorted by them."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        same = (pdf["key"] == pdf["key"].iloc[-1]) & (pdf["pair"] == pdf["pair"].iloc[-1])
        cut = int(same.to_numpy().argmax())
        rest = pdf.iloc[cut:]
        if cut:
            yield pdf.iloc[:cut]
    if rest is not None and len(rest):
        yield rest


def links(named: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (src, dst) that connect all fingerprints within ``bits`` of each other.

    ``named`` has one row (name, print) for each distinct fingerprint.
    """
    if not 0 <= bits < len(SEGMENTS) / 2:
        raise ValueError("two equal segments are only certain for at most two bits")
    seeds = named.select("name", "print", F.explode(_keys("print")).alias("key"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in blocks_in(batches):
            key, pair = pdf["key"].to_numpy(), pdf["pair"].to_numpy()
            names, prints, side = pdf["name"].to_numpy(), pdf["print"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            found = []
            for x in np.split(np.arange(len(key)), cuts):
                first = int(key[x[0]]) >> KEY_BITS
                found += [(names[x[i]], names[x[j]]) for i, j in _forest(prints[x], side[x], first, bits)]
            yield pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return dealt(seeds).mapInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    prints = staged(fingerprints(docs, width), "prints")
    nodes = staged(prints.groupBy("print").agg(F.min("doc_id").alias("least")).withColumn("name", F.col("print")), "names")
    component = component_ids(links(nodes.select("name", "print"), bits))
    labelled = nodes.join(component, nodes["name"] == component["node"], "left").select("print", "least", F.coalesce("component", "name").alias("label"))
    first = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = staged(labelled.join(first, "label").select("print", "component_id"), "components")
    return prints.join(by_print, "print", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def brute_force(rows: list[tuple], width: int = SHINGLE, bits: int = BITS) -> list[tuple]:
    """(doc_id, fingerprint, component_id) of each row (doc_id, text) by comparing all pairs, for tests."""
    prints = []
    for _, text in rows:
        w = bytes(textblocks.LOWER[np.frombuffer(textblocks.encoded(text), np.uint8)]).split()
        shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return [(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, components_of([d for d, _ in rows], prints, bits), strict=True)]


def components_of(ids: list, prints: list[int], bits: int = BITS) -> list:
    """The smallest id, null if there is none, that each fingerprint reaches by links of all pairs, for tests."""
    comp = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for d, c in zip(ids, comp, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return [least.get(c) for c in comp]
