"""SimHash near-dedup at a Jaccard similarity of 0.8 over five-word shingles, as the pipeline's stage takes it.

Near copies are found by SimHash with pigeonring filtering (``simhash.links``). At a similarity of 0.8 fingerprints
differ in ten bits on average, though, so that no segment of them is certain to agree. What fingerprints leave open is
therefore completed by the same filter on the sets themselves, where the bound is certain: sets of a and b shingles
have a similarity of 0.8 or more exactly if they differ in at most (a + b) / 9 shingles.

1. Each document is the set of 64-bit hashes of its shingles. Documents of equal sets are one node. The majority of
   each bit over the hashes is the node's fingerprint. Fingerprints within two bits meet by pigeonring chains, those
   that step 4 rules out go, and the components of what is left are settled: steps 3 and 4 look for nothing inside them.
2. Sizes fall into bands, and a band sets how many differences, d, its pairs may have. The shingles of a set are
   dealt by hash into more than d segments of a ring, and a segment is reduced to the sum of its hashes. d
   differences spoil at most d segments: similar sets agree in a segment that is not empty, which is the key. Keys
   travel packed to the bucket of each, without sets.
3. A bucket answers with the pairs of a key of few nodes. A key of many, or of which one run of documents alone has
   many, has its members dealt into pairs of bounded blocks. Nodes that fingerprints have settled are not paired again.
4. Each set has a parity fingerprint of some two bits a shingle, in which every shingle flips one bit. Its
   Hamming distance is never more than the number of differences, so that a distance over (a + b) / 9 rules a pair
   out for certain. It does so for nearly all that is not similar.
5. The components of what is left, by either fingerprint, are groups outside which nothing can be similar. Their sets
   are sent to their group, large groups in pairs of blocks, and compared whole. Links are pairs that reach 0.8.

No step depends on chance: hashes of 64 bits stand for shingles, and apart from that all links are found.

Defined results: null, empty and white-space texts have the empty set and are copies of each other; a
text of fewer than five words is one shingle; shingles that repeat count once; very long texts are compared whole;
of a component the row of the smallest doc_id stays, a null doc_id counting as the largest, and of one doc_id the
text of the smallest hash; rows with one doc_id and one text stay or go together; an empty table gives no rows;
other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash, textblocks
from .components import component_ids
from .scratch import give_back, giving_back, lookup, small_batches, staged

SHINGLE = 5
#: Bytes of text that a bucket of keys answers for.
BUCKET_BYTES = 64 << 20
#: Members of a block that are compared at once, and the bytes of their sets.
MEMBERS = 2048
BLOCK_BYTES = 32 << 20
#: Nodes of a key that are paired by its bucket, and nodes of one run of texts from which on a key is dealt into blocks.
FEW, HOT = 32, 64
MESSAGE = "bucket int, nodes binary, counts binary, keys binary, hot binary, far_keys binary, far_nodes binary"


def _sets(texts) -> Iterator[np.ndarray]:
    """The ascending set of shingle hashes of each text."""
    for block in textblocks.blocks(texts, lower=True):
        spans = textblocks.words(block)
        words = textblocks.word_hashes(block, spans)
        starts = textblocks.window_starts(spans.bounds, SHINGLE)
        hashes = textblocks.window_hashes(words, starts, SHINGLE)
        cuts = np.searchsorted(starts, spans.bounds).tolist()
        bounds = spans.bounds.tolist()
        for k in range(block.count):
            n = bounds[k + 1] - bounds[k]
            if 0 < n < SHINGLE:
                yield textblocks.window_hashes(words, np.array([bounds[k]]), n)
            else:
                yield np.unique(hashes[cuts[k] : cuts[k + 1]])


# --- keys ---------------------------------------------------------------------------------------


def _bands(most: int) -> np.ndarray:
    """The least size of each band: a set that is similar to a smaller one lies in the same band or the next."""
    out = [1, 2]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, 5 * (out[-1] - 1) // 4 + 1))
    return np.array(out)


def _segments(bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each band as that of the smaller set: how many shingles a pair may differ in, and how many segments there are."""
    largest = bands[1:] - 1
    differ = (largest + 5 * largest // 4) // 9
    return differ, np.where(differ == 0, 1, -(-12 * (differ + 1) // 10))


def ring_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key): similar sets have a key in common."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bands = _bands(int(sizes.max(initial=1)) * 2)
    differ, segments = _segments(bands)
    h = np.concatenate([np.zeros(0, np.uint64), *sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    place, value = textblocks.mix(h ^ np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32), textblocks.mix(h ^ np.uint64(0x9E3779B97F4A7C15))
    own = np.searchsorted(bands, sizes, "right") - 1
    found = []
    for space in (own, own - 1):  # as the smaller of a pair, and as the larger one of the band below
        use = (sizes > 0) & (space >= 0)
        m = np.where(use, segments[np.maximum(space, 0)], 0)
        first = np.concatenate([[0], np.cumsum(m)])
        keep = use[of]
        slot = first[of[keep]] + (place[keep] % np.maximum(m, 1)[of[keep]].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(first[-1], np.uint64)
        np.add.at(sums, slot, value[keep])
        filled = np.bincount(slot, minlength=first[-1]) > 0
        owner = np.repeat(np.arange(len(sets)), m)
        # with more than d segments that are not empty the others are not needed
        enough = np.bincount(owner, filled, len(sets)) > differ[np.maximum(space, 0)]
        chosen = filled | ~enough[owner]
        at = (np.arange(first[-1]) - first[owner]).astype(np.uint64)
        band = np.maximum(space, 0)[owner].astype(np.uint64)
        key = textblocks.mix(sums + textblocks.mix(band * np.uint64(0x100000001B3) + at + np.uint64(1)))
        found.append((owner[chosen], key[chosen]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


#: Bytes of text whose keys are made at once.
KEYED_BYTES = 4 << 20


def _keyed(texts, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, node) of runs of texts, nodes as half of their mark, each node once."""
    sets: list[np.ndarray] = []
    marks: list[int] = []
    seen: set[int] = set()
    size = 0
    for one in _sets(texts):
        mark = xxhash.xxh3_128_intdigest(one.tobytes()) & (2**64 - 1)
        if len(one) and mark not in seen:
            seen.add(mark)
            sets.append(one)
            marks.append(mark)
            size += 8 * len(one)
            if size > at_once:
                owner, key = ring_keys(sets)
                yield key, np.array(marks, np.uint64)[owner]
                sets, marks, size = [], [], 0
    if sets:
        owner, key = ring_keys(sets)
        yield key, np.array(marks, np.uint64)[owner]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(key)))


def _five(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def _messages(buckets: int, hot_from: int, at_once: int):
    """Of runs of texts, for every bucket: nodes, how many keys of it each has, the keys, which keys are hot, and members of those of any bucket."""

    def packed(key: np.ndarray, node: np.ndarray) -> pd.DataFrame:
        bucket = key % np.uint64(buckets)
        key = key >> np.uint64(24)
        order = np.lexsort((key, bucket))
        key, node, bucket = key[order], node[order], bucket[order]
        starts, lengths = _runs((key << np.uint64(24)) | bucket)
        hot = np.repeat(lengths > hot_from, lengths)
        marked = starts[lengths > hot_from]
        far_key, far_node = (key[hot] << np.uint64(24)) | bucket[hot], node[hot]
        mark_key, mark_bucket = key[marked], bucket[marked]
        key, node, bucket = key[~hot], node[~hot], bucket[~hot]
        order = np.lexsort((node, bucket))
        key, node, bucket = key[order], node[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for b in range(buckets):
            starts, lengths = _runs(node[cuts[b] : cuts[b + 1]])
            own = mark_key[mark_bucket == b]
            far = slice(b, None, buckets)  # members of hot keys go by any bucket
            if len(starts) or len(own) or len(far_key[far]):
                names = node[cuts[b] : cuts[b + 1]][starts]
                rows.append((b, names.tobytes(), lengths.astype("<u4").tobytes(), _five(key[cuts[b] : cuts[b + 1]]), _five(own), far_key[far].tobytes(), far_node[far].tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGE.split(", ")])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, node in _keyed(pdf["text"], at_once):
                yield packed(key, node)
        give_back()

    return make


def _meetings(few: int):
    """What meets in a bucket: pairs (kind 0) of nodes, and members (kind 1: key, node) of keys that are dealt into blocks."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, nodes, hot, far = [], [], [], []
        for names, counts, five, marks, far_keys, far_nodes in pdf[["nodes", "counts", "keys", "hot", "far_keys", "far_nodes"]].itertuples(index=False):
            nodes.append(np.repeat(np.frombuffer(names, np.uint64), np.frombuffer(counts, "<u4")))
            keys.append(_from_five(five))
            hot.append(_from_five(marks))
            far.append(np.stack([np.frombuffer(far_keys, np.uint64), np.frombuffer(far_nodes, np.uint64)], axis=1))
        key, node, hot = np.concatenate(keys), np.concatenate(nodes), np.unique(np.concatenate(hot))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[once], node[once]
        starts, lengths = _runs(key)
        dealt = (lengths > few) | np.isin(key[starts], hot)
        many = np.repeat(dealt, lengths)
        members = np.stack([(key[many] << np.uint64(24)) | np.uint64(pdf["bucket"].iat[0]), node[many]], axis=1)
        pairs = [np.zeros((0, 2), np.uint64)]
        for n in np.unique(lengths[~dealt & (lengths > 1)]).tolist():  # keys of equally many nodes at once
            group = node[starts[~dealt & (lengths == n)][:, None] + np.arange(n)]
            one, two = np.triu_indices(n, 1)
            pairs.append(np.stack([group[:, one].ravel(), group[:, two].ravel()], axis=1))
        two = np.unique(np.concatenate(pairs), axis=0)
        out = np.concatenate([two, members, *far]).view(np.int64)
        return pd.DataFrame({"kind": np.repeat(np.array([0, 1], np.int32), [len(two), len(out) - len(two)]), "a": out[:, 0], "b": out[:, 1]})

    return meet


# --- comparison ---------------------------------------------------------------------------------


def parity_bits(n: int) -> int:
    """The width of the fingerprint of a set of ``n``."""
    return max(64, 1 << (2 * n - 1).bit_length()) if n else 64


def parity(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Fingerprints of which each shingle flips one bit, as rows of 64-bit words."""
    sizes = np.array([len(s) for s in sets])
    at = (textblocks.mix(np.concatenate([np.zeros(0, np.uint64), *sets])) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount(np.repeat(np.arange(len(sets)), sizes) * bits + at, minlength=len(sets) * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(len(sets), bits), axis=1, bitorder="little").view("<u8")


def folded(print_: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint at a smaller width: what that of the set at this width is."""
    while len(print_) > words:
        half = len(print_) // 2
        print_ = print_[:half] ^ print_[half:]
    return print_


def _possible(prints: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, settled: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within one block (side 0), or between two, whose fingerprints do not rule them out.

    Members of one number in ``settled`` are connected already.
    """
    within = not (side == 1).any()
    order = np.argsort(sizes, kind="stable")
    ends = np.searchsorted(sizes[order], 5 * sizes[order] // 4, "right").tolist()
    widths = np.array([len(p) for p in prints])
    root, out = np.arange(len(prints)) if settled is None else settled.copy(), []
    at, table, place_of = -1, None, None
    for place, i in enumerate(order.tolist()):
        later = order[place + 1 : ends[place]]
        later = later[(root[later] != root[i]) & (within | (side[later] != side[i]))]
        if not len(later):
            continue
        if at != widths[i]:  # sizes ascend, and so do widths: those of this one and the next at this width
            at = widths[i]
            use = np.flatnonzero((widths == at) | (widths == 2 * at))
            table = np.stack([folded(prints[k], at) for k in use.tolist()])
            place_of = np.full(len(prints), -1)
            place_of[use] = np.arange(len(use))
        differ = np.bitwise_count(table[place_of[later]] ^ table[place_of[i]]).sum(axis=1)
        for j in later[differ <= (sizes[later] + sizes[i]) // 9].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _ruled_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose fingerprints do not rule them out."""
    for pdf in batches:
        keep = np.zeros(len(pdf), bool)
        for k, (m, n, p, q) in enumerate(zip(pdf["m"].tolist(), pdf["n"].tolist(), pdf["p"], pdf["q"], strict=True)):
            if 5 * min(m, n) >= 4 * max(m, n):
                a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                words = min(len(a), len(b))
                keep[k] = np.bitwise_count(folded(a, words) ^ folded(b, words)).sum() <= (m + n) // 9
        yield pdf.loc[keep, ["src", "dst"]]


def _maybe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of each whole run of (key, pair) of members with fingerprints."""
    for pdf in simhash.blocks_in(batches):
        key, pair, side, node, n, settled = (pdf[c].to_numpy() for c in ("key", "pair", "side", "name", "n", "settled"))
        found = []
        for x in np.split(np.arange(len(key)), np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1):
            prints = [np.frombuffer(pdf["held"].iat[k], np.uint64) for k in x.tolist()]
            found += [(node[x[i]], node[x[j]]) for i, j in _possible(prints, n[x].astype(np.int64), side[x], settled[x])]
        yield pd.DataFrame(found, columns=["src", "dst"], dtype="int64").drop_duplicates()


def similar_forest(sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of similarity 0.8 or more within one block (side 0), or between two."""
    sizes = np.array([len(s) for s in sets])
    prints = parity(sets, parity_bits(int(np.median(sizes)) if len(sizes) else 1))
    within = not (side == 1).any()
    order = np.argsort(sizes, kind="stable")
    root = np.arange(len(sets))
    out = []
    _, codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(len(codes) + 1, bool)
    ends = np.searchsorted(sizes[order], 5 * sizes[order] // 4, "right").tolist()
    for place, i in enumerate(order.tolist()):
        later = order[place + 1 : ends[place]]  # as large or larger, and not too large
        later = later[(root[later] != root[i]) & (within | (side[later] != side[i]))]
        if not len(later):
            continue
        most = (sizes[later] + sizes[i]) // 9
        later = later[np.bitwise_count(prints[later] ^ prints[i]).sum(axis=1) <= most]
        if not len(later):
            continue
        mine = codes[cuts[i] : cuts[i + 1]]
        held[mine] = True
        for j in later.tolist():
            if root[j] != root[i] and 9 * int(held[codes[cuts[j] : cuts[j + 1]]].sum()) >= 4 * (sizes[i] + sizes[j]):
                root[root == root[j]] = root[i]
                out.append((i, j))
        held[mine] = False
    return out


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each whole run of (key, pair)."""
    for pdf in simhash.blocks_in(batches):
        key, pair, side, node = (pdf[c].to_numpy() for c in ("key", "pair", "side", "name"))
        found = []
        for x in np.split(np.arange(len(key)), np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1):
            sets = [np.frombuffer(pdf["held"].iat[k], np.uint64) for k in x.tolist()]
            found += [(node[x[i]], node[x[j]]) for i, j in similar_forest(sets, side[x])]
        yield pd.DataFrame(found, columns=["src", "dst"], dtype="int64")


def _dealt(members: DataFrame) -> DataFrame:
    """Members (key, name, held, ...) by key, sorted, with pair and side; keys of too many for a block as pairs of blocks."""
    sizes = members.groupBy("key").agg(F.count("*").alias("_n"), F.sum(F.octet_length("held")).alias("_bytes")).where("_n > 1")
    pieces = F.greatest(F.ceil(F.col("_n") / MEMBERS), F.ceil(F.col("_bytes") / BLOCK_BYTES)).cast("int")
    grouped = members.join(sizes.select("key", pieces.alias("_pieces")), "key").withColumn("_own", F.pmod(F.xxhash64("name"), F.col("_pieces")).cast("int"))
    met = grouped.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    pair = F.least("_own", "_other").cast("long") * F.col("_pieces") + F.greatest("_own", "_other")
    sided = met.select(*members.columns, pair.alias("pair"), (F.col("_own") > F.col("_other")).cast("int").alias("side"))
    return sided.repartition("key", "pair").sortWithinPartitions("key", "pair")


# --- documents ----------------------------------------------------------------------------------


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"))


def _entries(docs: DataFrame) -> DataFrame:
    """Of every row: doc_id, text hash and size, mark (m1 and m2), size n, SimHash and parity fingerprint of its set."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            marks, sizes, prints, votes = [], [], [], []
            for one in _sets(pdf["text"]):
                marks.append(xxhash.xxh3_128_intdigest(one.tobytes()))
                sizes.append(len(one))
                prints.append(parity([one], parity_bits(len(one))).tobytes())
                votes.append(int(simhash.majority(one, np.array([len(one)]))[0]))
            low = np.array([m & (2**64 - 1) for m in marks], np.uint64).view(np.int64)
            high = np.array([m >> 64 for m in marks], np.uint64).view(np.int64)
            yield pdf[["doc_id", "h", "size"]].assign(m1=low, m2=high, n=sizes, vote=np.array(votes, np.uint64).view(np.int64), print=prints)
        give_back()

    return _rows(docs).mapInPandas(make, "doc_id long, h long, size int, m1 long, m2 long, n int, vote long, print binary")


_FIRST = ("unnamed", "doc_id", "h", "size")


def _nodes(entries: DataFrame) -> DataFrame:
    """node (a number), mark, n and the first row (unnamed, doc_id, h, size) of each distinct set."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "size")
    sets = entries.groupBy("m1", "m2").agg(F.min(row).alias("row"), F.first("n").alias("n"))
    return sets.select(F.monotonically_increasing_id().alias("node"), "m1", "m2", "n", "row.*")


def _with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Members (key, name, n, held: the set) of the rows that stand for the nodes of ``wanted``; rows that are alike come more than once."""
    at = lookup(wanted.select("key", "node", F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("size").alias("_s")), "wanted")
    rows = _rows(docs).join(at, F.expr("doc_id <=> _d AND h = _h AND size <=> _s")).select("key", F.col("node").alias("name"), "text")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = list(_sets(pdf["text"]))
            yield pdf[["key", "name"]].assign(n=[len(s) for s in sets], held=[s.tobytes() for s in sets])
        give_back()

    return rows.mapInPandas(make, "key long, name long, n int, held binary")


def simhash_links(prints: DataFrame) -> DataFrame:
    """Pairs (src, dst) of sets (m1, n, print, vote) whose SimHash fingerprints lie within two bits of each other.

    Of each fingerprint the first set stands for the others, and pairs that the parity fingerprints rule out go.
    """
    votes = staged(prints.groupBy("vote").agg(F.min("m1").alias("least")), "votes")
    near = simhash.links(votes.select(F.col("vote").alias("name"), F.col("vote").alias("print")))
    near = near.join(votes.toDF("src", "a"), "src").join(votes.toDF("dst", "b"), "dst").select("a", "b")
    same = prints.join(votes, "vote").where("m1 <> least").select(F.col("least").alias("a"), F.col("m1").alias("b"))
    sets = prints.select("m1", "n", "print")
    pairs = near.unionByName(same).toDF("src", "dst").distinct()
    return pairs.join(sets.toDF("src", "m", "p"), "src").join(sets.toDF("dst", "n", "q"), "dst").mapInPandas(_ruled_in, "src long, dst long")


def _groups(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(m1, group) of sets that may be similar to another one."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    asked = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(asked, math.ceil(total / (1 << 20))), math.ceil(total / BUCKET_BYTES))
    sent = docs.where("text IS NOT NULL").select("text").mapInPandas(_messages(buckets, HOT, KEYED_BYTES), MESSAGE)
    met = staged(sent.groupBy("bucket").applyInPandas(giving_back(_meetings(FEW)), "kind int, a long, b long"), "met")
    prints = entries.where("n > 0").groupBy("m1").agg(F.first("n").alias("n"), F.first("print").alias("print"), F.first("vote").alias("vote"))
    prints = staged(prints, "prints")
    close = staged(simhash_links(prints), "close")
    settled = component_ids(close)
    prints = prints.join(settled, prints["m1"] == settled["node"], "left").select("m1", "n", "print", F.coalesce("component", "m1").alias("settled"))
    pairs = met.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    pairs = pairs.join(prints.toDF("src", "m", "p", "s"), "src").join(prints.toDF("dst", "n", "q", "t"), "dst").where("s <> t")
    edges = close.unionByName(pairs.drop("s", "t").mapInPandas(_ruled_in, "src long, dst long"))
    members = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("name")).distinct()
    members = members.join(prints.toDF("name", "n", "held", "settled"), "name")
    edges = edges.unionByName(_dealt(members).mapInPandas(_maybe, "src long, dst long").distinct())
    return component_ids(staged(edges, "edges")).select(F.col("node").alias("m1"), F.col("component").alias("group"))


def links(docs: DataFrame, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (src, dst) that connect all nodes of similarity 0.8 or more."""
    wanted = nodes.join(_groups(docs, entries), "m1").select(F.col("group").alias("key"), "node", "doc_id", "h", "size")
    return _dealt(staged(_with_sets(docs, staged(wanted, "members")), "sets")).mapInPandas(_compared, "src long, dst long")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents less all but the first of each component; columns stay as they are."""
    with small_batches(docs.sparkSession):
        gone = _gone(docs)
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_h"]) & F.octet_length(docs["text"]).eqNullSafe(gone["_gone_size"])
    return docs.join(gone, same, "left_anti")


def _gone(docs: DataFrame) -> DataFrame:
    """Of the rows that do not stay: doc_id, text hash and size."""
    entries = staged(_entries(docs), "entries")
    nodes = staged(_nodes(entries), "nodes")
    component = component_ids(staged(links(docs, entries, nodes), "links"))
    labelled = nodes.join(component, "node", "left").withColumn("label", F.coalesce("component", "node"))
    kept = labelled.groupBy("label").agg(F.min(F.struct(*_FIRST)).alias("kept"))
    keep = labelled.join(kept, "label").select("m1", "m2", F.col("kept.doc_id").alias("kept_id"), F.col("kept.h").alias("kept_h"), F.col("kept.size").alias("kept_size"))
    stays = F.expr("doc_id <=> kept_id AND h = kept_h AND size <=> kept_size")
    gone = entries.select("doc_id", "h", "size", "m1", "m2").join(keep, ["m1", "m2"]).where(~stays)
    return lookup(gone.select(F.col("doc_id").alias("_gone_id"), F.col("h").alias("_gone_h"), F.col("size").alias("_gone_size")).distinct(), "gone")


def _word_sets(rows: list[tuple]) -> list[set]:
    sets = []
    for _, text in rows:
        w = bytes(textblocks.LOWER[np.frombuffer(textblocks.encoded(text), np.uint8)]).split()
        sets.append({b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    return sets


def brute_force(rows: list[tuple]) -> set:
    """The doc_ids that stay, by comparing all pairs, for tests."""
    sets = _word_sets(rows)
    comp = [i for i, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return {i for (i, _), c in zip(rows, comp, strict=True) if i == c}
