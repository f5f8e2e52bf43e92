"""Suffix-array dedup: bucket-pointer refinement over a sparse set of suffixes.

Every string of ``LENGTH`` bytes has an anchor, the least hash among its ``GRAM``-byte substrings,
which depends on the string alone. Equal strings thus meet at equal anchors, and only the suffixes
that begin near anchors found in several documents are ever sorted:

1. A part of the documents asks which of its anchor hashes occur in another part, and says at which of
   them ``HOT`` different stretches of its own hang.
2. For anchors in several documents it sends the stretch of text whose strings hang on the anchor,
   equal stretches once with their smallest doc_id, to the bucket of the anchor. At an anchor that a
   part finds hot, as at the edges of boilerplate, each string goes by its own hash instead, so that no
   bucket gets all contexts of a common phrase; at any other anchor there are at most ``HOT`` a part.
3. A bucket orders the suffixes of its stretches by bucket-pointer refinement (Schuermann and Stoye,
   2005). Suffixes with one ``Q``-gram are a bucket, and each suffix points to its bucket. Buckets are
   refined one group after another: members are sorted by the pointers of the suffixes that lie as far
   on as the bucket is deep, and the finer pointers are written back at once, so that the next level of
   the same group, and all groups after it, sort by them. Neighbours in the order are then compared
   byte by byte; hashes only route. The bucket answers, for each string of a stretch, whether a smaller
   doc_id holds it.
4. The part removes the bytes that flagged strings cover.

Defined results: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose nothing; very
long texts are judged whole; rows with one doc_id, repeated rows too, are one document and do not
remove each other's bytes; a null doc_id counts as smaller than any other; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import exchange, textblocks
from .scratch import give_back, giving_back
from .textblocks import encoded

LENGTH = 50
GRAM = 20
#: Length of the strings of the initial buckets.
Q = 8
#: Different stretches of one part at an anchor from which on its strings are routed one by one.
HOT = 64
#: Bytes of text whose anchors are found at once, so that the arrays stay near the processor.
ANCHORED_BYTES = 1 << 17
#: Bytes of text that are cut at once: each of its strings takes some fifty bytes meanwhile.
CUT_BYTES = 1 << 18
#: Texts that are put in place of others at once.
CUT_ROWS = 256
#: Bytes of stretches that are ordered at once; those of one anchor are never parted.
ORDERED = 1 << 20
#: Suffixes whose buckets are refined together.
GROUP = 1 << 16
NULL_ID = -(2**63)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
MESSAGE = "round int, part int, bucket int, payload binary"
SENT = pa.schema([("round", pa.int32()), ("part", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
#: Texts stay as Arrow has them; each is a string of Python only while it is looked at.
AS_THEY_ARE = {t: pd.ArrowDtype(t) for t in (pa.string(), pa.large_string())}


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys, by doubling."""
    span, least = 1, keys
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(block: textblocks.Block, length: int, gram: int):
    """(document, anchor hash, first and last string start, hash of the stretch) of each anchor of the block, in order."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    sums, downs = textblocks.prefix_hash(textblocks.BYTE_VALUES[0][block.data], textblocks.BASE)
    n = len(block.data)
    # a document ends with a line feed that is not its own
    fits = textblocks.window_starts(block.offsets, length + 1)
    if not len(fits):
        return none
    h = textblocks.mix((sums[gram:] - sums[:-gram]) * downs[: n - gram + 1])
    # 32 bits of the hash above the place: of equal ones the first is taken, in every document alike
    low = np.uint64(32)
    place = np.arange(len(h), dtype=np.uint64)
    least = _sliding_least((h >> low << low) | place, length - gram + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[fits]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (fits[1:] != fits[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    first, last = fits[begin], fits[end]
    stretch = textblocks.mix((sums[last + length] - sums[first]) * downs[first] ^ (last - first).astype(np.uint64))
    return np.searchsorted(block.offsets, first, "right") - 1, h[at[begin]], first, last, stretch


def _anchors_of(pdf: pd.DataFrame, length: int, gram: int, stretches: bool = True):
    """Anchors of all texts: document number, hash, first and last start within the document, hash of the stretch if wanted.

    There is one for some sixteen bytes, so that a part holds them in as few bytes as they need, and once.
    """
    columns: list[list[np.ndarray]] = [[], [], [], [], []]
    for block in textblocks.blocks(pdf["text"], target=ANCHORED_BYTES):
        doc, h, first, last, stretch = anchors(block, length, gram)
        doc, first, last = (x.astype(np.int32) for x in (doc + block.first, first - block.offsets[doc], last - block.offsets[doc]))
        for column, x in zip(columns, (doc, h, first, last, stretch if stretches else np.zeros(0, np.uint64)), strict=True):
            column.append(x)
    return tuple(np.concatenate(columns.pop(0)) for _ in range(5))


def _part(rows: pa.Table) -> pd.DataFrame:
    return rows.select(["doc_id", "text", "part"]).to_pandas(types_mapper=AS_THEY_ARE.get)


def _messages(turn: int, part: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_pandas(exchange.messages(part, rows).assign(round=np.int32(turn)), SENT, preserve_index=False)


def _ids(pdf: pd.DataFrame) -> np.ndarray:
    return pdf["doc_id"].to_numpy()


def _asked(pdf: pd.DataFrame, found, buckets: int):
    """Distinct anchor hashes, whether several documents here have them, order, counts and routes."""
    doc, h = found[:2]
    order = np.argsort(h).astype(np.int32)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    begins = np.flatnonzero(new).astype(np.int32)
    values = s[begins]
    del s
    own = np.unique(_ids(pdf), return_inverse=True)[1].astype(np.int32)[doc][order]
    another = np.zeros(len(own), bool)
    another[1:] = (own[1:] != own[:-1]) & ~new[1:]
    del own, new
    several = np.logical_or.reduceat(another, begins) if len(begins) else another
    counts = np.diff(begins, append=np.int32(len(order)))
    return values, several, order, counts, exchange.by_bucket((values >> np.uint64(16)).astype(np.uint32) % np.uint32(buckets))


def _crowded(found, order: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Whether ``most`` different stretches or more hang on each distinct anchor."""
    out = np.zeros(len(counts), bool)
    many = np.flatnonzero(counts >= most)
    if len(many):
        begin = np.cumsum(counts) - counts
        for k in many.tolist():
            out[k] = len(np.unique(found[4][order[begin[k] : begin[k] + counts[k]]])) >= most
    return out


def _question(values: np.ndarray, crowded: np.ndarray) -> bytes:
    own = exchange.pack(values)
    return struct.pack("<I", len(own)) + own + exchange.pack(values[crowded])


def _answered(pdf: pd.DataFrame) -> list[bytes]:
    """For each message: a bit per anchor for those that another part sent too, then one for the hot ones."""
    sent = [(exchange.unpack(p[4 : 4 + (n := struct.unpack_from("<I", p)[0])]), exchange.unpack(p[4 + n :])) for p in pdf["payload"]]
    shared = exchange.repeated(np.concatenate([a for a, _ in sent]), 2)
    hot = np.unique(np.concatenate([b for _, b in sent]))
    return [np.packbits(np.concatenate([exchange.among(a, shared), exchange.among(a, hot)])).tobytes() for a, _ in sent]


def _shared(pdf: pd.DataFrame, found, answers: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the anchors that occur in several documents, and whether they are hot."""
    values, several, order, counts, routed = _asked(pdf, found, buckets)
    hot = np.zeros(len(values), bool)
    for b, x in routed:
        said = exchange.bits(answers[b], 2 * len(x))
        several[x] |= said[: len(x)]
        hot[x] = said[len(x) :]
    chosen = order[np.repeat(several, counts)]
    often = np.repeat(hot[several], counts[several])
    place = np.argsort(chosen)
    return chosen[place], often[place]


def _row_order(ids: np.ndarray, texts: pd.Series) -> np.ndarray:
    """Rows by doc_id, those of one doc_id by text."""
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0])) if len(ids) else order
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
        if b - a > 1:
            order[a:b] = sorted(order[a:b].tolist(), key=lambda i: encoded(texts.iat[i]))
    return order


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` ascending numbers from each of ``starts`` on."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Stretches:
    """Distinct stretches of a part's shared anchors, each with a routing hash and its smallest doc_id.

    ``doc``, ``first`` and ``of`` give document, start and stretch of every occurrence. A stretch of a
    hot anchor is cut into its strings. Rows reach a task in any order, and the answers are read off by a
    later one: stretches are numbered by doc_id and text, so that both number alike.
    """

    def __init__(self, pdf: pd.DataFrame, found, chosen: np.ndarray | slice, hot: np.ndarray, length: int, buckets: int):
        doc, h, first, last = (x[chosen] for x in found[:4])
        ids, texts = _ids(pdf), pdf["text"]
        # rows of one doc_id and one text may change places; their stretches are the same
        rank = np.empty(len(ids), np.int64)
        rank[_row_order(ids, pdf["text"])] = np.arange(len(ids))
        by = np.argsort(rank[doc], kind="stable")
        pieces = np.where(hot, last - first + 1, 1)[by]
        by = np.repeat(by, pieces)
        often = hot[by]
        self.doc, self.first = doc[by], first[by] + np.where(often, _spread(np.zeros(len(pieces), np.int64), pieces), 0)
        end = np.where(often, self.first, last[by]) + length
        number: dict[bytes, int] = {}
        self.of = np.empty(len(by), np.int32)
        begins, lengths = _runs(self.doc)
        for a, n in zip(begins.tolist(), lengths.tolist(), strict=True):
            raw = encoded(texts.iat[self.doc[a]])
            spans = zip(self.first[a : a + n].tolist(), end[a : a + n].tolist(), strict=True)
            self.of[a : a + n] = [number.setdefault(raw[i:j], len(number)) for i, j in spans]
        self.texts = list(number)
        # doc_ids ascend, so that the first bearer of a stretch has the smallest
        bearer = np.flatnonzero(np.diff(np.maximum.accumulate(self.of), prepend=-1))
        self.least = ids[self.doc[bearer]]
        self.room = (end - self.first)[bearer] - length + 1
        self.hash_array = h[by[bearer]]
        for k in np.flatnonzero(often[bearer]).tolist():
            self.hash_array[k] = xxhash.xxh64_intdigest(self.texts[k])
        self.routed = exchange.by_bucket((self.hash_array >> np.uint64(16)).astype(np.uint32) % np.uint32(buckets))

    def payload(self, x: np.ndarray) -> bytes:
        texts = [self.texts[i] for i in x.tolist()]
        ids = self.least[x]
        sizes = np.array([len(t) for t in texts], np.uint16)
        # half of the hash tells anchors of a bucket apart; those that it confuses are sorted together
        low = self.hash_array[x].astype(np.uint32)
        raw = b"".join([struct.pack("<I", len(texts)), ids.tobytes(), low.tobytes(), sizes.tobytes(), *texts])
        return zstandard.compress(raw, 3)


def _sent(pdf: pd.DataFrame, said: dict, length: int, gram: int, buckets: int) -> Stretches:
    """The stretches of a part whose questions were answered by ``said``; its other anchors are let go before."""
    found = _anchors_of(pdf, length, gram, stretches=False)
    chosen, hot = _shared(pdf, found, said, buckets)
    found = [x[chosen] for x in found[:4]]
    del chosen
    give_back()
    return Stretches(pdf, found, slice(None), hot, length, buckets)


def _unpacked(payload: bytes):
    payload = zstandard.decompress(payload)
    (n,) = struct.unpack_from("<I", payload)
    ids = np.frombuffer(payload, np.int64, n, 4)
    hashes = np.frombuffer(payload, np.uint32, n, 4 + 8 * n)
    sizes = np.frombuffer(payload, np.uint16, n, 4 + 12 * n).astype(np.int64)
    return ids, hashes, sizes, np.frombuffer(payload, np.uint8, offset=4 + 14 * n)


def refined_order(data: np.ndarray, depth: int, group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``data`` ordered by their first ``depth`` bytes at least, and their ``Q``-grams.

    Past the end all bytes are zero. By bucket-pointer refinement: ``pointer`` leads from a suffix to the
    place of its bucket in the order, and ``deep`` says how many bytes the members of a bucket share.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(depth + 2 * Q, np.uint8)])
    grams = np.lib.stride_tricks.sliding_window_view(padded, Q).copy().view(">u8").ravel().astype(np.uint64)
    order = np.argsort(grams[:n])
    head = np.ones(n, bool)
    head[1:] = grams[order[1:]] != grams[order[:-1]]
    place = np.flatnonzero(head)
    size = np.diff(np.append(place, n))
    # suffixes past the end are one bucket behind all others, as deep as need be
    pointer = np.full(n + depth + Q, n, np.int32)
    pointer[order] = np.repeat(place, size)
    deep = np.full(n + 1, Q, np.int32)
    deep[n] = depth
    open_place, open_size = place[size > 1], size[size > 1]
    for few in np.split(np.arange(len(open_place)), np.flatnonzero(np.diff(np.cumsum(open_size) // group)) + 1):
        place, size = open_place[few], open_size[few]
        while len(place):
            # the members of the buckets of this group, and what their suffixes further on point to
            spot = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own = np.repeat(place, size)
            member = order[spot]
            target = pointer[member + np.repeat(deep[place], size)]
            by = np.argsort((own.astype(np.uint64) << np.uint64(32)) | target.astype(np.uint64))
            member, target = member[by], target[by]
            order[spot] = member
            head = np.ones(len(spot), bool)
            head[1:] = (own[1:] != own[:-1]) | (target[1:] != target[:-1])
            at = np.flatnonzero(head)
            fresh, many = spot[at], np.diff(np.append(at, len(spot)))
            further = deep[own[at]] + deep[target[at]]
            pointer[member] = np.repeat(fresh, many)
            deep[fresh] = further
            left = (many > 1) & (further < depth)
            place, size = fresh[left], many[left]
    return order, grams


def string_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for equal strings of ``length`` bytes at ``starts``, from the refined order."""
    if length < Q:
        raise ValueError(f"strings have {Q} bytes at least")
    order, grams = refined_order(data, length, GROUP)
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    chosen = order[wanted[order]]
    new = np.zeros(len(chosen), bool)
    for k in {*range(0, length - Q + 1, Q), length - Q}:
        g = grams[chosen + k]
        new[1:] |= g[1:] != g[:-1]
    of = np.empty(len(data), np.int64)
    of[chosen] = np.cumsum(new)
    return of[starts]


def _refine(pdf: pd.DataFrame, length: int) -> list[bytes]:
    """For each message, a bit per string of its stretches: whether a smaller doc_id has it."""
    sent = [_unpacked(p) for p in pdf["payload"]]
    ids, hashes, sizes, data = (np.concatenate(x) for x in zip(*sent, strict=True))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    text_of = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
    texts = list(number)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, text_of, ids)
    bearer = np.zeros(len(texts), np.int64)
    bearer[text_of] = np.arange(len(text_of))
    # stretches that are alone at their anchor need no sorting
    text_hash = hashes[bearer]
    _, _, counts, order = textblocks.distinct(text_hash)
    contested = np.empty(len(texts), bool)
    contested[order] = np.repeat(counts > 1, counts)
    room = np.array([len(t) - length + 1 for t in texts], np.int64)
    best = np.repeat(least, room)
    begin = np.concatenate([[0], np.cumsum(room)])
    held = np.flatnonzero(contested)
    held = held[np.argsort(text_hash[held], kind="stable")]
    new = np.ones(len(held), bool)
    new[1:] = text_hash[held[1:]] != text_hash[held[:-1]]
    # whole anchors, of about ORDERED bytes together
    group = (np.cumsum(room[held] + length - 1) // ORDERED)[np.flatnonzero(new)][np.cumsum(new) - 1] if len(held) else held
    for some in np.split(held, np.flatnonzero(np.diff(group)) + 1):
        if not len(some):
            continue
        joined = np.frombuffer(b"".join([texts[i] for i in some.tolist()]), np.uint8)
        bounds = np.concatenate([[0], np.cumsum(room[some] + length - 1)])
        classes = string_classes(joined, textblocks.window_starts(bounds, length), length)
        n = room[some]
        smallest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, classes, np.repeat(least[some], n))
        best[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = smallest[classes]
    out, at = [], 0
    for own, _, _, _ in sent:
        these = text_of[at : at + len(own)]
        at += len(own)
        n = room[these]
        index = np.repeat(begin[these] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out.append(np.packbits(best[index] < np.repeat(own, n)).tobytes())
    return out


class _Exchange:
    """Parts of the documents and the answers to both of their messages."""

    def __init__(self, docs: DataFrame, columns: list[str], length: int, gram: int):
        if not Q <= gram <= length:
            raise ValueError(f"{Q} <= gram <= length")
        named = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
        parts, _, buckets = exchange.in_parts(named, "doc_id", *columns)
        buckets *= 2
        hot = HOT

        def ask(rows: pa.Table) -> pa.Table:
            pdf = _part(rows)
            found = _anchors_of(pdf, length, gram)
            values, _, order, counts, routed = _asked(pdf, found, buckets)
            crowded = _crowded(found, order, counts, hot)
            return _messages(1, int(pdf["part"].iloc[0]), [(b, _question(values[x], crowded[x])) for b, x in routed])

        def answer_asked(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"round": np.int32(1), "part": pdf["part"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "payload": _answered(pdf)})

        def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
            if not len(rows):
                return SENT.empty_table()
            pdf = _part(rows)
            said = dict(zip(answers["bucket"].to_pylist(), answers["payload"].to_pylist(), strict=True))
            sent = _sent(pdf, said, length, gram, buckets)
            return _messages(2, int(pdf["part"].iloc[0]), [(b, sent.payload(x)) for b, x in sent.routed])

        def answer_sent(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"round": np.int32(2), "part": pdf["part"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "payload": _refine(pdf, length)})

        def cut(rows: pa.Table, answers: pa.Table) -> Iterator[tuple]:
            """doc_id, n_bytes, n_removed, n_spans and kept bytes of each document of a part."""
            pdf = _part(rows)
            said = {r: dict(zip(x["bucket"], x["payload"], strict=True)) for r, x in answers.to_pandas().groupby("round")}
            sent = _sent(pdf, said.get(1, {}), length, gram, buckets)
            sent.texts = []  # those who send need them
            give_back()
            return _without(pdf, sent, said.get(2, {}), length)

        asking = parts.select("doc_id", "text", "part").groupBy("part")
        names = ["round", "part", "bucket", "payload"]
        first = asking.applyInArrow(giving_back(ask), MESSAGE).groupBy("bucket").applyInPandas(giving_back(answer_asked), MESSAGE)
        second = asking.cogroup(first.groupBy("part")).applyInArrow(giving_back(send), MESSAGE).groupBy("bucket").applyInPandas(giving_back(answer_sent), MESSAGE)
        self.cut = cut
        self.met = parts.groupBy("part").cogroup(first.select(names).unionByName(second).groupBy("part"))


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every document with the bytes left after strings held by smaller doc_ids are removed.

    A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
    smaller doc_id. Strings are judged on the input.
    """
    exchanged = _Exchange(docs.select("doc_id", "text"), [], length, gram)
    cut = exchanged.cut

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        done = cut(rows, answers) if len(rows) else iter(())
        columns = (zip(*some, strict=True) for some in itertools.batched(done, CUT_ROWS))
        return pa.Table.from_batches([pa.record_batch([pa.array(x, f.type) for x, f in zip(c, CUT, strict=True)], schema=CUT) for c in columns], CUT)

    return exchanged.met.applyInArrow(giving_back(remove), RESULT).withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def _without(pdf: pd.DataFrame, sent: Stretches, answers: dict, length: int):
    ids = _ids(pdf)
    begin = np.cumsum(sent.room) - sent.room
    flags = np.zeros(int(sent.room.sum()), bool)
    for b, x in sent.routed:
        n = sent.room[x]
        flags[_spread(begin[x], n)] = exchange.bits(answers[b], int(n.sum()))
    order = np.argsort(sent.doc, kind="stable")
    cuts = np.searchsorted(sent.doc[order], np.arange(len(ids) + 1))
    for block in textblocks.blocks(pdf["text"], target=CUT_BYTES):
        some = order[cuts[block.first] : cuts[block.first + block.count]]
        doc, of = sent.doc[some], sent.of[some]
        n = sent.room[of]
        hit = flags[_spread(begin[of], n)] | np.repeat(ids[doc] > sent.least[of], n)
        # strings end within their document, so that its line feed stays
        gone = textblocks.covered(_spread(block.offsets[doc - block.first] + sent.first[some], n)[hit], length, len(block.data))
        until = np.concatenate([[0], np.cumsum(gone)])[block.offsets]
        opened = np.concatenate([[0], np.cumsum(gone & ~np.concatenate([[False], gone[:-1]]))])[block.offsets]
        left, ends = block.data[~gone].tobytes(), block.offsets - until
        sizes = np.diff(block.offsets) - 1
        own_ids = ids[block.first : block.first + block.count].tolist()
        rows = zip(own_ids, sizes.tolist(), np.diff(until).tolist(), np.diff(opened).tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        for own, size, removed, spans, a, z in rows:
            yield own, size, removed, spans, left[a : z - 1]


def digest(kept: DataFrame) -> DataFrame:
    """The columns of query op6."""
    return kept.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")


def _in_place(done: Iterator[tuple], text: pa.ChunkedArray) -> pa.ChunkedArray:
    """The texts, those that lost bytes by what is left of them, a few at a time."""
    out = []
    for k, some in enumerate(itertools.batched(done, CUT_ROWS)):
        left = [x.decode("utf-8", "ignore") if n and d != NULL_ID else None for d, _, n, _, x in some]
        out.append(pc.coalesce(pa.array(left, text.type), text.slice(k * CUT_ROWS, len(some)).combine_chunks()))
    return pa.chunked_array(out, text.type)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated spans cut out of their texts; ``n_chars``, if there, counts anew.

    A character of which some bytes stay while others go is dropped whole. All columns and rows stay.
    Each row loses what smaller doc_ids hold of its own text, other rows of its doc_id notwithstanding;
    rows with a null doc_id, null or empty texts stay as they are; an empty table stays empty.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)])
    text_at, id_at = docs.columns.index("text"), docs.columns.index("doc_id")
    others = [o for i, o in enumerate(own) if i != text_at]
    exchanged = _Exchange(renamed.withColumnsRenamed({own[text_at]: "text"}).withColumn("doc_id", F.col(own[id_at])), others, LENGTH, GRAM)
    cut = exchanged.cut
    schema = StructType([StructField(o, f.dataType) for o, f in zip(own, docs.schema.fields, strict=True)])

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        text = rows["text"]
        if len(rows):
            text = _in_place(cut(rows, answers), text)
        return pa.table([text if i == text_at else rows[o] for i, o in enumerate(own)], names=own)

    out = exchanged.met.applyInArrow(giving_back(remove), schema).withColumnsRenamed(dict(zip(own, docs.columns, strict=True)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def brute_force(rows: list[tuple], length: int = LENGTH) -> dict:
    """doc_id → (n_bytes, n_removed, n_spans, kept_sha256) from a dictionary of all strings, for tests."""
    least: dict[bytes, int] = {}
    for d, text in rows:
        raw = encoded(text)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            least[s] = min(d, least.get(s, d))
    out = {}
    for d, text in rows:
        raw = encoded(text)
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if least[raw[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out
