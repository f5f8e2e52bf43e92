"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become class numbers by a table, with what must be seen ahead folded in. Each class is
a function from states to states; functions are composed by an associative scan through the
composition table of the monoid that they generate, which gives the state before every character
and with it the places where a slice begins. No regular expression is involved. Slices go through a
bounded cache of merged pairs. The byte offset of every token is kept while decoding, so that any
stretch of tokens can be decoded alone.

The slices are those of the pattern of the public rank files: contractions after an apostrophe,
runs of letters, numbers or other characters with one space before them, and white space.

Defined results: null and empty texts have no tokens and decode to no bytes; special tokens are
ordinary text; very long texts are encoded whole; of pairs of equal rank the leftmost is merged first;
every row, repeated ones and those without a doc_id too, is encoded on its own; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import heapq
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import give_back

LETTER, NUMBER, OTHER, SPACE_LAST, SPACE, WHITE_LAST, WHITE, SHORT, LONG, BREAK = range(10)
APOSTROPHE = 39
END = 0x110000
CACHE = 250_000

# Letters and numbers of Unicode 16, which Python's table does not have yet.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)

# States: what was read just before a character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a slice begins at the character."""
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    if kind == BREAK:
        return FRESH, False
    if kind == LETTER and state in (ONE_LEFT, TWO_LEFT):
        return (FRESH if state == ONE_LEFT else ONE_LEFT), False
    if kind in runs:
        return runs[kind], state not in (runs[kind], AFTER_SPACE)
    if kind in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return (ONE_LEFT if kind == SHORT else TWO_LEFT), True
    if kind == SPACE_LAST:
        return AFTER_SPACE, True
    if kind == WHITE_LAST:
        return FRESH, True
    return IN_WHITE, state != IN_WHITE


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class, composition table, action on states, begin flags by state and class."""
    kinds, states = range(10), range(8)
    number: dict[tuple, int] = {tuple(states): 0}
    generators = [tuple(_step(s, k)[0] for s in states) for k in kinds]
    queue = [tuple(states)]
    for f in queue:
        for g in generators:
            made = tuple(g[x] for x in f)
            if made not in number:
                number[made] = len(number)
                queue.append(made)
    functions = list(number)
    n = len(functions)
    table = np.array([[number[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)
    assert n * n == table.size
    begins = np.array([[_step(s, k)[1] for k in kinds] for s in states])
    return np.array([number[g] for g in generators], np.uint16), table.ravel(), np.array(functions, np.uint8).ravel(), begins.ravel()


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE, WHITE or BREAK of every code point."""
    table = np.full(END + 1, OTHER, np.uint8)
    for cp in range(END):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            table[cp] = LETTER
        elif major == "N":
            table[cp] = NUMBER
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for low, high in ranges:
            table[low : high + 1] = kind
    table[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    table[32] = SPACE
    table[END] = BREAK
    return table


def _kinds(points: np.ndarray) -> np.ndarray:
    """Classes with what follows folded in; ``points`` ends with END."""
    kinds = _classes()[points]
    ahead = np.append(kinds[1:], BREAK)
    before_text = (ahead <= OTHER)
    kinds[(kinds == SPACE) & before_text] = SPACE_LAST
    kinds[(kinds == WHITE) & before_text] = WHITE_LAST
    at = np.flatnonzero(points == APOSTROPHE)
    if len(at):
        padded = np.append(points, [END, END])
        one, two = padded[at + 1], padded[at + 2]
        is_ = lambda a, b: (one == ord(a)) & (two == ord(b))
        kinds[at[is_("r", "e") | is_("v", "e") | is_("l", "l")]] = LONG
        kinds[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    return kinds


def _scan(elements: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Inclusive prefix compositions, over rows of columns that are scanned side by side."""
    n = len(elements)
    width = 64
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[int(out[i - 1]) * size + int(out[i])]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for j in range(1, width):
        grid[j] = table[grid[j - 1].astype(np.int32) * size + grid[j]]
    carried = np.zeros(rows, np.uint16)
    carried[1:] = _scan(grid[-1], table, size)[:-1]
    return np.ascontiguousarray(table[carried.astype(np.int32)[None, :] * size + grid].T).ravel()[:n]


def slice_starts(points: np.ndarray) -> np.ndarray:
    """Where slices begin in an array of code points; END separates documents and begins none."""
    if not len(points):
        return np.zeros(0, np.int64)
    elements, table, action, begins = _monoid()
    kinds = _kinds(points)
    size = len(action) // 8
    after = action[_scan(elements[kinds], table, size).astype(np.int32) * 8 + FRESH]
    before = np.empty_like(after)
    before[0] = FRESH
    before[1:] = after[:-1]
    return np.flatnonzero(begins[before.astype(np.int32) * 10 + kinds])


class _Cache(dict):
    """Packed ids of slices in two generations of at most CACHE, so that a worker's memory stays bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        made = self.older.get(piece)
        if made is None:
            made = struct.pack(f"<{len(ids)}I", *ids) if (ids := merged(piece.encode("utf-8", "surrogatepass"), self.ranks)) else b""
        if len(piece) <= 64:
            self[piece] = made
        return made


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of the least rank, leftmost first, is joined until none is left."""
    whole = ranks.get(raw)
    if whole is not None:
        return [whole]
    n = len(raw)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        alive[j] = False
        ends[i] = end
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(raw[i : ends[k]])) is not None:
                heapq.heappush(heap, (r, i, ends[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(raw[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [ranks[raw[i : ends[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        self.ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.cache = _Cache(self.ranks)
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_size)])[:-1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        end = np.array([END], np.uint32)
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lengths = np.array([len(p) + 1 for p in points])
        starts = slice_starts(np.concatenate([x for p in points for x in (p, end)]))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        cuts = np.searchsorted(starts, offsets)
        look = self.cache.__getitem__
        out = []
        for k, text in enumerate(texts):
            at = (starts[cuts[k] : cuts[k + 1]] - offsets[k]).tolist()
            at.append(len(text))
            out.append(b"".join([look(text[a:b]) for a, b in zip(at, at[1:], strict=False)]))
        return out

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids, and the byte offset at which each token ends."""
        size = self.token_size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b"", ends
        place = np.repeat(self.token_start[ids] - (ends - size), size)
        place += np.arange(int(ends[-1]))
        return self.token_bytes[place].tobytes(), ends


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


BATCH_CHARS = 500_000


def _batches(texts) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if held and size + len(text) > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encoded(docs: DataFrame, path: str, with_decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every text; ``path``: the rank file.

    ``with_decoded`` adds the bytes that the ids decode to, made in the same worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for pdf in batches:
            at = 0
            for texts in _batches(pdf["text"]):
                out = pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at : at + len(texts)].array, "ids": coder.encode(texts)})
                if with_decoded:
                    out["decoded"] = [coder.decode(np.frombuffer(x, "<u4"))[0] for x in out["ids"]]
                yield out
                at += len(texts)
        give_back()

    schema = "doc_id long, ids binary" + ", decoded binary" * with_decoded
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (doc_id, ids) with the decoded bytes of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for pdf in batches:
            yield pdf.assign(decoded=[coder.decode(np.frombuffer(x, "<u4"))[0] for x in pdf["ids"]])

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids binary, decoded binary")


def with_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the bytes that they decode to."""
    return encoded(docs, path, with_decoded=True).selectExpr(
        "doc_id", "CAST(octet_length(ids) DIV 4 AS BIGINT) AS n_tokens", "ids", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256"
    )


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The columns of query op7: every text is encoded, and its ids are decoded again."""
    return with_digests(docs, path).drop("ids")
