"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending doc_id order. Ids are cut into blocks of 128.
A block stores its minimum and the differences from it, packed at the bit width that a percentile of
them needs; the few that need more go, with their places, to the block's exception list. An index
gives the byte at which every block starts, so that any run of ids is read without the rest.

Layout, little-endian: magic ``PFR1``; documents (u32), ids (u64), blocks (u32); doc_ids (i64 each),
null flags (u8 each), ids per document (u64 each); block starts (u64 each); blocks: minimum (u32),
width (u8), exceptions (u8), packed low bits, exception places (u8 each), exception high bits (u32
each). The last block is padded with its minimum.

Files are written by the executors to the shared folder under names made of range and sequence
number, first under a name of their own and then moved, so that a task that runs twice leaves the
same file. A worker holds packed blocks, one run of unpacked ids and a cache of ``CACHE_BYTES``,
which it drops at the end of its task.

Defined results: null and empty texts have the end id alone; a very long text is encoded whole and
never split over files; rows with one doc_id, repeated rows too, are ordered by the hash of their
text, then by text; a null doc_id comes first; an empty table writes no file and gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks
from .scratch import give_back, new_folder, small_batches, staged

BLOCK = 128
#: Blocks that are packed and unpacked at once.
RUN = 2048
PERCENTILE = 90
END_ID = 1
#: Ids of a file; a range with more goes on in the next file. A document is never split.
FILE_IDS = 8_000_000
#: Most bytes of the cache of encoded pieces in a worker.
CACHE_BYTES = 40 << 20
HEADER = struct.Struct("<4sIQI")
MAGIC = b"PFR1"


# --- blocks -------------------------------------------------------------------------------------


_WIDTHS = np.uint32(1) << np.arange(32, dtype=np.uint32)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` (unsigned 32-bit) one after another, and where each starts."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.uint64)
    grid = np.empty(n * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    grid = grid.reshape(n, BLOCK)
    base = grid.min(axis=1)
    diff = grid - base[:, None]
    need = np.searchsorted(_WIDTHS, diff.ravel(), "right").astype(np.uint8).reshape(diff.shape)
    place = BLOCK * PERCENTILE // 100 - 1
    width = np.partition(need, place, axis=1)[:, place]
    over = need > width[:, None]
    extra = over.sum(axis=1)
    sizes = 6 + width.astype(np.int64) * (BLOCK // 8) + 5 * extra
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64)
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros((n, 6), np.uint8)
    head[:, :4] = base.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4], head[:, 5] = width, extra
    begin = starts.astype(np.int64)
    out[begin[:, None] + np.arange(6)] = head
    for w in np.unique(width).tolist():
        if w:
            at = np.flatnonzero(width == w)
            low = (diff[at] & np.uint32(2**w - 1)).astype("<u2" if w <= 16 else "<u4")
            bits = np.unpackbits(low.view(np.uint8).reshape(len(at), BLOCK, -1), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
            out[begin[at][:, None] + 6 + np.arange(packed.shape[1])] = packed
    row, col = np.nonzero(over)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(extra)[:-1]]), extra)
        lists = begin[row] + 6 + width[row].astype(np.int64) * (BLOCK // 8)
        out[lists + rank] = col
        high = (diff[row, col] >> width[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(lists + extra[row] + 4 * rank)[:, None] + np.arange(4)] = high
    return out.tobytes(), starts


def unpack_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks at ``starts`` in ``data`` (bytes), padding included."""
    n = len(starts)
    begin = starts.astype(np.int64)
    base = data[begin[:, None] + np.arange(4)].copy().view("<u4").astype(np.uint32)
    width, extra = data[begin + 4].astype(np.int64), data[begin + 5].astype(np.int64)
    grid = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            at = np.flatnonzero(width == w)
            packed = data[begin[at][:, None] + 6 + np.arange(w * BLOCK // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
            grid[at] = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    row = np.repeat(np.arange(n), extra)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(extra)[:-1]]), extra)
        lists = begin[row] + 6 + width[row] * (BLOCK // 8)
        col = data[lists + rank]
        high = data[(lists + extra[row] + 4 * rank)[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.uint32)
        grid[row, col] |= high << width[row].astype(np.uint32)
    return (grid + base).ravel()


# --- files --------------------------------------------------------------------------------------


class FileBuilder:
    """A file in the making: whole runs of blocks are packed as their ids arrive."""

    def __init__(self):
        self.names: list = []
        self.sizes: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.blocks: list[bytes] = []
        self.starts: list[np.ndarray] = []
        self.held = self.waits = self.bytes = 0

    def add(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.names += doc_ids
        self.sizes.append(sizes)
        self.waiting.append(ids)
        self.held += len(ids)
        self.waits += len(ids)
        if self.waits >= RUN * BLOCK:
            self._pack(self.waits // BLOCK * BLOCK)

    def _pack(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for i in range(0, n, RUN * BLOCK):
            packed, starts = pack_blocks(ids[i : min(i + RUN * BLOCK, n)])
            self.blocks.append(packed)
            self.starts.append(starts + np.uint64(self.bytes))
            self.bytes += len(packed)
        self.waiting, self.waits = [ids[n:].copy()], len(ids) - n

    def content(self) -> bytes:
        """The whole file."""
        self._pack(self.waits)
        sizes = np.concatenate([np.zeros(0, np.int64), *self.sizes]).astype("<u8")
        starts = np.concatenate([np.zeros(0, np.uint64), *self.starts]).astype("<u8")
        null = np.array([d is None or d != d for d in self.names], np.uint8)
        names = np.array([0 if z else int(d) for d, z in zip(self.names, null, strict=True)], "<i8")
        head = HEADER.pack(MAGIC, len(sizes), self.held, len(starts))
        return b"".join([head, names.tobytes(), null.tobytes(), sizes.tobytes(), starts.tobytes(), *self.blocks])


def file_bytes(doc_ids: list, docs_ids: list[np.ndarray]) -> bytes:
    """A whole file of the given documents."""
    built = FileBuilder()
    for d, ids in zip(doc_ids, docs_ids, strict=True):
        built.add([d], np.array([len(ids)]), np.asarray(ids, np.uint32))
    return built.content()


def read_head(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, null flags and ids per document of a file."""
    magic, docs, _, _ = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    names = np.frombuffer(content, "<i8", docs, at)
    null = np.frombuffer(content, np.uint8, docs, at + 8 * docs).astype(bool)
    return names, null, np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)


def read_run(content: bytes, first: int, count: int) -> np.ndarray:
    """``count`` ids from number ``first`` on, from the blocks that hold them alone."""
    _, docs, _, blocks = HEADER.unpack_from(content)
    at = HEADER.size + 17 * docs
    starts = np.frombuffer(content, "<u8", blocks, at)
    data = np.frombuffer(content, np.uint8, offset=at + 8 * blocks)
    a, b = first // BLOCK, -(-(first + count) // BLOCK)
    pieces = [unpack_blocks(data, starts[i : min(i + RUN, b)]) for i in range(a, b, RUN)] if count else []
    return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint32))[first - a * BLOCK :][:count]


# --- tokens -------------------------------------------------------------------------------------

# The parts of a tokenizer file under which pieces can be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_WHITE, _LETTER, _MARK, _DIGIT, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _WHITE
for _b in range(0x21, 0x7F):
    _KIND[_b] = _DIGIT if chr(_b).isdigit() else _LETTER if chr(_b).isalpha() else _ODD if chr(_b) == "'" else _MARK


def _by_piece(spec: dict) -> bool:
    """Whether the file lower-cases, drops white space and splits letters, digits and marks apart."""
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    parts = split.get("pretokenizers") or []
    model = spec.get("model") or {}
    return (
        normal.get("normalizers") == _NORMALIZERS and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0].get("pattern") == {"Regex": _PATTERN} and parts[0].get("invert") is True and parts[0].get("behavior") == "Removed"
        and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not spec.get("post_processor")
        and all(t["special"] and t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
    )


def pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and kind of each piece.

    A piece is a run of letters (a-z and those of the Latin-1 block), a run of ASCII marks, or a digit.
    A stretch without white space that holds anything else, an apostrophe or what may begin a special
    token is one odd piece, as it stands.
    """
    kind = _KIND[data]
    low = textblocks.LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    second = after & (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    at = np.flatnonzero(second)
    kind[at] = kind[at - 1] = _LETTER
    low[at[data[at] <= 0x9E]] += 0x20
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    kind[special] = _ODD
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        white = np.flatnonzero(kind == _WHITE)
        k = np.unique(np.searchsorted(white, odd))
        begin = np.where(k > 0, white[k - 1] + 1, 0)
        end = np.where(k < len(white), white[np.minimum(k, len(white) - 1)], len(data)) if len(white) else np.full(len(k), len(data))
        n = end - begin
        where = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        kind[where] = _ODD
        low[where] = data[where]
    cut = np.ones(len(kind) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    bounds = np.flatnonzero(cut)
    of = kind[bounds[:-1]] if len(kind) else kind
    real = of != _WHITE
    return low, bounds[:-1][real], bounds[1:][real], of[real]


@functools.lru_cache(maxsize=1)
def _tokenizers(path: str) -> tuple:
    """The tokenizer of the file and, where ``_by_piece`` holds, one for pieces and which ids end a word; a worker reads a file once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _by_piece(spec):
        return whole, None, None
    # the same merges for pieces that are normal already, one word each
    plain = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, spec["pre_tokenizer"]["pretokenizers"][1]]}}
    ends = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
    ends[[v for k, v in spec["model"]["vocab"].items() if k.endswith("</w>")]] = True
    return whole, Tokenizer.from_str(json.dumps(plain)), ends


class Encoder:
    """Ids of texts by the tokenizers library, each distinct piece encoded once while the cache holds it.

    Where the file is not of the kind that ``_by_piece`` names, every text is encoded whole.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.tokenizer, self.plain, self.ends = _tokenizers(path)
        self.by_piece, self.cache_bytes = self.plain is not None, cache_bytes
        self._clear()

    def _clear(self) -> None:
        self.keys = self.checks = np.zeros(0, np.uint64)
        self.at, self.size, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str], odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and how many each has."""
        if odd:
            made = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *made]), np.array([len(x) for x in made], np.int64)
        ids = [np.zeros(0, np.uint32)]
        for i in range(0, len(texts), 1000):
            ids.append(np.array(self.plain.encode_batch_fast([" ".join(texts[i : i + 1000])], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(ids)
        last = np.flatnonzero(self.ends[ids])
        return ids, np.diff(last, prepend=-1)

    def _learn(self, values, checks, low, starts, ends, kinds) -> None:
        made = []
        for odd in (False, True):
            x = np.flatnonzero((kinds == _ODD) == odd)
            if len(x):
                raw = low.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[x].tolist(), ends[x].tolist(), strict=True)]
                ids, sizes = self._encoded(texts, odd)
                if len(sizes) != len(x):
                    raise ValueError("the tokenizer does not end each piece with one token of a word's end")
                made.append((x, ids, sizes))
        for x, ids, sizes in made:
            place = np.searchsorted(self.keys, values[x])
            self.at = np.insert(self.at, place, len(self.store) + np.cumsum(sizes) - sizes)
            self.size = np.insert(self.size, place, sizes)
            self.checks = np.insert(self.checks, place, checks[x])
            self.keys = np.insert(self.keys, place, values[x])
            self.store = np.concatenate([self.store, ids])

    def _cached(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.keys, values), max(len(self.keys) - 1, 0))
        return place, self.keys[place] == values if len(self.keys) else np.zeros(len(values), bool)

    def _block_ids(self, block: textblocks.Block) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their number in each document, without ends; None if hashes of pieces collide."""
        low, starts, ends, kinds = pieces(block.data)
        h, check = (_span_hashes(low, starts, ends, seed) for seed in (0, 1))
        values, bearer, counts, order = textblocks.distinct(h)
        if (check[order] != np.repeat(check[bearer], counts)).any():
            return None
        if self.keys.nbytes + self.checks.nbytes + self.at.nbytes + self.size.nbytes + self.store.nbytes > self.cache_bytes:
            self._clear()
        new = np.flatnonzero(~self._cached(values)[1])
        if len(new):
            b = bearer[new]
            self._learn(values[new], check[b], low, starts[b], ends[b], kinds[b])
        place, _ = self._cached(values)
        if (self.checks[place] != check[bearer]).any():
            return None
        which = np.empty(len(h), np.int64)
        which[order] = np.repeat(place, counts)
        n = self.size[which]
        after = np.cumsum(n)
        ids = self.store[np.repeat(self.at[which] - (after - n), n) + np.arange(after[-1] if len(after) else 0)]
        until = np.concatenate([[0], after])[np.searchsorted(starts, block.offsets)]
        return ids, np.diff(until)

    def ids(self, texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: number of the first, ids with END_ID after each text, ids of each text."""
        texts = list(texts)
        for block in textblocks.blocks(texts, target=2 << 20):
            made = self._block_ids(block) if self.by_piece else None
            if made is None:
                own = ["" if not isinstance(t, str) else t for t in texts[block.first : block.first + block.count]]
                made = self._encoded(own, True)
            ids, sizes = made
            yield block.first, np.insert(ids, np.cumsum(sizes), np.uint32(END_ID)), sizes + 1


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    sums, downs = textblocks.prefix_hash(textblocks.BYTE_VALUES[seed][data], textblocks.BASE)
    return textblocks.mix((sums[ends] - sums[starts]) * downs[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(0x165667B19E3779F9))


def _write(folder: str, name: str, content: bytes) -> None:
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "file:///" + folder.removeprefix("file:").lstrip("/")
    system, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/_{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own) as out:
        out.write(content)
    system.move(own, f"{path}/{name}")


def write_tokens(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Encode the texts, append the end id, and write the ids to files in ascending doc_id order.

    Returns the files (file, documents, n_ids); names sort as the documents do. ``path``: the
    tokenizer file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        coder, built = Encoder(path), FileBuilder()

        def flush() -> pd.DataFrame:
            nonlocal built, made
            name = f"tokens-{part:08d}-{made:06d}.pfr"
            _write(folder, name, built.content())
            row = pd.DataFrame({"file": [name], "documents": [len(built.names)], "n_ids": [built.held]})
            built, made = FileBuilder(), made + 1
            return row

        for pdf in batches:
            doc_ids = pdf["doc_id"].tolist()
            for first, ids, sizes in coder.ids(pdf["text"]):
                ends = np.cumsum(sizes)
                at = 0
                while at < len(sizes):
                    begin = int(ends[at - 1]) if at else 0
                    stop = int(np.searchsorted(ends, begin + FILE_IDS - built.held, "right"))
                    if stop <= at and built.names:
                        yield flush()
                        continue
                    stop = max(stop, at + 1)
                    built.add(doc_ids[first + at : first + stop], sizes[at:stop], ids[begin : int(ends[stop - 1])])
                    at = stop
        if built.names:
            yield flush()
        coder._clear()
        give_back()

    # the hash and the row number deal rows with one doc_id, or none, over several ranges
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text")
    with small_batches(docs.sparkSession):
        return staged(ordered.mapInPandas(run, "file string, documents long, n_ids long"), "token-files")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and its ids (little-endian unsigned 32-bit)."""
    spark = files.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                names, null, sizes = read_head(content)
                ends = np.cumsum(sizes)
                at = 0
                while at < len(names):
                    begin = int(ends[at - 1]) if at else 0
                    stop = min(max(int(np.searchsorted(ends, begin + RUN * BLOCK, "right")), at + 1), len(names))
                    raw = read_run(content, begin, int(ends[stop - 1]) - begin).astype("<u4").tobytes()
                    x = slice(at, stop)
                    own = ends[x] - sizes[x]
                    yield pd.DataFrame({
                        "file": name, "doc_id": pd.Series(names[x]).astype("Int64").mask(null[x]), "own_start": own, "n_tokens": sizes[x],
                        "ids": [raw[4 * a : 4 * b] for a, b in zip((own - begin).tolist(), (ends[x] - begin).tolist(), strict=True)],
                    })
                    at = stop

    # one row per file, of which there are as many as there are stretches of FILE_IDS ids
    before = files.select("file", (F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")).alias("before"))
    content = (
        spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.pfr").load(folder)
        .select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    )
    read = content.mapInPandas(run, "file string, doc_id long, own_start long, n_tokens long, ids binary")
    return read.join(before, "file").select("doc_id", (F.col("before") + F.col("own_start")).alias("start"), "n_tokens", "ids")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The columns of query op9, from files written to a new folder of the shared space."""
    folder = new_folder(docs.sparkSession, "tokens")
    files = write_tokens(docs, path, folder)
    if files.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def brute_force(rows: list[tuple], path: str) -> dict:
    """doc_id → (start, n_tokens, ids_crc32) by the library alone, for tests."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out, start = {}, 0
    for d, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        out[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out
