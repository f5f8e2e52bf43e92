"""Vectorised views of a few documents at a time: bytes, words, rolling hashes.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``. These bytes never occur inside a
multi-byte UTF-8 character, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def encoded(text) -> bytes:
    """UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


@dataclass
class Block:
    """Documents ``first .. first + len(offsets) - 2``, each followed by one line feed."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Word spans of a block; document d of it owns words ``bounds[d] .. bounds[d + 1] - 1``."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def blocks(texts, lower: bool = False, target: int = BLOCK_BYTES) -> Iterator[Block]:
    """Runs of documents of about ``target`` bytes; a longer document is a block of its own."""
    raw: list[bytes] = []
    first = size = 0
    for k, text in enumerate(texts):
        item = encoded(text)
        if raw and size + len(item) > target:
            yield _block(first, raw, lower)
            raw, first, size = [], k, 0
        raw.append(item)
        size += len(item) + 1
    if raw:
        yield _block(first, raw, lower)


def _block(first: int, raw: list[bytes], lower: bool) -> Block:
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=offsets[1:])
    return Block(first, LOWER[data] if lower else data, offsets)


def words(block: Block) -> Words:
    white = WHITE[block.data]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    if len(white) and not white[0]:
        starts = np.concatenate([[0], starts])
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


# Rolling hashes: a polynomial over random 64-bit byte values, modulo 2**64, taken from prefix sums.
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
BASE = 0x9E3779B97F4A7C15 | 5
WORD_BASE = 0xC2B2AE3D27D4EB4F | 5
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)
        made = []
        for b in (base, pow(base, -1, 2**64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        have = (made[0], made[1])
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i and the inverse powers; spans follow by subtraction."""
    ups, downs = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * ups[:-1], out=sums[1:])
    return sums, downs


def word_hashes(block: Block, spans: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; seeds 0 and 1 are independent."""
    sums, downs = prefix_hash(BYTE_VALUES[seed][block.data], BASE)
    h = (sums[spans.ends] - sums[spans.starts]) * downs[spans.starts]
    return mix(h ^ ((spans.ends - spans.starts).astype(np.uint64) * np.uint64(0x165667B19E3779F9)))


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Indices at which a window of ``width`` items fits into its document."""
    lengths = np.diff(bounds)
    room = np.maximum(lengths - width + 1, 0)
    total = int(room.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room)
    return np.arange(total) + shift


def window_hashes(item_hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of the windows of ``width`` items that begin at ``starts``."""
    sums, downs = prefix_hash(item_hashes, WORD_BASE)
    return mix((sums[starts + width] - sums[starts]) * downs[starts])


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` items lie in a window of ``width`` that begins at one of ``starts``."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, size), -1)
    return np.cumsum(steps[:-1]) > 0


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, an index of one bearer of each, their counts, and the sort order."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    return s[at], order[at], np.diff(np.append(at, len(s))), order
