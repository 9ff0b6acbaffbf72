"""Byte-level helpers that run inside Arrow tasks.

Texts arrive as Arrow batches; a block joins whole texts with line feeds into one byte buffer, so that
word boundaries and hashes are found with a few numpy passes instead of one Python call a word.
Blocks hold whole texts: a block closes at ``MAX_BLOCK`` bytes, and a longer text is a block of its own.

Polynomial hashes modulo 2**64 can be made to collide by long patterned strings, so they decide nothing alone: ``classes`` compares the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_BLOCK = 1 << 20
CHUNK = 1 << 20
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xC2B2AE3D27D4EB4F | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words: ASCII letters and digits, and all of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


@cache
def _byte_values(salt: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(BASE) + U64(salt))


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    up, down = (np.full(n + 1, b, U64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Rolling:
    """Polynomial hashes of any range of a buffer of at most ``CHUNK`` bytes (longer ones make own tables)."""

    def __init__(self, buf: np.ndarray, base: int = BASE):
        n = CHUNK if len(buf) <= CHUNK else 1 << int(len(buf)).bit_length()
        up, self.down = _powers(base, n) if n == CHUNK else _powers.__wrapped__(base, n)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(_byte_values(base & 0xFFFF)[buf] * up[: len(buf)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))

    def windows(self, n: int) -> np.ndarray:
        """Of all ranges of n bytes."""
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.down[:m]) if m > 0 else np.zeros(0, U64)


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of ascending, disjoint ranges; memory is bounded by the chunk or the longest range."""
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    while i < n:
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        out[i:j] = Rolling(buf[low : int(ends[j - 1])], base).ranges(starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def equal_ranges(buf: np.ndarray, starts: np.ndarray, other: np.ndarray, size: np.ndarray) -> bool:
    """Whether buf[starts[i] : starts[i] + size[i]] and buf[other[i] : other[i] + size[i]] have the same bytes for all i."""
    total = np.cumsum(size)
    for k in range(int(total[-1]) // CHUNK + 1 if len(size) else 0):
        a, b = np.searchsorted(total, [k * CHUNK, (k + 1) * CHUNK])
        long = np.flatnonzero(size[a:b] > 4096) + a
        if any(buf[starts[i] : starts[i] + size[i]].tobytes() != buf[other[i] : other[i] + size[i]].tobytes() for i in long):
            return False
        short = np.flatnonzero(size[a:b] <= 4096) + a
        n = size[short]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if not np.array_equal(buf[np.repeat(starts[short], n) + step], buf[np.repeat(other[short], n) + step]):
            return False
    return True


def classes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each of ascending, disjoint ranges, the same for two if and only if their bytes are: their hashes, once all ranges with
    one hash have been compared; if any of those differ, numbers by bytes."""
    found = hash_ranges(buf, starts, ends)
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    a, b = order[:-1][same], order[1:][same]
    size = ends[a] - starts[a]
    if np.array_equal(size, ends[b] - starts[b]) and equal_ranges(buf, starts[a], starts[b], size):
        return found
    numbers = {}
    return np.array([numbers.setdefault(buf[a:b].tobytes(), len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], U64)


class Block:
    """Whole texts, each followed by a line feed: text i is buf[first[i] : first[i + 1] - 1]."""

    def __init__(self, rows: pa.RecordBatch, texts: list[bytes]):
        self.rows, self.texts = rows, texts
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))).astype(np.int64)

    def __len__(self) -> int:
        return len(self.texts)

    def words(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the number of the first word of each text (one more at the end)."""
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = member[self.buf]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return starts, ends, np.searchsorted(starts, self.first)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The number of the text that holds each position."""
        return np.searchsorted(self.first, at, "right") - 1


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = MAX_BLOCK, most_rows: int = 1 << 30) -> Iterator[Block]:
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if pa.types.is_null(column.type):
            column = column.cast(pa.string())
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + 1
        total, i = np.cumsum(sizes), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
            j = min(j, i + most_rows)
            yield Block(batch.slice(i, j - i), as_bytes(column.slice(i, j - i)))
            i = j


def sums_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], also of empty ranges."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of n places, true inside any of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
