"""Word tokens of whole texts as numpy arrays: one pass over the bytes of an Arrow column.

A chunk of texts is one byte array; words are found by their edges, and a word's hash is a
difference of prefix sums, so the cost is a few vector operations per byte whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


@cache
def byte_codes(fold: bool) -> np.ndarray:
    """A random code per byte; with fold, A-Z have the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
    if fold:
        codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(0xC2B2AE3D27D4EB4F), Powers(0x9FB21C651E98DF25)


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=out[1:])
    return out


@dataclass
class Words:
    """The words of a chunk: hashes, byte edges, and for each text the place of its first word."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words inside a text, and the place of each one's first word."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        up, down = _WORDS.upto(n + 1)
        sums = _prefix(self.hashes * up[:n])
        hashes = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
        ends = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(np.arange(n - k + 1) + k <= ends[: n - k + 1])
        return hashes[at], at


def words_of(data: np.ndarray, bounds: np.ndarray, fold: bool) -> Words:
    """data: bytes of texts side by side; bounds: where each begins, and the end."""
    n = len(data)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _BYTES.upto(n + 1)
    sums = _prefix(byte_codes(fold)[data] * up[:n])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    return Words(data, hashes, starts, ends, np.searchsorted(starts, bounds))


def chunks(texts: pa.Array, fold: bool, most: int = 1 << 20) -> Iterator[tuple[int, int, Words]]:
    """(row, rows, words) of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        lo, hi = bounds[row], bounds[upto]
        yield row, upto - row, words_of(data[lo:hi], bounds[row : upto + 1] - lo, fold)
        row = upto


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in runs of about ``most`` bytes of a column, so that what is built for
    a run stays small however long texts are; a longer text is a run of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        upto = max(row + 1, int(np.searchsorted(size, (size[row - 1] if row else 0) + most, "right")))
        yield batch.slice(row, upto - row)
        row = upto
