"""Vectorised kernels over the UTF-8 bytes of many texts at once.

Hashes are polynomial: a byte's value comes from a table of 64-bit words made by a rule, its weight is a power of an
odd number, and all arithmetic is modulo 2**64, so that any range's hash is a difference of prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_from(seed: int, n: int) -> np.ndarray:
    """n pseudo-random unsigned 64-bit words that depend on seed only."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(_BASE))


BYTE_VALUES = words_from(1, 256)
_upper = np.arange(256)
_upper[65:91] += 32
LOWER_VALUES = BYTE_VALUES[_upper]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        row = np.full(size, base, dtype=np.uint64)
        row[0] = 1
        have = _powers[base] = np.multiply.accumulate(row)
        if size > 8 * BLOCK_BYTES:  # one very long text: not kept
            del _powers[base]
    return have[:n]


def prefix(buf: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    weighted = values[buf]
    weighted *= powers(_BASE, len(buf))
    np.cumsum(weighted, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end)."""
    return mix((sums[end] - sums[start]) * powers(_BACK, len(sums))[start])


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Bytes of each value; null: empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together; a longer text is a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by sep (one byte), and each text's start; then the buffer's length."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=starts[1:])
    return np.frombuffer(sep.join(texts) + sep, dtype=np.uint8), starts


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Words of more bytes are hashed by a digest.
LONG_WORD = 64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words (runs of bytes that aren't ASCII white space) of a block of texts: hash, and count by text."""

    def __init__(self, texts: list[bytes], fold: bool = True):
        buf, starts = joined(texts)
        s, e = runs(~SPACE[buf])
        self.hash = range_hash(prefix(buf, LOWER_VALUES if fold else BYTE_VALUES), s, e)
        for k in np.flatnonzero(e - s > LONG_WORD).tolist():  # polynomial hashes of long strings can be made to collide
            word = buf[s[k] : e[k]].tobytes()
            self.hash[k] = int.from_bytes(hashlib.blake2b(word.lower() if fold else word, digest_size=8, key=b"word").digest(), "little")
        self.first = np.searchsorted(s, starts)  # of each text; then the number of words
        self.count = np.diff(self.first)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, text by text, and where each text's begin; a shorter text's only one is of all its words."""
        h, total = self.hash, len(self.hash)
        per = np.where(self.count >= n, self.count - n + 1, (self.count > 0).astype(np.int64))
        at = np.zeros(len(per) + 1, dtype=np.int64)
        np.cumsum(per, out=at[1:])
        weights = words_from(7, n) | np.uint64(1)
        full = np.zeros(max(0, total - n + 1), dtype=np.uint64)
        for j in range(n):
            full += h[j : j + len(full)] * weights[j]
        doc = np.repeat(np.arange(len(per)), per)
        index = np.arange(at[-1]) - at[doc] + self.first[doc]
        out = np.zeros(at[-1], dtype=np.uint64)
        long = self.count[doc] >= n
        out[long] = full[index[long]]
        for i in np.flatnonzero((self.count > 0) & (self.count < n)):
            w = h[self.first[i] : self.first[i + 1]]
            out[at[i]] = (w * weights[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
        return mix(out), at
