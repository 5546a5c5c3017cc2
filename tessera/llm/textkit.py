"""Vectorised word hashing for batches of whole texts.

Words are hashed from their UTF-8 bytes with NumPy, many texts at a time, so
no Python object is made for a word.  Work is cut into chunks of about
``CHUNK_BYTES``; a single longer text makes a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
CHUNK_DOCS = 4_000

#: Byte tables: separators become a space, A-Z becomes a-z where asked.
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
KEEP_CASE = bytes(0x20 if b in _SPACES else b for b in range(256))
LOWER = bytes(0x20 if b in _SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 0x20
    for b in range(256)
)

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20_240_611).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche (public-domain constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` with about ``most`` bytes each."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and (size + len(t) > most or i - begin >= CHUNK_DOCS):
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def slices(batch, rows: int = 1_000) -> Iterator:
    """An Arrow batch in slices, so that few texts are copied to Python objects at once.

    After the batch, freed memory goes back to the system: workers live on
    between stages, and what they hold counts against the executor.
    """
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


class Words:
    """The words of some texts: ``hash`` and, for text i, the range
    ``first[i]:first[i + 1]``; ``start``/``end`` are byte positions in ``buffer``."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.buffer = b" ".join(texts).translate(table) + b" "
        raw = np.frombuffer(self.buffer, np.uint8)
        inside = np.empty(len(raw) + 1, bool)
        inside[0] = False
        np.not_equal(raw, 32, out=inside[1:])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        length = self.end - self.start
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        self.first = np.searchsorted(self.start, at)
        self.bytes_at = at
        if not len(length):
            self.hash = np.empty(0, np.uint64)
            return
        begin = np.zeros(len(length), np.int64)
        np.cumsum(length[:-1], out=begin[1:])
        total = int(length.sum())
        within = np.arange(total) - np.repeat(begin, length)
        value = _BYTE[raw[inside[1:]]] * _powers(int(length.max()))[within]
        self.hash = mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (text ends are ignored)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[k : k + m]
    return mix(out)


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``begin[i] .. begin[i] + length[i]``."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    at = np.cumsum(length) - length
    return np.arange(total) + np.repeat(begin - at, length)
