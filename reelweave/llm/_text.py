"""Vectorised views of a batch of texts: bytes, words, lines and their 64-bit hashes.

Everything works on whole texts.  An Arrow batch is walked in blocks of whole documents of about
``max_bytes`` bytes (a larger document is a block of its own), so memory is bounded by the block
and the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: Blocks of operators that hold many arrays of a block at once: each byte has 8 in every one of them.
SMALL_BYTES = 1 << 18
try:
    _libc = ctypes.CDLL(None)
except OSError:
    _libc = None


def trim() -> None:
    """Give the free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base modulo 2^64, and of its inverse; grown once and kept by the worker."""
    if len(_powers[0]) < n:
        n = max(n + n // 2, SMALL_BYTES + SMALL_BYTES // 2)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Some whole documents as one byte array, a line feed after each one.

    ``first`` is the position of the block's first document in its batch; ``start[i]:end[i]`` are
    the bytes of document i, ``end[i]`` being the place of the added line feed.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, first: int, fold: bool = False):
        n = len(sizes)
        self.first, self.n = first, n
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        keep = np.ones(len(data) + n, bool)
        keep[self.end] = False
        self.data = np.full(len(data) + n, 10, np.uint8)
        self.data[keep] = _FOLD[data] if fold else data
        self._sums = None

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        """The document of each byte position."""
        return np.searchsorted(self.end, places, side="left")

    def words(self, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end byte of each word, in order; ``between`` marks the byte values that stand between words."""
        full = ~between[self.data]
        edge = np.flatnonzero(full[1:] != full[:-1]) + 1
        if len(full) and full[0]:
            edge = np.concatenate([[0], edge])
        return edge[::2], edge[1::2]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end byte of each line; the added line feeds end documents' last lines."""
        end = np.flatnonzero(self.data == 10)
        start = np.empty_like(end)
        start[:1], start[1:] = 0, end[:-1] + 1
        return start, end

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range: a polynomial in an odd base from prefix sums, then scrambled."""
        if self._sums is None:
            up, _ = powers(len(self.data) + 1)
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[self.data] * up[: len(self.data)], dtype=np.uint64)])
        _, down = powers(len(self.data) + 1)
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8")


def blocks(texts: pa.Array, fold: bool = False, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of an Arrow string array, nulls read as empty; fold lower-cases A to Z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + max_bytes, side="right")) - 1)
        yield Block(data[at[i] : at[j]], np.diff(at[i : j + 1]), i, fold)
        i = j


def per_doc(n: int, docs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights (or a count) for each of n documents, as int64."""
    return np.bincount(docs, weights, n).astype(np.int64)


def repeats(docs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in text order: how many equal ones the document holds before each, and in all."""
    key = mix(h ^ mix(docs.astype(np.uint64) + np.uint64(0x51ED27)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    size = np.diff(np.append(start, len(k)))
    before, total = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    before[order] = np.arange(len(k)) - start[group] if len(k) else 0
    total[order] = size[group] if len(k) else 0
    return before, total


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each range, joined."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    if len(s):
        ends = np.cumsum(n)
        out[0] = s[0]
        out[ends[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
