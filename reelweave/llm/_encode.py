"""Whole texts to token ids by a public tokenizer, each distinct chunk of text encoded once.

A byte-level or word-level BPE never merges across certain places: behind a word, before white space.
Texts are cut there, equal chunks are found by their hashes, and only chunks that a worker has not
seen go through the tokenizers library; ids are then gathered with numpy.  The table of seen chunks
has a fixed number of slots, so memory is bounded; chunks without a slot are encoded again.  Ids are
kept in two bytes each as long as all are below 2^16.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain

import numpy as np

from reelweave.llm import _text

_EMPTY = ~np.uint64(0)
LONGEST = 1 << 14  # bytes of a chunk that is kept: its ids are surely fewer than 2^16


class Encoder:
    """encode: joined ids and their numbers of a list of strings; keep_space: white space before a word belongs to its chunk (byte-level BPE); else it is dropped."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep_space: bool, bits: int = 21):
        self.encode_all = encode
        self.keep_space, self.bits = keep_space, bits
        self.keys = np.full(1 << bits, _EMPTY)
        self.at = np.zeros(1 << bits, np.uint32)
        self.size = np.zeros(1 << bits, np.uint16)
        self.pool, self.used = np.zeros(1 << 20, np.uint16), 0

    def chunks(self, block: _text.Block) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of each chunk; they cover all words, and all bytes with keep_space."""
        if not self.keep_space:
            return block.words()
        data = block.data
        space = _text._SPACE[data]
        # white space behind a character that is surely not white space; Unicode has some of two and three bytes
        sure = ~space & ((data < 0x80) & (data > 0x20) | (data >= 0x80))
        odd = np.zeros(len(data), bool)
        odd[1:] = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        odd[2:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & (sure & ~odd)[:-1]
        cut[block.end] = False
        cut[block.start[block.end > block.start]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        # a document's last chunk ends at the added line feed
        stop = block.end[block.doc_of(start)]
        return start, np.minimum(end, stop)

    def _add(self, block: _text.Block, start: np.ndarray, end: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Encode some chunks into the pool from ``used`` on: places, sizes, new end."""
        ids, size = self.encode_all([block.text(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        total = len(ids)
        if total and self.pool.dtype == np.uint16 and ids.max() >= 1 << 16:
            self.pool = self.pool.astype(np.uint32)
        if used + total > len(self.pool):
            # in place: no view of the pool is held anywhere
            self.pool.resize(used + total + len(self.pool) // 4, refcheck=False)
        self.pool[used : used + total] = ids
        return used + np.cumsum(size) - size, size, used + total

    def encode(self, block: _text.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of the block's texts, joined; ids of each chunk and its document; chunks' starts and ends."""
        start, end = self.chunks(block)
        h = block.hashes(start, end)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = self.keys[slot] == h
        free = np.flatnonzero(~hit & (self.keys[slot] == _EMPTY) & (end - start <= LONGEST)) if self.used < 1 << 31 else ()
        if len(free):
            _, first = np.unique(slot[free], return_index=True)
            free = free[first]
            self.keys[slot[free]] = h[free]
            self.at[slot[free]], self.size[slot[free]], self.used = self._add(block, start[free], end[free], self.used)
            hit = self.keys[slot] == h
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        rest = np.flatnonzero(~hit)
        if len(rest):
            _, first, of = np.unique(h[rest], return_index=True, return_inverse=True)
            a, s, _ = self._add(block, start[rest[first]], end[rest[first]], self.used)
            at[rest], size[rest] = a[of], s[of]
        return self.pool[_text.ragged(at, size)].astype(np.uint32), size, block.doc_of(start), start, end


def by_library(tokenizer) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Joined ids and their numbers of a list of strings by the tokenizers library."""

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size

    return run


_held: dict = {}
#: What frees the tables that this worker holds for encoding.
releases: list[Callable[[], None]] = [_held.clear]


def release() -> None:
    """Free the worker's encoders: called by operators that have no use for them, and before another one is made."""
    for f in releases:
        f()
    _text.trim()


def encoder(path: str, keep_space: bool, bits: int = 21) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives tasks until another operator releases it."""
    if (path, keep_space) not in _held:
        release()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _held[path, keep_space] = Encoder(by_library(Tokenizer.from_file(path)), keep_space, bits)
        _text.trim()
    return _held[path, keep_space]
