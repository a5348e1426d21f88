"""Order-preserving packing of documents into training sequences by dynamic programming.

Documents are laid end to end in order of their ids; a sequence is a window of at most ``WINDOW``
tokens.  Windows may be cut behind a document (free), behind a sentence (``SENTENCE``) and, only inside
a sentence that is longer than a window, every ``STRIDE`` tokens (``HARD``).  The cuts minimise padding
plus these truncation penalties, both in tokens:

    best[j] = penalty[j] + WINDOW - pos[j] + min(best[i] + pos[i])   over pos[j] - WINDOW <= pos[i] < pos[j]

The minimum runs over a sliding range, so a monotone queue gives all of them in linear time.

Each range of document ids is one task's stream, and its cuts are the cheapest of the whole stream.  The
queue holds every place that a later window can begin at; where the cheapest ways to all of these have
a cut in common, all windows before it are final and leave the task.  That is looked for every
``STRETCH`` tokens, so a task holds a stretch and what is not settled yet, and only its last window is
left short.

Defined cases: a null or empty text is the end token alone; repeated rows are packed one by one; ids
that tie are ordered by their text, a null id comes first; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.llm import _encode, _text
from reelweave.llm._shared import bound_batches

WINDOW = 2048
SENTENCE, HARD, STRIDE = 4.0, 12.0, 32
STRETCH = 1 << 18
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


class Cutter:
    """The cheapest cuts of a stream that is handed over bit by bit."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.pos, self.best, self.back = [0], [0.0], [-1]
        self.queue: deque[tuple[float, int]] = deque([(0.0, 0)])

    def extend(self, positions: list[int], penalty: list[float]) -> None:
        """More places for cuts; positions rise and are at most ``window`` apart."""
        pos, best, back, queue, window = self.pos, self.best, self.back, self.queue, self.window
        for p, cost in zip(positions, penalty, strict=True):
            while pos[queue[0][1]] < p - window:
                queue.popleft()
            least, i = queue[0]
            key = cost + window + least
            while queue and queue[-1][0] >= key:
                queue.pop()
            queue.append((key, len(pos)))
            pos.append(p)
            best.append(key - p)
            back.append(i)

    def settled(self) -> int:
        """The last place that the cheapest ways to all places in the queue share."""
        open_ = [-i for _, i in self.queue]
        heapq.heapify(open_)
        while len(open_) > 1:
            i = -heapq.heappop(open_)
            while open_ and -open_[0] == i:
                heapq.heappop(open_)
            if not open_:
                return i
            heapq.heappush(open_, -self.back[i])
        return -open_[0]

    def way(self, j: int) -> list[int]:
        """Positions of the cuts up to place j."""
        out = []
        while j > 0:
            out.append(self.pos[j])
            j = self.back[j]
        return out[::-1]

    def forget(self, j: int) -> None:
        """Drop all places before j, which is a cut from now on."""
        self.pos, self.best = self.pos[j:], self.best[j:]
        self.back = [-1, *(b - j for b in self.back[j + 1 :])]
        self.queue = deque((key, i - j) for key, i in self.queue)


def cuts(positions: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> tuple[list[int], float]:
    """Positions of the cheapest cuts of the stream from 0 to the last position, which is always a cut, and their cost."""
    c = Cutter(window)
    c.extend(positions.tolist(), penalty.tolist())
    return c.way(len(c.pos) - 1), c.best[-1]


def with_hard_cuts(positions: np.ndarray, penalty: np.ndarray, start: int, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Add hard cuts wherever two positions are more than a window apart."""
    gap = np.diff(positions, prepend=start)
    extra = np.where(gap > window, -(-gap // stride) - 1, 0)
    if not extra.any():
        return positions, penalty
    k = _text.ragged(np.ones(len(extra), np.int64), extra)
    hard = np.repeat(positions - gap, extra) + k * stride
    order = np.argsort(np.concatenate([positions, hard]), kind="stable")
    return np.concatenate([positions, hard])[order], np.concatenate([penalty, np.full(len(hard), HARD)])[order]


class Stream:
    """A task's documents in order; yields the pieces of finished windows."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.sequence, self.cutter = first_sequence, Cutter(window)
        self.docs: deque = deque()  # (doc_id, ids, begin)
        self.size = self.done = 0  # tokens in all, tokens in finished windows

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        """ends: lengths of the document's prefixes that end with a sentence."""
        ends = ends[(ends > 0) & (ends < len(ids))]
        pos, pen = with_hard_cuts(self.size + np.append(ends, len(ids)), np.append(np.full(len(ends), SENTENCE), 0.0), self.size, self.cutter.window)
        self.cutter.extend(pos.tolist(), pen.tolist())
        self.docs.append((doc_id, ids, self.size))
        self.size += len(ids)

    def finished(self, last: bool) -> list[tuple]:
        """Rows of SCHEMA for the windows that no later document can change; of all with ``last``."""
        j = len(self.cutter.pos) - 1 if last else self.cutter.settled()
        rows = []
        for end in self.cutter.way(j):
            at = self.done
            while at < end:
                doc_id, ids, begin = self.docs[0]
                to = min(end, begin + len(ids))
                piece = ids[at - begin : to - begin]
                rows.append((doc_id, at - begin, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids), self.sequence, at - self.done))
                if to == begin + len(ids):
                    self.docs.popleft()
                at = to
            self.sequence, self.done = self.sequence + 1, end
        self.cutter.forget(j)
        return rows


#: Rows of one id (null, say) are dealt to tasks by their texts' first characters, which keeps the order of id and text.
HEAD = 64


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: where it starts and which sequence holds it at which offset."""

    def run(batches):
        enc = _encode.encoder(vocabulary, True)
        stream, seen = Stream(TaskContext.get().partitionId() << 40), 0
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for block in _text.blocks(batch.column(1), max_bytes=_text.SMALL_BYTES):
                ids, size, doc, start, end = enc.encode(block)
                ends = np.cumsum(size)
                first = np.searchsorted(doc, np.arange(block.n + 1))
                total = np.concatenate([[0], ends])[first]
                # a sentence ends behind a stop, and before a chunk that starts a line
                stop = _STOP[block.data[end - 1]]
                stop[:-1] |= block.data[start[1:]] == 10
                for i in range(block.n):
                    own = np.append(ids[total[i] : total[i + 1]], np.uint32(end_id))
                    inside = slice(first[i], first[i + 1])
                    stream.add(ids_of[block.first + i], own, ends[inside][stop[inside]] - total[i])
                    if stream.size - seen >= STRETCH:
                        seen = stream.size
                        yield from _rows(stream.finished(False))
                        _text.trim()
        yield from _rows(stream.finished(True))

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartitionByRange("doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)


def _rows(rows: list[tuple]):
    if rows:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
