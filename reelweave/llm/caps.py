"""Embedding near-duplicates by spherical-cap filters with random product codes.

Unit vectors are turned by a random rotation and cut into ``BLOCKS`` blocks; each block has its own
random code of unit words, and a filter direction is one word from each block.  A vector falls into a
filter if its inner product with that direction reaches ``cut``; the filters of a vector are
list-decoded by joining blocks and dropping partial sums that can't reach the cut any more, so the
direction set (words ** BLOCKS) is never enumerated.  Vectors with a high cosine share many caps.

The cut and the number of words follow from the number of vectors: caps are sized to hold about
``CAP`` of evenly spread vectors, and the codes are large enough that a pair at the threshold shares
``COMMON`` caps on average, by exact figures of the sphere, so the work per vector stays even as the
table grows.  That is a mean, and the caps of one code depend on each other, so there are ``CODES``
codes with rotations of their own, and none of them leaves a vector out (see below).

Equal vectors are one with a weight.  Members of a filter are dealt into chunks of about ``CHUNK``, and
pairs of chunks are compared in tiles by matrix products: in single precision with room for its error
first, what is left in double precision.  A pair that shares several filters counts in the first of
them only, so a member carries the numbers of its earlier filters: it is a prefix of its vector's
record (key, weight, numbers, filters).  A comparison yields sums for each vector (links, smallest linked
key), not pairs; a filter of up to ``CHUNK`` members holds each once, a denser one once for each chunk.
A vector that fewer than ``LEAST`` caps of a code take is put into its ``LEAST`` best ones, as if by a
lower cut.  So is its partner, if it needs to be: each vector's caps contain its ``LEAST`` best of each
code, and near vectors share some of these.

Defined cases: null, zero or non-finite vectors link with nothing; a vector of another length than
most has a space of its own; repeated rows of one id are vectors of their own that link with each
other; labels and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from reelweave.llm import _text
from reelweave.llm._shared import components, written

THRESHOLD = 0.95
BLOCKS = 3
CAP = 256
COMMON = 28
CODES = 3
LEAST = 16
CHUNK = 4096
TILE = 512
#: Partial sums that list decoding holds at once.
SUMS = 1 << 22


class Code:
    """Rotations and block codes for one dimension, drawn from a seed."""

    def __init__(self, dim: int, words: int, cut: float, seed: int = 9):
        self.words, self.cut = words, cut
        self.parts = np.array_split(np.arange(dim), blocks_of(dim))
        self.size = words ** len(self.parts)
        self.codes = []
        for k in range(CODES if words > 1 else 1):
            rng = np.random.default_rng([seed, dim, words, k])
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            books = []
            for part in self.parts:
                w = rng.standard_normal((words, len(part)))
                # a direction is one word of each block: scaled so that all directions have length 1
                books.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt(len(part) / dim))
            self.codes.append((turn, books))
        self.kind = self.number_kind(dim, words)
        # the r best sums of one number from each list have ranks whose product is r at most
        self.least = min(LEAST, self.size)
        ranks = np.indices([min(words, self.least)] * len(self.parts)).reshape(len(self.parts), -1)
        self.ranks = ranks[:, (ranks + 1).prod(0) <= self.least]

    @staticmethod
    def number_kind(dim: int, words: int) -> type:
        """Type of the numbers of all filters."""
        return np.int32 if CODES * words ** blocks_of(dim) < 1 << 31 else np.int64

    def filters(self, v: np.ndarray) -> list[int]:
        """Sorted numbers of all directions with which v has an inner product of ``cut`` or more, and of the LEAST best of each code."""
        return self.decode(v[None, :])[0].tolist()

    def decode(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``filters`` of each row of m, joined, and their numbers."""
        step = max(1, SUMS // self.words ** min(2, len(self.parts)))
        some = [self._rows(m[a : a + step]) for a in range(0, len(m), step)]
        return np.concatenate([np.zeros(0, np.int64), *[x for x, _ in some]]), np.concatenate([np.zeros(0, np.int64), *[n for _, n in some]])

    def _rows(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self._of_code(m, k) for k in range(len(self.codes))]
        row, number = np.concatenate([r for r, _ in found]), np.concatenate([n + k * self.size for k, (_, n) in enumerate(found)])
        return number[np.lexsort((number, row))], np.bincount(row, minlength=len(m))

    def _of_code(self, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of m and the numbers of their filters."""
        turn, books = self.codes[k]
        x = m @ turn
        dots = [x[:, p] @ b.T for p, b in zip(self.parts, books, strict=True)]
        ahead = [sum((d.max(1) for d in dots[at + 1 :]), np.zeros(len(m))) for at in range(len(dots))]  # best that later blocks can add
        row, number, total = np.arange(len(m)), np.zeros(len(m), np.int64), np.zeros(len(m))
        for d, rest in zip(dots, ahead, strict=True):
            s = total[:, None] + d[row]
            i, w = np.nonzero(s + rest[row, None] >= self.cut)
            row, number, total = row[i], number[i] * self.words + w, s[i, w]
        few = np.bincount(row, minlength=len(m)) < self.least
        kept, short = ~few[row], np.flatnonzero(few)
        best = self._best([d[short] for d in dots])
        return np.concatenate([row[kept], np.repeat(short, best.shape[1])]), np.concatenate([number[kept], best.ravel()])

    def _best(self, dots: list[np.ndarray]) -> np.ndarray:
        """The ``least`` best numbers of each row."""
        number, total = np.zeros((len(dots[0]), self.ranks.shape[1]), np.int64), np.zeros((len(dots[0]), self.ranks.shape[1]))
        for d, rank in zip(dots, self.ranks, strict=True):
            word = np.argsort(-d, axis=1, kind="stable")[:, rank]
            number, total = number * self.words + word, total + np.take_along_axis(d, word, 1)
        return np.take_along_axis(number, np.argsort(-total, axis=1, kind="stable")[:, : self.least], 1)


def blocks_of(dim: int) -> int:
    """Blocks of at least four dimensions: fewer than BLOCKS for short vectors."""
    return max(1, min(BLOCKS, dim // 4))


def _tail(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of [-1, 1] and the share of the sphere whose inner product with a fixed direction is beyond each."""
    angle = np.linspace(np.pi, 0, 20001)
    density = np.sin(angle) ** max(dim - 2, 0)
    mass = np.concatenate([[0.0], np.cumsum(((density[1:] + density[:-1]) / 2)[::-1])])[::-1]
    return np.cos(angle), mass / mass[0]


def plan(n: int, dim: int, threshold: float = THRESHOLD) -> tuple[int, float]:
    """Words for each block and the cut, for n vectors: see the module."""
    if dim < 2:
        return 1, -2.0  # two directions in all
    at, beyond = _tail(dim)
    share = min(0.01, CAP / max(n, 1))
    cut = min(float(at[np.argmax(beyond <= share)]), 0.7)
    # chance that the second of a pair is in a cap that holds the first, over all places of the first in it
    x = at[at >= cut]
    weight = -np.diff(np.interp(x, at, beyond), append=0.0)
    rest = math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(1 - x * x, 1e-300))
    both = float(weight @ np.interp((cut - threshold * x) / rest, *_tail(dim - 1)) / weight.sum())
    words = math.ceil((COMMON / CODES / (float(np.interp(cut, at, beyond)) * both)) ** (1 / blocks_of(dim)))
    return words, cut


def _raw(column: pa.Array, kind: type) -> tuple[list[bytes | None], list[int]]:
    """Bytes of each vector, None for those that link with nothing, and their lengths."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = pc.list_flatten(column)
    value = np.asarray(flat.fill_null(np.nan)).astype(kind) + kind(0)  # one zero of the two
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.concatenate([[0], np.cumsum(size)])])
    good = (sums(~np.isfinite(value)) == 0) & (sums(value != 0) > 0)
    data, width, ends = value.tobytes(), np.dtype(kind).itemsize, np.cumsum(size)
    out = [data[(e - s) * width : e * width] if g else None for e, s, g in zip(ends.tolist(), size.tolist(), good.tolist(), strict=True)]
    return out, np.where(good, size, 0).tolist()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins and the last one ends."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _local(near: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric boolean matrix: its smallest member."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label, len(label)).min(1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


class Members:
    """Members of a pair of chunks, read from their records."""

    def __init__(self, records: pa.Array, dim: int, kind: type, number: type):
        self.data, at = _bytes(records)
        self.start, self.number = at[:-1] + 16 + dim * np.dtype(kind).itemsize, np.dtype(number)
        self.size = (at[1:] - self.start) // self.number.itemsize
        head = self.data[at[:-1, None] + np.arange(16 + dim * np.dtype(kind).itemsize)]
        self.key, self.weight = head[:, :8].copy().view(np.int64)[:, 0], head[:, 8:16].copy().view(np.int64)[:, 0]
        self.unit = _unit(head[:, 16:].copy().view(kind))

    def early(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Earlier filters of some rows, joined, and their numbers."""
        width, size = self.number.itemsize, self.size[rows]
        return self.data[_text.ragged(self.start[rows], size * width)].view(self.number), size

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which rows of a and of b have an earlier filter in common."""
        value, size = self.early(np.concatenate([a, b]))
        _, rank = np.unique(value, return_inverse=True)
        seen = np.zeros((len(size), int(rank.max(initial=-1)) + 1), np.float32)
        seen[np.repeat(np.arange(len(size)), size), rank] = 1
        return seen[: len(a)] @ seen[len(a) :].T > 0.5

    def compare(self, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows with links, their weights of links, and the first row of their component here.

        side: None for one chunk with itself, else which of two chunks each row is in.  A pair that
        shares an earlier filter has been counted there.
        """
        n, low = len(self.key), self.unit.astype(np.float32)
        room = 1e-6 + 2e-7 * self.unit.shape[1]
        count, ends = np.zeros(n, np.int64), [np.zeros((2, 0), np.int64)]
        groups = [np.arange(n)] if side is None else [np.flatnonzero(side == x) for x in np.unique(side)]
        tiles = [[g[a : a + TILE] for a in range(0, len(g), TILE)] for g in groups]
        if side is None:
            pairs = [(x, y) for k, x in enumerate(tiles[0]) for y in tiles[0][k:]]
        else:
            pairs = [(x, y) for x in tiles[0] for y in tiles[1]] if len(tiles) == 2 else []
        for x, y in pairs:
            near = low[x] @ low[y].T >= threshold - room
            same = x is y
            if same:
                np.fill_diagonal(near, False)
            r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(r):
                continue
            x, y = x[r], y[c]
            near = self.unit[x] @ self.unit[y].T >= threshold
            if same:
                np.fill_diagonal(near, False)
            near &= ~self._shared(x, y)
            count[x] += near @ self.weight[y]
            if not same:
                count[y] += self.weight[x] @ near
                square = np.zeros((len(x) + len(y),) * 2, bool)
                square[: len(x), len(x) :], square[len(x) :, : len(x)] = near, near.T
                near, x = square, np.concatenate([x, y])
            ends.append(np.stack([x, x[_local(near)]]))
        a, b = np.concatenate(ends, 1)
        label = np.arange(n)
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        rows = np.flatnonzero(count)
        return rows, count[rows], label[rows]


def links(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    kind = np.float32 if vectors.schema[embedding].dataType.simpleString() == "array<float>" else np.float64

    @arrow_udf("struct<raw:binary,dim:int>")
    def read(column: pa.Array) -> pa.Array:
        raw, dim = _raw(column, kind)
        return pa.StructArray.from_arrays([pa.array(raw, pa.binary()), pa.array(dim, pa.int32())], ["raw", "dim"])

    known = F.col(embedding) if kind is np.float32 else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), read(known).alias("u")).select("vec_id", "u.raw", "u.dim").withColumn("key", F.xxhash64("raw"))
    rows = written(rows, "vectors")
    distinct = rows.where("raw IS NOT NULL").groupBy("key", "raw", "dim").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    distinct = written(distinct, "distinct")
    # one row for each length of vectors
    plans = {d: plan(n, d, threshold) for d, n in distinct.groupBy("dim").count().collect()}

    def decode(batches):
        codes = {d: Code(d, *p) for d, p in plans.items()}
        for batch in batches:
            key, weight, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "weight", "dim"))
            data, at = _bytes(batch.column("raw"))
            for dim in np.unique(dims).tolist():
                rows, width = np.flatnonzero(dims == dim), dim * np.dtype(kind).itemsize
                raw = data[at[rows, None] + np.arange(width)]
                number, size = codes[dim].decode(_unit(raw.view(kind)))
                short = codes[dim].kind
                head = np.concatenate([np.stack([key[rows], weight[rows]], 1).view(np.uint8), raw], 1)
                parts, of = number.astype(short).tobytes(), np.concatenate([[0], np.cumsum(size)])
                # a record is its head and all its filters; a member is cut where its filter begins
                records = [h.tobytes() + parts[a * np.dtype(short).itemsize : b * np.dtype(short).itemsize] for h, a, b in zip(head, of[:-1].tolist(), of[1:].tolist(), strict=True)]
                cut = head.shape[1] + (np.arange(len(number)) - np.repeat(of[:-1], size)) * np.dtype(short).itemsize
                places = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays([pa.array(number), pa.array(cut.astype(np.int32))], ["f", "cut"]))
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(np.full(len(rows), dim, np.int32)), pa.array(records, pa.binary()), places], ["key", "dim", "record", "places"])

    decoded = written(distinct.select("key", "raw", "dim", "weight").mapInArrow(decode, "key long, dim int, record binary, places array<struct<f:long,cut:int>>"), "decoded")
    # as a table its size is known before the join, so members are shuffled for it only where it is large
    dense = written(decoded.select("dim", F.explode("places.f").alias("f")).groupBy("dim", "f").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK), "dense")
    member = decoded.select("key", "dim", "record", F.inline("places")).withColumn("record", F.substring("record", F.lit(1), F.col("cut")))
    # the members of a dense filter are dealt into chunks of about CHUNK; each pair of chunks is compared once
    member = member.join(dense, ["dim", "f"], "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / CHUNK).cast("int"), F.lit(1))).withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = member.select("dim", "f", "own", "record", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("dim", "f", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "record")
    group = ["dim", "f", "i", "j"]

    def compare(batches):
        kinds = {d: Code.number_kind(d, p[0]) for d, p in plans.items()}

        def verdict(of, own, records):
            own = np.concatenate(own)
            if len(own) > 1:
                members = Members(pa.concat_arrays(records), of[0], kind, kinds[of[0]])
                at, n, first = members.compare(None if of[2] == of[3] else own, threshold)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(members.key[at]), pa.array(n), pa.array(members.key[first])], ["key", "n", "first"])

        last, own, records = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in group], 1)
            edge = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            chunk, record = batch.column("own").to_numpy(), batch.column("record")
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if b > a:
                    of = tuple(keys[a].tolist())
                    if of != last:
                        if last:
                            yield from verdict(last, own, records)
                        last, own, records = of, [], []
                    own.append(chunk[a:b])
                    records.append(record.slice(a, b - a))
        if last:
            yield from verdict(last, own, records)

    found = written(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "key long, n long, first long"), "found")
    joined = components(found.select(F.col("key").alias("a"), F.col("first").alias("b")))
    degree = found.groupBy("key").agg(F.sum("n").alias("n"))
    named = distinct.select("key", "low", "weight").join(degree, "key", "left").join(joined.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    verdict = written(named.join(lows, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "verdict")
    out = rows.select("vec_id", F.when(F.col("raw").isNotNull(), F.col("key")).alias("key")).join(verdict, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
