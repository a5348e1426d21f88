"""Token ids in wavelet-matrix files: one compressed file per shard, with rank and select.

A wavelet matrix keeps the bits of all ids plane by plane, highest bit first; before each next plane
the ids are split stably into those with a 0 and those with a 1.  A plane is stored in blocks of ``STEP``
bits, each compressed alone, and the file's directory has for each block where it lies and the number
of ones before it.  So a file answers ``access`` (the id at a place), ``count`` (how often an id occurs
before a place) and ``select`` (where its k-th occurrence is) in one block per plane, and ``decode``
gives all ids by undoing the splits.

A file is ``MAGIC``, six unsigned 64-bit numbers (ids, planes, documents, bytes of the document table, of
the directory, of the blocks), the document table (token counts, ids, which ids are null), the directory
(for each block of each plane the bytes and ones before it) and the blocks; table and directory are
compressed as well.

Shards are ranges of ascending doc_id of about ``SHARD`` tokens, written as one row each of a Parquet
table (part, shard, n_docs, n_tokens, file), so the commit protocol of Spark's writers covers them and any
store that Spark reaches will do; ``file`` holds the bytes of one file.

Defined cases: a null or empty text is the end token alone; repeated rows are encoded one by one, ties
of doc_id ordered by text, null ids first; other columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelweave.llm import _encode, _text
from reelweave.llm._shared import bound_batches

MAGIC = b"RWWM0002"
SHARD = 1 << 21
STEP = 1 << 16
END_ID = 2
TABLE = "part int, shard int, n_docs long, n_tokens long, file binary"


def build(ids: np.ndarray, sizes: np.ndarray, docs: list | None = None) -> bytes:
    """The file of the given ids, which are the joined documents of the given sizes and names (integers or null)."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    squeeze = zstandard.ZstdCompressor(level=1).compress
    docs = [None] * len(sizes) if docs is None else docs
    null = np.array([d is None for d in docs], bool)
    table = squeeze(sizes.astype("<u4").tobytes() + np.array([0 if d is None else d for d in docs], "<i8").tobytes() + null.tobytes())
    kind = np.uint16 if planes <= 16 else np.uint32
    parts, ones, now = [], [], ids.astype(kind)
    for k in range(planes - 1, -1, -1):
        bit = (now & kind(1 << k)) != 0
        packed = np.packbits(bit, bitorder="little")
        parts += [squeeze(packed[s : s + STEP // 8].tobytes()) for s in range(0, len(packed), STEP // 8)]
        in_blocks = np.add.reduceat(bit, np.arange(0, len(bit), STEP), dtype=np.int64) if len(bit) else np.zeros(0, np.int64)
        ones.append(np.cumsum(in_blocks) - in_blocks)
        total = int(in_blocks.sum())
        if k and 0 < total < len(bit):
            split = np.empty_like(now)
            np.compress(~bit, now, out=split[: len(bit) - total])
            np.compress(bit, now, out=split[len(bit) - total :])
            now = split
    size = np.array([len(p) for p in parts], np.int64)
    directory = squeeze((np.cumsum(size) - size).astype("<u8").tobytes() + np.concatenate(ones).astype("<u8").tobytes())
    return MAGIC + struct.pack("<6Q", len(ids), planes, len(sizes), len(table), len(directory), int(size.sum())) + table + directory + b"".join(parts)


class Wavelet:
    """Reads one file: its tables at once, a block when it is first asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        self.n, self.planes, self.n_docs, table, directory, total = struct.unpack_from("<6Q", data, 8)
        self._data, self._base = data, 56 + table + directory
        self.blocks = -(-self.n // STEP)
        self._open = zstandard.ZstdDecompressor()
        raw = self._open.decompress(data[56 : 56 + table], max_output_size=13 * self.n_docs or 1)
        self.sizes = np.frombuffer(raw, "<u4", self.n_docs).astype(np.int64)
        self.docs = pa.array(np.frombuffer(raw, "<i8", self.n_docs, 4 * self.n_docs), mask=np.frombuffer(raw, bool, self.n_docs, 12 * self.n_docs))
        raw = self._open.decompress(data[56 + table : self._base], max_output_size=16 * self.planes * self.blocks or 1)
        cells = self.planes * self.blocks
        self._at = np.append(np.frombuffer(raw, "<u8", cells), np.uint64(total)).astype(np.int64)
        self._before = np.frombuffer(raw, "<u8", cells, 8 * cells).astype(np.int64).reshape(self.planes, self.blocks)
        self._held: dict = {}

    def block(self, k: int, b: int) -> np.ndarray:
        """Packed bits of block b of plane k."""
        if (k, b) not in self._held:
            self._held[k, b] = self._unpacked(k, b)
        return self._held[k, b]

    def _unpacked(self, k: int, b: int) -> np.ndarray:
        a, z = self._at[k * self.blocks + b : k * self.blocks + b + 2] + self._base
        return np.frombuffer(self._open.decompress(self._data[a:z], max_output_size=STEP // 8), np.uint8)

    def bits(self, k: int) -> np.ndarray:
        """All bits of plane k."""
        packed = np.concatenate([np.zeros(0, np.uint8), *[self._unpacked(k, b) for b in range(self.blocks)]])
        return np.unpackbits(packed, count=self.n, bitorder="little").view(bool)

    def zeros(self, k: int) -> int:
        """Zeros of plane k."""
        return self.n - self._ones(k, self.n)

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        if not i:
            return 0
        b = (i - 1) // STEP
        packed, i = self.block(k, b), i - b * STEP
        rest = int(packed[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(self._before[k, b]) + int(np.bitwise_count(packed[: i // 8]).sum()) + rest.bit_count()

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.planes):
            bit = int(self.block(k, i // STEP)[i % STEP // 8]) >> i % 8 & 1
            ones = self._ones(k, i)
            out, i = out * 2 + bit, self.zeros(k) + ones if bit else i - ones
        return out

    def count(self, token: int, i: int | None = None) -> int:
        """How often a token occurs before place i (in all, if none is given)."""
        if token >> self.planes:
            return 0
        a, b = 0, self.n if i is None else i
        for k in range(self.planes):
            oa, ob = self._ones(k, a), self._ones(k, b)
            a, b = (self.zeros(k) + oa, self.zeros(k) + ob) if token >> (self.planes - 1 - k) & 1 else (a - oa, b - ob)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence of a token, from 0."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        a, path = 0, []
        for k in range(self.planes):
            bit = token >> (self.planes - 1 - k) & 1
            a = self.zeros(k) + self._ones(k, a) if bit else a - self._ones(k, a)
            path.append(bit)
        i = a + nth
        for k in range(self.planes - 1, -1, -1):
            i = self._select_bit(k, path[k], i - self.zeros(k) if path[k] else i)
        return i

    def _select_bit(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth one or zero of plane k, found in its block."""
        before = self._before[k] if bit else np.arange(self.blocks) * STEP - self._before[k]
        b = int(np.searchsorted(before, nth, side="right")) - 1
        part = np.unpackbits(self.block(k, b), bitorder="little")[: self.n - b * STEP]
        return b * STEP + int(np.flatnonzero(part == bit)[nth - int(before[b])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: from the lowest plane up, zeros and ones go back to where the plane above had them."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.planes - 1, -1, -1):
            bit = self.bits(k)
            zeros = self.n - np.count_nonzero(bit)
            up = np.empty(self.n, kind)
            up[~bit] = now[:zeros]
            up[bit] = now[zeros:] | kind(1 << (self.planes - 1 - k))
            now = up
        return now.astype(np.uint32)


#: Rows of one id (null, say) are dealt to tasks by their texts' first characters, which keeps the order of id and text.
HEAD = 64


def encode_shards(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Shard files (rows of TABLE) of all documents in ascending doc_id order."""

    def run(batches):
        enc = _encode.encoder(vocabulary, False, 22)
        part, shard = TaskContext.get().partitionId(), 0
        ids_held, sizes_held, docs_held, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.concatenate(sizes_held)
            file = build(np.concatenate(ids_held), sizes, docs_held)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(sizes)]), pa.array([int(sizes.sum())]), pa.array([file], pa.binary())],
                ["part", "shard", "n_docs", "n_tokens", "file"],
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            for block in _text.blocks(batch.column(1)):
                ids, size, doc, _, _ = enc.encode(block)
                count = np.bincount(doc, size, block.n).astype(np.int64)
                whole = np.full(len(ids) + block.n, end_id, np.uint32)
                inside = np.ones(len(whole), bool)
                inside[np.cumsum(count + 1) - 1] = False
                whole[inside] = ids
                ids_held.append(whole)
                sizes_held.append(count + 1)
                docs_held += names[block.first : block.first + block.n]
                n += len(whole)
                if n >= SHARD:
                    yield flush()
                    shard += 1
                    ids_held, sizes_held, docs_held, n = [], [], [], 0
        if n:
            yield flush()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartitionByRange("doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text").mapInArrow(run, TABLE)


def write(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Write the shard files of docs to a folder."""
    encode_shards(docs, vocabulary).write.parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shard files.

    ``start`` needs the tokens of all shards before: sums over parts, then over a part's shards; only
    these numbers, not the files, are shuffled.
    """
    table = spark.read.schema(TABLE).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    shards = table.select("part", "shard", "n_tokens").withColumn("inner", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens"))
    starts = shards.join(before, "part").select("part", "shard", (F.col("part_start") + F.col("inner")).alias("shard_start"))

    def run(batches):
        for batch in batches:
            for part, shard, file in zip(*(batch.column(k) for k in range(3)), strict=True):
                held = Wavelet(file.as_py())
                data = held.decode().astype("<u4").tobytes()
                ends = np.cumsum(held.sizes)
                crc = [zlib.crc32(data[4 * (e - s) : 4 * e]) for e, s in zip(ends.tolist(), held.sizes.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int32()), held.docs, pa.array(ends - held.sizes), pa.array(held.sizes), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = table.select("part", "shard", "file").mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
