"""Frames as numbered image files, as a data source: ``spark.read.format("frames")`` and ``df.write.format("frames")``.

Files are named ``{prefix}_{sequence:06d}.{format}``.  ``register(spark)`` makes the source known to a session.

Reading (options ``path``, ``prefix`` or ``pattern``, ``format`` png or jpg, ``start``, ``count``, ``batch``, ``decode``, ``missing``)
lists names once and cuts the numbers into ranges of ``batch`` frames, one partition each, in order of prefix and
number.  ``start`` and ``count`` choose names before any file is opened, so a file outside them is never read; with the
option ``pushdown`` true, filters on ``prefix`` and ``sequence`` do so too (the session must have
spark.sql.python.filterPushdown.enabled).  ``missing`` says what becomes of numbers
that no file has, between a prefix's first and last number or within ``start`` and ``count``: ``skip``, ``report`` (a row whose
``error`` is "absent") or ``fail``.  A file that can't be decoded is a row with an ``error`` where absent ones are
reported, and fails the task otherwise.  With ``decode`` false, rows carry the files' bytes as they are.

Writing takes rows with ``sequence`` and either ``h``, ``w``, ``c``, ``data`` (encoded) or ``content`` and ``format`` (bytes of the format to
be written go to their place as they are, so ranges are copied without loss or decoding; other bytes
are decoded and encoded).  Each task attempt writes into a folder of its own below ``_temporary``; the driver moves the files
of the attempts that Spark has accepted to their names and deletes the rest, so a task that is killed or
repeated leaves nothing behind, and a failed job leaves the target as it was.

Files are reached through Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from struct import error as struct_error
from zlib import error as zlib_error

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from reelweave.sources import images, jpeg

SCHEMA = "prefix string, sequence long, format string, h int, w int, c int, data array<double>, content binary, error string"
BATCH = 80
_NAME = re.compile(r"^(.*)_(\d{6,})\.(png|jpe?g)$")


def _format(name: str) -> str:
    name = {"jpeg": "jpg"}.get(name.lower(), name.lower())
    if name not in ("png", "jpg"):
        raise ValueError(f"frames are png or jpg files, not {name}")
    return name


def encode(pixels: np.ndarray, kind: str, level: int = 6, quality: int = 95) -> bytes:
    """File of an (h, w, c) array in [0, 1]."""
    if kind == "png":
        return images.encode_png(pixels, level)
    return jpeg.encode((np.clip(pixels, 0, 1) * 255).astype(np.uint8), quality)


def decode(content: bytes, kind: str) -> np.ndarray:
    """(h, w, c) array in [0, 1], c 3 or 4."""
    return images.decode_png(content) if kind == "png" else jpeg.decode(content) / 255.0


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(f"file://{path}")


def _listed(path: str) -> Iterator[tuple[str, str, int, str]]:
    """(file name, prefix, sequence, format) of the folder's files with a frame's name."""
    from pyarrow import fs

    store, base = _open(path)
    for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        m = _NAME.match(info.base_name)
        if m and info.type == fs.FileType.File:
            yield info.base_name, m[1], int(m[2]), _format(m[3])


@dataclass
class Range(InputPartition):
    """Some numbers of one prefix, with their file names; a number without a file has none."""

    prefix: str
    files: list[tuple[int, str | None]]


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.kind = _format(options.get("format", "png"))
        prefix = options.get("prefix")
        self.pattern = options.get("pattern") or f"{prefix or '*'}_*.{self.kind}"
        self.exact = prefix if prefix and not options.get("pattern") and not re.search(r"[*?\[]", prefix) else None
        self.first = int(options.get("start", 0))
        self.count = int(options["count"]) if "count" in options else None
        self.batch = int(options.get("batch", BATCH))
        self.decoded = options.get("decode", "true").lower() != "false"
        self.missing = options.get("missing", "skip")
        if self.missing not in ("skip", "report", "fail"):
            raise ValueError("missing is skip, report or fail")
        self.tests: list[tuple[str, type, object]] = []

    def _wanted(self, prefix: str, sequence: int) -> bool:
        if sequence < self.first or self.count is not None and sequence >= self.first + self.count:
            return False
        return all(_TESTS[kind](prefix if name == "prefix" else sequence, value) for name, kind, value in self.tests)

    def partitions(self) -> list[Range]:
        found: dict[str, dict[int, str]] = {}
        for name, prefix, sequence, kind in _listed(self.path):
            if kind == self.kind and fnmatch.fnmatchcase(name, self.pattern):
                found.setdefault(prefix, {})[sequence] = name
        if self.exact is not None and self.count is not None:
            found.setdefault(self.exact, {})
        out = []
        for prefix, files in sorted(found.items()):
            if self.missing == "skip":
                numbers = sorted(files)
            elif self.count is not None:
                numbers = range(self.first, self.first + self.count)
            else:
                numbers = range(min(files), max(files) + 1)
            held = [(k, files.get(k)) for k in numbers if self._wanted(prefix, k)]
            out += [Range(prefix, held[k : k + self.batch]) for k in range(0, len(held), self.batch)]
        return out or [Range("", [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, base = _open(self.path)
        for sequence, name in partition.files:
            row = {"prefix": partition.prefix, "sequence": sequence, "format": self.kind}
            if name is None:
                if self.missing == "fail":
                    raise FileNotFoundError(f"{partition.prefix}_{sequence:06d}.{self.kind}")
                row["error"] = "absent"
            else:
                with store.open_input_stream(f"{base}/{name}") as f:
                    content = f.read()
                try:
                    if self.decoded:
                        pixels = decode(content, self.kind)
                        row |= dict(zip("hwc", pixels.shape, strict=True)) | {"data": pa.array(pixels.ravel())}
                    else:
                        row["content"] = content
                except (ValueError, KeyError, IndexError, struct_error, zlib_error) as e:
                    if self.missing != "report":
                        raise
                    row["error"] = f"{type(e).__name__}: {e}"
            yield _one(row)


class PushedReader(FrameReader):
    """Takes over filters on prefix and sequence, so that other files are not opened."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("prefix",), ("sequence",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f


def _one(row: dict) -> pa.RecordBatch:
    """A frame as a batch of one row: frames are large, and no more than one is held."""
    kinds = {"prefix": pa.string(), "sequence": pa.int64(), "format": pa.string(), "h": pa.int32(), "w": pa.int32(), "c": pa.int32(), "data": pa.list_(pa.float64()), "content": pa.binary(), "error": pa.string()}
    columns = []
    for name, kind in kinds.items():
        v = row.get(name)
        if name == "data" and v is not None:
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
        else:
            columns.append(pa.array([v], kind))
    return pa.RecordBatch.from_arrays(columns, list(kinds))


@dataclass
class Attempt(WriterCommitMessage):
    """Folder of an attempt's files and their number; names stay in the store."""

    folder: str
    files: int


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.kind = _format(options.get("format", "png"))
        self.prefix = options.get("prefix", "image")
        self.shift = int(options.get("start", 0))
        self.level, self.quality = min(max(int(options.get("level", 6)), 0), 9), int(options.get("quality", 95))
        if not 1 <= self.quality <= 100:
            self.quality = 95
        self.overwrite, self.job = overwrite, uuid.uuid4().hex
        self.names = set(schema.names)
        if "sequence" not in self.names or not ({"h", "w", "c", "data"} <= self.names or {"content", "format"} <= self.names):
            raise ValueError("frames need sequence and either h, w, c, data or content, format")

    def _file(self, row: dict) -> bytes:
        content = row.get("content")
        if content is not None:
            kind = _format(row["format"])
            return content if kind == self.kind else encode(decode(content, kind), self.kind, self.level, self.quality)
        if row.get("data") is None:
            raise ValueError(f"frame {row['sequence']} has neither data nor content")
        return encode(np.asarray(row["data"], np.float64).reshape(row["h"], row["w"], row["c"]), self.kind, self.level, self.quality)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, base = _open(self.path)
        folder = f"{base}/_temporary/{self.job}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        n = 0
        for batch in iterator:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() if c != "data" else batch.column(c)[k].values for c in self.names & {"prefix", "sequence", "format", "h", "w", "c", "data", "content"}}
                prefix = row.get("prefix") or self.prefix
                if "/" in prefix:
                    raise ValueError(f"a prefix is part of a file's name: {prefix}")
                with store.open_output_stream(f"{folder}/{prefix}_{row['sequence'] + self.shift:06d}.{self.kind}") as out:
                    out.write(self._file(row))
                n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        store, base = _open(self.path)
        if self.overwrite:
            for name, prefix, _, kind in _listed(self.path):
                if kind == self.kind and ("prefix" in self.names or prefix == self.prefix):
                    store.delete_file(f"{base}/{name}")
        for m in messages:
            for info in store.get_file_info(fs.FileSelector(m.folder)) if m else ():
                store.move(info.path, f"{base}/{info.base_name}")
        self._clean()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Deletes what this job's attempts have left, killed ones included."""
        from pyarrow import fs

        store, base = _open(self.path)
        for folder in (f"{base}/_temporary/{self.job}", f"{base}/_temporary"):
            info = store.get_file_info(folder)
            if info.type == fs.FileType.Directory and (folder.endswith(self.job) or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return (PushedReader if self.options.get("pushdown", "false").lower() == "true" else FrameReader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameFiles)
