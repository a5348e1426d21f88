"""Frames as image files: ``{prefix}_{sequence:06d}.png`` in a folder that Spark reads.

``scan`` goes through Spark's ``binaryFile`` source, so any file system that Spark reaches will do; slices of
a sequence are predicates on the sequence number in the file name.  ``frame_files`` is the source that
opens chosen files only, and writes them in two phases.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAGIC = b"\x89PNG\r\n\x1a\n"
_COLOUR = {1: 0, 2: 4, 3: 2, 4: 6}


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """PNG of an (h, w, c) array in [0, 1]: clipped, scaled to 255, cut to whole numbers."""
    data = (np.clip(pixels, 0, 1) * 255).astype(np.uint8)
    h, w, c = data.shape
    raw = b"".join(b"\0" + row.tobytes() for row in data)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, _COLOUR[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, max(0, min(9, level)))) + chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the rows (filter first) as they were before filtering; ``step`` bytes make a pixel."""
    h, n = rows.shape[0], rows.shape[1] - 1
    out, up = np.zeros((h, n), np.uint8), np.zeros(n, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:  # a running sum of each byte of a pixel
            out[y] = np.cumsum(np.pad(line, (0, -n % step)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:n]
        elif kind == 2:
            out[y] = line + up
        elif kind in (3, 4):
            left, corner, b, got = [0] * step, [0] * step, up.tolist(), []
            for x, v in enumerate(line.tolist()):
                p, q, r = left[x % step], b[x], corner[x % step]
                if kind == 3:
                    guess = p + q >> 1
                else:
                    dp, dq, dr = abs(q - r), abs(p - r), abs(p + q - 2 * r)
                    guess = p if dp <= dq and dp <= dr else q if dq <= dr else r
                left[x % step], corner[x % step] = v + guess & 255, q
                got.append(left[x % step])
            out[y] = got
        else:
            raise ValueError("unknown PNG filter")
        up = out[y]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, c) array of a PNG without interlacing, of any depth and with palettes; grey becomes three channels, alpha stays."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG file")
    at, body, palette, clear, colour = 8, b"", None, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", part)
            if interlace:
                raise ValueError("only PNG files without interlacing")
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body += part
        at += size + 12
    if colour is None:
        raise ValueError("no PNG header")
    c = 1 if colour == 3 else {v: k for k, v in _COLOUR.items()}[colour]
    wide = (w * c * depth + 7) // 8
    flat = _unfilter(np.frombuffer(zlib.decompress(body), np.uint8)[: h * (wide + 1)].reshape(h, wide + 1), max(1, c * depth // 8))
    if depth == 16:
        flat = flat[:, ::2]  # the higher byte, as 8-bit pictures have it
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(h, -1, depth)[:, : w * c]
        flat = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
        if colour != 3:
            flat = flat * (255 // ((1 << depth) - 1))
    if colour == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        table = np.concatenate([palette, alpha[:, None]], 1) if clear else palette
        return table[flat] / 255.0
    out = flat.reshape(h, w, c) / 255.0
    return np.concatenate([out[..., :1]] * 3 + [out[..., 1:]], axis=-1) if c < 3 else out


def encode_frames(frames: DataFrame, prefix: str, h: int, w: int, c: int, start: int = 0, level: int = 6) -> DataFrame:
    """(name, content): the file of each frame."""

    def run(batches):
        for pdf in batches:
            names = [f"{prefix}_{start + int(i):06d}.png" for i in pdf["frame_idx"]]
            yield type(pdf)({"name": names, "content": [encode_png(np.asarray(x, np.float64).reshape(h, w, c), level) for x in pdf["data"]]})

    return frames.select("frame_idx", "data").mapInPandas(run, "name string, content binary")


def save_frames(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files of a folder; returns the folder's (name, size) once all are in place.

    The rows go through the ``frames`` data source as they are: see ``frame_files`` for what a failed task leaves (nothing).
    """
    from reelweave.sources import frame_files

    spark = files.sparkSession
    frame_files.register(spark)
    part = lambda k: F.regexp_extract("name", r"^(.*)_(\d{6,})\.(\w+)$", k)
    rows = files.select(part(1).alias("prefix"), part(2).cast("long").alias("sequence"), part(3).alias("format"), "content")
    for kind in ("png", "jpg"):
        some = rows.where(F.col("format") == kind)
        if not some.isEmpty():
            some.write.format("frames").mode("append").option("path", folder).option("format", kind).save()
    written = spark.read.format("binaryFile").option("pathGlobFilter", "*_*.*").load(folder)
    return written.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size")).join(files.select("name"), "name", "left_semi")


def scan(spark: SparkSession, folder: str, prefix: str = "*", suffix: str = "png", start: int | None = None, count: int | None = None) -> DataFrame:
    """(path, sequence, content) of a folder's files; with ``count`` only that range of sequence numbers, absent ones skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}_*.{suffix}" if prefix != "*" else f"*.{suffix}").load(folder)
    rows = files.select("path", F.regexp_extract("path", r"_(\d{6})\.\w+$", 1).cast("long").alias("sequence"), "content")
    if count is not None:
        first = start or 0
        rows = rows.where((F.col("sequence") >= first) & (F.col("sequence") < first + count))
    return rows


def load_frames(files: DataFrame) -> DataFrame:
    """(frame_idx, h, w, c, data) of scanned files, numbered in the order of their sequence numbers."""

    def run(batches):
        for pdf in batches:
            pictures = [decode_png(x) for x in pdf["content"]]
            yield type(pdf)({"frame_idx": pdf["sequence"], "h": [p.shape[0] for p in pictures], "w": [p.shape[1] for p in pictures], "c": [p.shape[2] for p in pictures], "data": [p.ravel().tolist() for p in pictures]})

    return files.select("sequence", "content").mapInPandas(run, "frame_idx long, h int, w int, c int, data array<double>")


class Saved:
    """Patterns of the files saved so far, and their deletion."""

    def __init__(self):
        self.patterns: list[tuple[str, str]] = []

    def add(self, folder: str, prefix: str, suffix: str = "png") -> None:
        suffix = {"jpeg": "jpg"}.get(suffix, suffix)
        self.patterns.append((folder, rf"^{re.escape(prefix)}_\d{{6}}\.{suffix}$"))

    def delete(self, dry_run: bool = False) -> dict:
        """Delete all files of the patterns; a dry run counts them. The patterns are forgotten after a real run."""
        from pyarrow import fs

        out = {"patterns_processed": 0, "files_found": 0, "files_deleted": 0, "files_failed": 0, "errors": []}
        for folder, pattern in self.patterns:
            out["patterns_processed"] += 1
            store, base = fs.FileSystem.from_uri(folder)
            for info in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if re.match(pattern, info.base_name):
                    out["files_found"] += 1
                    try:
                        if not dry_run:
                            store.delete_file(info.path)
                        out["files_deleted"] += 1
                    except OSError as e:
                        out["files_failed"] += 1
                        out["errors"].append(str(e))
        if not dry_run:
            self.patterns.clear()
        return out
