"""Functions over batches of frames whose number may change, and over tiles that may prove too large.

Both take a caller's function on numpy arrays (a model, a filter) and give Spark the rest: batches and tiles are rows that
are dealt to tasks, results are numbered and merged by aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelweave.sources.shared import written

BATCH = 80


def transform(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], batch: int = BATCH) -> DataFrame:
    """(seq_id, frame_idx, data) of what fn makes of each ``batch`` consecutive frames (n, k), as many as it likes, numbered without gaps.

    Batches, not sequences, are dealt to tasks, and a task holds one batch.  A frame's new number is its place in its
    batch's result plus the sizes of the results before: a sum over batches, so no frame is sorted or moved for it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        out = np.asarray(fn(np.stack(pdf["data"].to_numpy())), np.float64)
        n = len(out)
        return pd.DataFrame({"seq_id": [pdf["seq_id"].iloc[0]] * n, "chunk": [pdf["chunk"].iloc[0]] * n, "k": range(n), "data": pd.Series(out.reshape(n, -1).tolist() if n else [], dtype=object)})

    rows = frames.select(F.col("seq_id").cast("long").alias("seq_id"), "frame_idx", F.floor(F.col("frame_idx") / batch).cast("long").alias("chunk"), "data")
    made = written(rows.groupBy("seq_id", "chunk").applyInPandas(run, "seq_id long, chunk long, k long, data array<double>"), "transformed")
    sizes = made.groupBy("seq_id", "chunk").agg(F.count("*").alias("n"))
    starts = sizes.select("seq_id", "chunk", (F.sum("n").over(Window.partitionBy("seq_id").orderBy("chunk")) - F.col("n")).alias("start"))
    return made.join(starts, ["seq_id", "chunk"]).select("seq_id", (F.col("start") + F.col("k")).alias("frame_idx"), "data")


def _starts(n: int, tile: int, overlap: int) -> list[int]:
    return list(range(0, n - overlap, tile - overlap)) if n > tile else [0]


def plan(h: int, w: int, tile: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(y0, y1, x0, x1) of overlapping tiles that cover a picture."""
    return [(y, min(y + tile, h), x, min(x + tile, w)) for y in _starts(h, tile, overlap) for x in _starts(w, tile, overlap)]


def upscale_tiled(pictures: DataFrame, keys: list[str], fn: Callable[[np.ndarray], np.ndarray], h: int, w: int, c: int = 1, scale: int = 2, tile: int = 512, overlap: int = 32, least: int = 128) -> tuple[DataFrame, DataFrame]:
    """((keys, y, x, ch, v) of the upscaled pictures, (keys, y0, y1, x0, x1, tile) of the tiles they were made from).

    fn maps a tile (h, w, c) to (h scale, w scale, c) and raises MemoryError where one is too large.  A tile that fails
    comes back as a row that says so; its picture is cut again at half the size, the others are done.  Below ``least``
    the error is raised.  Each size is one job over the pictures still open, so there are at most log2(tile / least) + 1.
    """
    shape = ", ".join(f"{k} {dict(pictures.dtypes)[k]}" for k in keys)

    def run(batches):
        for pdf in batches:
            out = []
            for y0, y1, x0, x1, data in zip(*(pdf[n] for n in ("y0", "y1", "x0", "x1", "part")), strict=True):
                try:
                    out.append(np.asarray(fn(np.asarray(data, np.float64).reshape(y1 - y0, x1 - x0, c)), np.float64).ravel().tolist())
                except MemoryError:
                    out.append(None)
            yield pdf[[*keys, "y0", "y1", "x0", "x1", "tile"]].assign(out=out)

    waiting, done, size = pictures.select(*keys, "data"), [], tile
    while True:
        parts = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("y0", "y1", "x0", "x1"), t, strict=True)]) for t in plan(h, w, size, min(overlap, size // 2))])
        cut = waiting.select(*keys, "data", F.explode(parts).alias("t")).select(*keys, "data", "t.*", F.lit(size).alias("tile"))
        row = lambda y: F.slice("data", (y * w + F.col("x0")) * c + 1, (F.col("x1") - F.col("x0")) * c)
        cut = cut.select(*keys, "y0", "y1", "x0", "x1", "tile", F.flatten(F.transform(F.sequence("y0", F.col("y1") - 1), row)).alias("part"))
        made = written(cut.repartition(*keys, "y0", "x0").mapInPandas(run, f"{shape}, y0 int, y1 int, x0 int, x1 int, tile int, out array<double>"), "tiles")
        failed = made.where("out IS NULL").select(*keys).distinct()
        if failed.isEmpty():
            done.append(made)
            break
        done.append(made.join(failed, keys, "left_anti"))
        waiting, size = waiting.join(failed, keys, "left_semi"), size // 2
        if size < least:
            raise MemoryError(f"tiles of {2 * size} are too large, and {least} is the least size")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    wide, tall = (F.col("x1") - F.col("x0")) * scale, (F.col("y1") - F.col("y0")) * scale
    px = whole.select(*keys, "y0", "x0", wide.alias("wide"), tall.alias("tall"), F.least(F.lit(overlap), F.floor(F.col("tile") / 2)).alias("overlap"), F.posexplode("out").alias("i", "v"))
    px = px.withColumns({"ly": F.floor(F.col("i") / (F.col("wide") * c)), "lx": F.floor(F.col("i") / c) % F.col("wide"), "ch": F.col("i") % c})
    border = F.col("overlap") * scale
    rise = lambda at, n: F.when((border > 0) & (n > border), F.least((at + 1) / border, F.lit(1.0)) * F.least((n - at) / border, F.lit(1.0))).otherwise(F.lit(1.0))
    px = px.withColumn("weight", rise(F.col("ly"), F.col("tall")) * rise(F.col("lx"), F.col("wide")))
    merged = px.groupBy(*keys, (F.col("y0") * scale + F.col("ly")).cast("int").alias("y"), (F.col("x0") * scale + F.col("lx")).cast("int").alias("x"), "ch").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))
    return merged, whole.select(*keys, "y0", "y1", "x0", "x1", "tile")
