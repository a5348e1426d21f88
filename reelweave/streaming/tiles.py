"""Tiles of frame sequences worked through in time, each with a memory of its own that is carried on.

A model that looks back in time takes a tile of each frame in order and hands a memory to the next.  State is
kept for each (sequence, tile): sequences and tiles run side by side, and a sequence of any length holds one memory for
each of its tiles.  ``carried`` does this for tables, ``carried_stream`` for streams with transformWithState, where frames may
come in any order and in any number of batches; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelweave.operators import geometry as G

#: fn(tile's values, memory or None) gives the tile's new values and the memory for the next frame.
Step = Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]
TILE = "seq_id long, tile int, frame_idx long, data array<double>"


def places(h: int, w: int, tile: int, stride: int) -> list[tuple[int, int, int, int]]:
    """(y0, y1, x0, x1) of the tiles of a picture: those that reach beyond what one before has covered."""
    starts = lambda n: [s for s in range(0, n, stride) if not (s >= stride and s - stride + tile >= n)]
    return [(y, min(y + tile, h), x, min(x + tile, w)) for y in starts(h) for x in starts(w)]


def cut(frames: DataFrame, h: int, w: int, tile: int, stride: int) -> DataFrame:
    """TILE rows of frames of one channel; works on streams."""

    def part(y0, y1, x0, x1):
        return F.flatten(F.transform(F.sequence(F.lit(y0), F.lit(y1 - 1)), lambda y: F.slice("data", y * w + x0 + 1, x1 - x0)))

    parts = [part(*p) for p in places(h, w, tile, stride)]
    rows = frames.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("frame_idx").cast("long").alias("frame_idx"), F.posexplode(F.array(*parts)).alias("tile", "data"))
    return rows.select("seq_id", "tile", "frame_idx", "data")


def carried(tiles: DataFrame, fn: Step) -> DataFrame:
    """fn over the frames of each tile in order; Spark sorts, and a task holds one memory and a batch of rows."""

    def run(batches):
        key, memory = None, None
        for batch in batches:
            out = []
            for k, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if at != key:
                    key, memory = at, None
                y, memory = fn(np.asarray(batch.column(3)[k].as_py(), np.float64), memory)
                out.append(np.asarray(y, np.float64).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64()))], ["seq_id", "tile", "frame_idx", "data"])

    return tiles.repartition("seq_id", "tile").sortWithinPartitions("seq_id", "tile", "frame_idx").mapInArrow(run, TILE)


class _Carry(StatefulProcessor):
    """Frames wait in a list until all before them have come; the memory and the next number are a value."""

    def __init__(self, fn: Step):
        self.fn = fn

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "frame_idx long, data array<double>")
        self.place = handle.getValueState("place", "next long, memory array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = {int(i): x for pdf in rows for i, x in zip(pdf["frame_idx"], pdf["data"], strict=True)}
        come |= {int(r[0]): r[1] for r in self.waiting.get()}
        at, memory = 0, None
        if self.place.exists():
            at, memory = self.place.get()
            memory = np.asarray(memory, np.float64)
        out = []
        while at in come:
            y, memory = self.fn(np.asarray(come.pop(at), np.float64), memory)
            out.append((int(key[0]), int(key[1]), at, np.asarray(y, np.float64).tolist()))
            at += 1
        if memory is not None:
            self.place.update((at, np.asarray(memory, np.float64).tolist()))
        # a frame that comes again after its turn is none
        left = [(i, [float(v) for v in x]) for i, x in sorted(come.items()) if i >= at]
        self.waiting.put(left) if left else self.waiting.clear()
        yield pd.DataFrame(out, columns=["seq_id", "tile", "frame_idx", "data"])

    def close(self) -> None:
        pass


def carried_stream(tiles: DataFrame, fn: Step) -> DataFrame:
    """The same over a stream: rows come out once all frames before them have come (needs the RocksDB state store)."""
    return tiles.groupBy("seq_id", "tile").transformWithStateInPandas(_Carry(fn), TILE, "Append", "None")


def merge(tiles: DataFrame, h: int, w: int, tile: int, stride: int, mode: str = "linear", exponent: float = 1.0) -> DataFrame:
    """(seq_id, frame_idx, y, x, v): tiles laid over each other with weights that fade over their overlap."""
    spots = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("y0", "y1", "x0", "x1"), p, strict=True)]) for p in places(h, w, tile, stride)])
    px = tiles.select("seq_id", "frame_idx", F.element_at(spots, F.col("tile") + 1).alias("p"), F.posexplode("data").alias("i", "v")).select("seq_id", "frame_idx", "p.*", "i", "v")
    wide = F.col("x1") - F.col("x0")
    px = px.withColumns({"ly": F.floor(F.col("i") / wide).cast("int"), "lx": F.col("i") % wide})
    side = lambda at, a, b, n: G.feather(F.col(at), F.col(b) - F.col(a), F.col(a) == 0, F.col(b) >= n, tile - stride, mode, exponent)
    px = px.select("seq_id", "frame_idx", (F.col("y0") + F.col("ly")).alias("y"), (F.col("x0") + F.col("lx")).alias("x"), "v", (side("ly", "y0", "y1", h) * side("lx", "x0", "x1", w)).alias("weight"))
    return G.merge_tiles(px, ["seq_id", "frame_idx"])
