"""Frame sequences as rows (seq_id, frame_idx, data), data a row-major array of h x w x c numbers in [0, 1].

Sequences are sliced and sampled by predicates on ``frame_idx``; joins and windows are keyed by
``seq_id``, so sequences are independent and frames of one are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.functions.text import bound


def with_count(frames: DataFrame) -> DataFrame:
    """Adds n, the number of frames of the sequence, from a small aggregate."""
    return frames.join(frames.groupBy("seq_id").agg(F.count("*").alias("n")), "seq_id")


def take(frames: DataFrame, start: int, length: int = -1) -> DataFrame:
    """A slice, re-numbered from 0: negative start counts from the end, both ends are clamped, length < 0 takes all."""
    f = with_count(frames)
    n = F.col("n")
    first = F.least(F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0)), n - 1)
    size = n - first if length < 0 else F.least(n - first, F.lit(length))
    return f.where((F.col("frame_idx") >= first) & (F.col("frame_idx") < first + size)).withColumn("frame_idx", (F.col("frame_idx") - first).cast("long")).drop("n")


def kept_frames(length: DataFrame, skip: float, part: int = 1 << 16) -> DataFrame:
    """(source_idx, kept, rank) for each index below ``length`` (one row, one column): whether it survives, and how many before it do.

    An index survives if it is the first to reach a running sum of ``skip`` in doubles; that is the same for all
    sequences, so it is computed once, ``part`` indices at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                total, before = 0.0, 0
                for a in range(0, n or 0, part):
                    i = np.arange(a, min(a + part, n))
                    if skip <= 1:
                        kept, rank = np.ones(len(i), bool), i
                    else:
                        # sums one by one, as a running sum has them; ceil(sum) is the index that reaches it
                        sums = np.cumsum(np.concatenate([[total], np.full(int(part / skip) + 2, skip)]))
                        at = np.ceil(sums)
                        inside = int(np.searchsorted(at, i[-1], "right"))
                        rank = before + np.searchsorted(at[:inside], i)
                        kept = np.isin(i, at[:inside])
                        total, before = float(sums[inside]), before + inside
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(kept), pa.array(rank.astype(np.int64))], ["source_idx", "kept", "rank"])

    return length.mapInArrow(run, "source_idx long, kept boolean, rank long")


def reduce_fps(frames: DataFrame, origin_fps: float, result_fps: float, keep_last: bool = False) -> DataFrame:
    """Frames that survive a drop of the frame rate, re-numbered; ``source_idx`` is where they were.

    A sequence shorter than the step between kept frames stays whole.
    """
    skip = origin_fps / result_fps
    f = with_count(frames).withColumn("source_idx", F.col("frame_idx").cast("long"))
    table = kept_frames(frames.agg((F.max("frame_idx") + 1).cast("long").alias("length")), skip)
    whole, last = F.lit(skip) > F.col("n"), F.col("source_idx") == F.col("n") - 1
    f = f.join(table, "source_idx").where(whole | F.col("kept") | (last if keep_last else F.lit(False)))
    return f.withColumn("frame_idx", F.when(whole, F.col("source_idx")).otherwise(F.col("rank"))).drop("n", "kept", "rank")


def bytes_estimate(shape: list[Column], element: int = 4) -> Column:
    """Bytes of frames of a shape before they are read; null where a side is unknown."""
    size = F.lit(element).cast("long")
    for side in shape:
        size = size * side
    return size


def preview(frames: DataFrame, most: int, stride: bool = True) -> DataFrame:
    """At most ``most`` frames: the first ones, or every ceil(n / most)-th; a negative number takes all."""
    if most < 0:
        return frames
    if not stride:
        return frames.where(F.col("frame_idx") < most)
    f = with_count(frames)
    step = F.ceil(F.col("n") / most)
    return f.where((F.col("frame_idx") % step == 0) & (F.col("frame_idx") / step < most)).drop("n")


def contact_sheet(frames: DataFrame, h: int, w: int, max_cols: int) -> DataFrame:
    """Grid place (row, col) of each frame of a contact sheet."""
    n = F.col("n")
    cols = F.greatest(F.lit(1), F.least(F.bround(F.sqrt(n * F.lit(h / w))).cast("long"), F.lit(max_cols), n))
    f = with_count(frames).withColumn("cols", cols)
    return f.select("seq_id", "frame_idx", F.floor(F.col("frame_idx") / F.col("cols")).alias("row"), (F.col("frame_idx") % F.col("cols")).alias("col"), F.ceil(n / F.col("cols")).alias("rows"))


#: sRGB to XYZ (D65) and its inverse, the white point, the cube-root limits of CIE Lab.
_TO_XYZ = [(0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227)]
_FROM_XYZ = [(3.2404813432005266, -1.5371515162713185, -0.4985363261688878), (-0.9692549499965682, 1.8759900014898907, 0.0415559265582928), (0.0556466391351772, -0.2040413383665112, 1.0573110696453443)]
_WHITE = (0.95047, 1.0, 1.08883)
_DELTA, _SLOPE, _SHIFT = 0.008856, 7.787, 4 / 29


def _weighted(row, v: Column) -> Column:
    return sum(k * v[i] for i, k in enumerate(row))


def rgb_to_lab(rgb: Column) -> Column:
    """Array (L, a, b) of an array (r, g, b); each step is bound, so its terms are computed once."""
    linear = F.transform(rgb, lambda c: F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92))
    xyz = bound(linear, lambda v: F.array(*[_weighted(row, v) / white for row, white in zip(_TO_XYZ, _WHITE, strict=True)]))
    root = F.transform(xyz, lambda v: F.when(v > _DELTA, F.pow(v, F.lit(1 / 3))).otherwise(v * _SLOPE + _SHIFT))
    return bound(root, lambda f: F.array(116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])))


def lab_to_rgb(lab: Column) -> Column:
    """Array (r, g, b) of an array (L, a, b), clipped to [0, 1]."""
    root = bound(lab, lambda v: F.array(v[1] / 500 + (v[0] + 16) / 116, (v[0] + 16) / 116, F.greatest((v[0] + 16) / 116 - v[2] / 200, F.lit(0.0))))
    xyz = F.transform(root, lambda v: F.when(v > 0.2068966, F.pow(v, F.lit(3.0))).otherwise((v - _SHIFT) / _SLOPE))
    linear = bound(xyz, lambda v: F.array(*[F.greatest(_weighted([k * white for k, white in zip(row, _WHITE, strict=True)], v), F.lit(0.0)) for row in _FROM_XYZ]))
    curve = lambda c: F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0031308)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c)
    return F.transform(linear, lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), curve(c))))


def blend(x: Column, y: Column, alpha: Column, mode: str) -> Column:
    """Cross-fade of two pixel arrays, alpha from 0 (x) to 1 (y)."""
    if mode == "ease_in_out":
        alpha = 3 * alpha * alpha - 2 * alpha * alpha * alpha
    if mode in ("linear_blend", "ease_in_out"):
        return F.zip_with(x, y, lambda p, q: (1 - alpha) * p + alpha * q)
    if mode == "filmic_crossfade":
        gamma = F.lit(2.2)
        return F.zip_with(x, y, lambda p, q: F.pow((1 - alpha) * F.pow(p, gamma) + alpha * F.pow(q, gamma), F.lit(1 / 2.2)))
    if mode == "perceptual_crossfade":  # pixels of three channels
        n = (F.size(x) / 3).cast("int")

        def pixel(i):
            one, two = (rgb_to_lab(F.slice(v, i * 3 + 1, 3)) for v in (x, y))
            return lab_to_rgb(F.zip_with(one, two, lambda p, q: (1 - alpha) * p + alpha * q))

        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), pixel))
    raise ValueError(mode)


def extend_with_overlap(a: DataFrame, b: DataFrame, overlap: int, mode: str = "linear_blend", side: str = "source") -> DataFrame:
    """Sequence a continued by b, ``overlap`` frames cut from one side or cross-faded.

    a and b share ``seq_id``.  With side 'new_images' a cut drops the head of b, and a fade runs the
    other way round.  Too short a side is an error when the rows are computed.
    """
    na = a.groupBy("seq_id").agg(F.count("*").alias("na"))
    nb = b.groupBy("seq_id").agg(F.count("*").alias("nb"))
    size = na.join(nb, "seq_id")
    fits = (F.col("na") >= overlap) & (F.col("nb") >= overlap)
    size = size.withColumn("na", F.when(fits, F.col("na")).otherwise(F.raise_error(F.lit("overlap longer than a sequence")).cast("bigint")))
    x, y = a.join(size, "seq_id"), b.join(size, "seq_id")
    seam = F.col("na") - overlap
    if mode == "cut":
        cut_a = x.where(F.col("frame_idx") < (seam if side == "source" else F.col("na")))
        cut_b = y if side == "source" else y.where(F.col("frame_idx") >= overlap)
        return cut_a.select("seq_id", "frame_idx", "data").unionByName(cut_b.select("seq_id", (F.col("frame_idx") + seam).alias("frame_idx"), "data"))
    head = x.where(F.col("frame_idx") < seam).select("seq_id", "frame_idx", "data")
    tail = y.where(F.col("frame_idx") >= overlap).select("seq_id", (F.col("frame_idx") + seam).alias("frame_idx"), "data")
    left = x.where(F.col("frame_idx") >= seam).select("seq_id", "frame_idx", (F.col("frame_idx") - seam).alias("k"), F.col("data").alias("x"))
    right = y.where(F.col("frame_idx") < overlap).select("seq_id", F.col("frame_idx").alias("k"), F.col("data").alias("y"))
    alpha = (F.col("k") + 1) / F.lit(float(overlap + 1))
    first, second = ("x", "y") if side == "source" else ("y", "x")
    mixed = left.join(right, ["seq_id", "k"]).select("seq_id", "frame_idx", blend(F.col(first), F.col(second), alpha, mode).alias("data"))
    return head.unionByName(mixed).unionByName(tail)


def interpolate(frames: DataFrame, multiplier: int, middle=None) -> DataFrame:
    """(n - 1) * multiplier + 1 frames: each original, then the ones between it and the next.

    ``middle(x, y, t)`` makes a frame between two; the default is a linear mix, standing in for a model.
    """
    middle = middle or (lambda x, y, t: F.zip_with(x, y, lambda p, q: (1 - t) * p + t * q))
    w = Window.partitionBy("seq_id").orderBy("frame_idx")
    pairs = frames.withColumn("next", F.lead("data").over(w))
    last = F.when(F.col("next").isNull(), 0).otherwise(multiplier - 1)
    steps = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    t = F.col("k") / F.lit(float(multiplier))
    data = F.when(F.col("k") == 0, F.col("data")).otherwise(middle(F.col("data"), F.col("next"), t))
    return steps.select("seq_id", (F.col("frame_idx") * multiplier + F.col("k")).alias("frame_idx"), data.alias("data"))


def loop_windows(counts: DataFrame, window: int, motion: int) -> DataFrame:
    """(seq_id, loop, start, end): overlapping windows of latent frames over n pixel frames' latents.

    Window and motion are in pixel frames, four to a latent frame; each window after the first starts
    with the last ``motion`` latents of the one before.
    """
    size, keep = (window + 3) // 4, (motion + 3) // 4
    if keep < 1 or size <= keep:
        raise ValueError("a window must be longer than its motion frames, and those at least one")
    step = size - keep
    loops = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    grid = counts.select("seq_id", "n", F.explode(F.sequence(F.lit(0), loops)).alias("loop"))
    start = F.when(F.col("loop") == 0, F.lit(0)).otherwise(size + (F.col("loop") - 1) * step - keep)
    end = F.least(F.col("n"), F.lit(size) + F.col("loop") * step)
    return grid.select("seq_id", "loop", start.cast("long").alias("start"), end.cast("long").alias("end"))
