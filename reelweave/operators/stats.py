"""Statistics of frames, matching by them, and recurrences over frame order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.functions.text import bound
from reelweave.sources.shared import written

LUMA = (0.299, 0.587, 0.114)
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def channel(data: Column, c: int, k: int) -> Column:
    """Values of channel k of c, by position."""
    return data if c == 1 else F.filter(data, lambda _, i: i % c == k)


def luminance(data: Column, c: int) -> Column:
    if c == 1:
        return F.transform(data, lambda v: LUMA[0] * v + LUMA[1] * v + LUMA[2] * v)
    n = (F.size(data) / c).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum(w * F.element_at(data, i * c + k + 1) for k, w in enumerate(LUMA)))


def pseudo_lab(data: Column, c: int) -> list[Column]:
    """Arrays of lightness and two colour differences, each shifted into [0, 1]."""
    n = (F.size(data) / c).cast("int")
    rgb = lambda i: [F.element_at(data, i * c + (k if c > 1 else 0) + 1) for k in range(3)]
    at = F.sequence(F.lit(0), n - 1)

    def a(i):
        r, g, _ = rgb(i)
        return (r - g) * 0.5 + 0.5

    def b(i):
        r, g, x = rgb(i)
        return (r + g - 2 * x) * 0.25 + 0.5

    return [luminance(data, c), F.transform(at, a), F.transform(at, b)]


def histogram(v: Column, bins: int) -> list[Column]:
    """One count for each bin of [0, 1]; 1 falls into the last bin, other values into none."""
    at = F.when(v.between(0, 1), F.least(F.floor(v * bins), F.lit(bins - 1)))
    return [F.count_if(at == k) for k in range(bins)]


def signature(frames: DataFrame, c: int = 1, bins: int = 16) -> DataFrame:
    """(seq_id, frame_idx, hist, mean, std, pct) of the frames' luminance.

    Pixels are exploded and aggregated on the map side, so the shuffle carries partial counts.
    """
    pixels = frames.select("seq_id", "frame_idx", F.explode(luminance(F.col("data"), c)).alias("v"))
    counted = pixels.groupBy("seq_id", "frame_idx").agg(
        F.array(*histogram(F.col("v"), bins)).alias("h"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.percentile("v", F.array(*[F.lit(q) for q in QUANTILES])).alias("pct"),
    )
    total = F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x) + F.lit(1e-8)
    return counted.select("seq_id", "frame_idx", F.transform("h", lambda x: x / total).alias("hist"), "mean", "std", "pct")


def _l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def signature_distance(a: str, b: str) -> Column:
    """Weighted distance of two signature structs."""
    pct = _l1(F.col(f"{a}.pct"), F.col(f"{b}.pct")) / len(QUANTILES)
    return 0.6 * _l1(F.col(f"{a}.hist"), F.col(f"{b}.hist")) + 0.2 * F.abs(F.col(f"{a}.mean") - F.col(f"{b}.mean")) + 0.1 * F.abs(F.col(f"{a}.std") - F.col(f"{b}.std")) + 0.1 * pct


def nearest_reference(signatures: DataFrame, first: int) -> DataFrame:
    """For frames behind the first ``first`` of their sequence the nearest of those; ties go to the earlier one.

    The reference side has ``first`` rows for each sequence, and the join is on the sequence.
    """
    s = signatures.select("seq_id", "frame_idx", F.struct("hist", "mean", "std", "pct").alias("sig"))
    ref = s.where(F.col("frame_idx") < first).select("seq_id", F.col("frame_idx").alias("ref_idx"), F.col("sig").alias("ref"))
    pairs = s.where(F.col("frame_idx") >= first).join(ref, "seq_id").withColumn("distance", signature_distance("sig", "ref"))
    best = F.min(F.struct("distance", "ref_idx")).alias("b")
    return pairs.groupBy("seq_id", "frame_idx").agg(best).select("seq_id", "frame_idx", "b.ref_idx", "b.distance")


def scene_change(frames: DataFrame, h: int, w: int, c: int = 1) -> DataFrame:
    """(seq_id, frame_idx, score) against the frame before; null for the first one.

    Means are taken for each column of the picture, as the comparison does that this follows.  Each value
    adds to two cells of its frame, a histogram bin and a column: values are exploded and summed on the
    map side, so the shuffles carry cells, not pixels.
    """
    data = F.col("data")
    planes = {"rgb": [channel(data, c, k) for k in range(c)], "lab": pseudo_lab(data, c)}
    numbered = [(kind, plane) for kind, some in enumerate(planes.values()) for plane in some]
    cell = lambda at, v: F.struct(at.cast("int").alias("cell"), v.cast("double").alias("v"))

    def of_plane(p, kind, plane):
        column = F.transform(plane, lambda v, i: cell(128 + p * w + i % w, v))
        bins = F.transform(plane, lambda v: F.when(v.between(0, 1), cell(64 * kind + F.least(F.floor(v * 64), F.lit(63)), F.lit(1.0))))
        return F.concat(column, F.filter(bins, lambda x: x.isNotNull()))

    empty = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda b: cell(b, F.lit(0.0)))
    cells = frames.select("seq_id", "frame_idx", F.explode(F.concat(empty, *[of_plane(p, *kp) for p, kp in enumerate(numbered)])).alias("x"))
    summed = cells.groupBy("seq_id", "frame_idx", F.col("x.cell").alias("cell")).agg(F.sum("x.v").alias("v"))
    rows = summed.groupBy("seq_id", "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda x: x["v"]).alias("cells"))
    first = 129
    for kind, (name, some) in enumerate(planes.items()):
        share = bound(F.slice("cells", 64 * kind + 1, 64), lambda counts: F.transform(counts, lambda n: n / (F.aggregate(counts, F.lit(0.0), lambda s, v: s + v) + F.lit(1e-8))))
        rows = rows.withColumns({f"{name}_hist": share, f"{name}_mean": F.transform(F.slice("cells", first, len(some) * w), lambda v: v / h)})
        first += len(some) * w
    win = Window.partitionBy("seq_id").orderBy("frame_idx")
    scores = []
    for k in planes:
        hist, mean = F.col(f"{k}_hist"), F.col(f"{k}_mean")
        gap = 0.7 * (0.5 * _l1(hist, F.lag(hist).over(win))) + 0.3 * (_l1(mean, F.lag(mean).over(win)) / F.size(mean))
        scores.append(F.least(gap, F.lit(1.0)))
    start = F.lag("frame_idx").over(win).isNull()
    return rows.select("seq_id", "frame_idx", F.when(~start, F.greatest(*scores) * 20).alias("score"))


def adaptive_strength(score: Column, threshold: float, strength: float) -> Column:
    """Full strength up to the threshold, then falling to a fifth of it."""
    excess = F.lit(1.0) if threshold >= 1 else F.least((score - threshold) / (1.0 - threshold), F.lit(1.0))
    return F.when(score > threshold, strength * (1.0 - excess * 0.8)).otherwise(F.lit(float(strength)))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in ranges of ``order`` with _id, their places in the whole from 0: places within a range plus the sizes of the ranges before."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = written(placed.select("*", F.shiftright("_m", 33).alias("_p")), "placed")
    # one row for each range
    sizes = placed.groupBy("_p").agg((F.max("_m") - F.shiftleft(F.col("_p"), 33) + 1).alias("_n"))
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n") + F.lit(0)).alias("_s"))
    return placed.join(F.broadcast(starts), "_p").withColumn("_id", F.col("_s") + F.col("_m") - F.shiftleft(F.col("_p"), 33)).drop("_m", "_p", "_s")


def _folded(chunks: DataFrame, seq: str, chunk: int, n: int) -> DataFrame:
    """(seq, _c, o) of chunks (seq, _c, l): o holds y[t] = b[t] + k[t] y[t-1] for each (t, b, k) of l, with what earlier chunks carry.

    The recurrence is affine in the value before: a chunk's fold is one of a shorter sequence, folded in chunks in turn.
    """

    def step(a, x):
        y, k = x["b"] + x["k"] * a["y"], x["k"] * a["k"]
        return F.struct(y.alias("y"), k.alias("k"), F.concat(a["out"], F.array(F.struct(y.alias("y"), k.alias("k")))).alias("out"))

    zero = F.struct(F.lit(0.0).alias("y"), F.lit(1.0).alias("k"), F.array().cast("array<struct<y:double,k:double>>").alias("out"))
    done = chunks.withColumn("f", F.aggregate("l", zero, step))
    if n <= chunk:
        return done.withColumn("o", F.col("f.out.y")).drop("f")
    done = written(done, "folded")
    item = F.struct(F.col("_c").alias("t"), F.col("f.y").alias("b"), F.col("f.k").alias("k"))
    ends = done.groupBy(seq, F.floor(F.col("_c") / chunk).alias("_d")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    above = _folded(ends.withColumnRenamed("_d", "_c"), seq, chunk, -(-n // chunk))
    carried = above.select(F.col(seq).alias("_seq"), F.explode(F.arrays_zip(F.col("l.t").alias("t"), "o")).alias("z")).select("_seq", (F.col("z.t") + 1).alias("_next"), F.col("z.o").alias("carry"))
    # a sequence's chunks have consecutive numbers
    both = done.join(carried, F.col(seq).eqNullSafe(F.col("_seq")) & (F.col("_c") == F.col("_next")), "left")
    first = F.col("_next").isNull()
    return both.withColumn("o", F.transform("f.out", lambda x: F.when(first, x["y"]).otherwise(x["y"] + x["k"] * F.col("carry")))).drop("f", "_seq", "_next", "carry")


def smooth(rows: DataFrame, seq: str, order: list[str], value: str, s: float, chunk: int = 256) -> DataFrame:
    """Exponential smoothing out[t] = (1 - s) value[t] + s out[t-1], the first value as it is.

    Rows are dealt by ranges of (seq, order) and numbered by the sizes of the ranges, so a sequence of any length is
    spread over tasks; ``chunk`` rows at most are folded at once, and so are their carried values, level by level.
    Rows without a sequence are one; after a null value the rest of its sequence is null.
    """
    at = written(_numbered(rows.select(seq, *order, F.col(value).cast("double").alias("_v")), [seq, *order]), "numbered")
    n = at.count()
    item = F.struct("_id", F.col("_v").alias("v"), *order)
    parts = at.groupBy(seq, F.floor(F.col("_id") / chunk).alias("_c")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    start = at.groupBy(seq).agg(F.floor(F.min("_id") / chunk).alias("_first")).withColumnRenamed(seq, "_seq")
    parts = parts.join(start, F.col(seq).eqNullSafe(F.col("_seq")))
    fresh = lambda i: (F.col("_c") == F.col("_first")) & (i == 0)
    of = F.transform("rows", lambda x, i: F.struct(x["_id"].alias("t"), F.when(fresh(i), x["v"]).otherwise((1 - F.lit(s)) * x["v"]).alias("b"), F.when(fresh(i), F.lit(0.0)).otherwise(F.lit(float(s))).alias("k")))
    out = _folded(parts.withColumn("l", of).drop("_first", "_seq"), seq, chunk, n)
    out = out.select(seq, F.explode(F.arrays_zip("rows", "o")).alias("z"))
    return out.select(seq, *[F.col(f"z.rows.{o}").alias(o) for o in order], F.col("z.rows.v").alias(value), F.col("z.o").alias("smoothed"))


def corrected(frames: DataFrame, strength: float = 1.0, window: int = 5) -> DataFrame:
    """Frames matched in mean and spread to the average of up to ``window`` corrected frames before them.

    The recurrence feeds on its own results, so a sequence is worked through in order in one task,
    frame by frame; Spark sorts, and no more than a batch and ``window`` frames are held.
    """

    def run(batches):
        seq, last = None, []
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if name != seq:
                    seq, last = name, []
                x = np.asarray(data.as_py(), np.float64)
                if last:
                    ref = np.mean(last, axis=0)
                    y = (x - x.mean()) / max(x.std(), 1e-6) * ref.std() + ref.mean()
                    x = np.clip(x + strength * (y - x), 0, 1)
                last = [*last, x][-window:]
                out.append(x.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["seq_id", "frame_idx", "data"])

    rows = frames.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("frame_idx").cast("long").alias("frame_idx"), "data")
    return rows.repartition("seq_id").sortWithinPartitions("seq_id", "frame_idx").mapInArrow(run, "seq_id long, frame_idx long, data array<double>")


def colour_match(target: np.ndarray, reference: np.ndarray, method: str = "mkl", strength: float = 1.0) -> np.ndarray:
    """Pixels (n x 3) moved towards a reference's statistics, mixed by strength, clipped to [0, 1].

    'reinhard' matches means and deviations; 'mkl' is the linear Monge-Kantorovitch map of the two
    Gaussians; 'mvgd' takes the same map through the Cholesky factors; 'hm' matches each channel's
    distribution by rank; 'hm-mkl-hm' and 'hm-mvgd-hm' apply the three in turn.
    """
    t, r = np.asarray(target, np.float64), np.asarray(reference, np.float64)

    def step(x: np.ndarray, name: str) -> np.ndarray:
        if name == "hm":
            out = np.empty_like(x)
            for k in range(x.shape[1]):
                ranks = np.argsort(np.argsort(x[:, k], kind="stable"), kind="stable")
                out[:, k] = np.quantile(r[:, k], (ranks + 0.5) / len(x))
            return out
        if name == "reinhard":
            return (x - x.mean(0)) / np.maximum(x.std(0), 1e-8) * r.std(0) + r.mean(0)
        a, b = np.cov(x.T) + 1e-8 * np.eye(x.shape[1]), np.cov(r.T) + 1e-8 * np.eye(x.shape[1])
        if name == "mvgd":
            m = np.linalg.cholesky(b) @ np.linalg.inv(np.linalg.cholesky(a))
        else:
            val, vec = np.linalg.eigh(a)
            half, back = (vec * np.sqrt(val)) @ vec.T, (vec / np.sqrt(val)) @ vec.T
            val, vec = np.linalg.eigh(half @ b @ half)
            m = back @ ((vec * np.sqrt(np.maximum(val, 0))) @ vec.T) @ back
        return (x - x.mean(0)) @ m.T + r.mean(0)

    if method not in ("mkl", "hm", "reinhard", "mvgd", "hm-mvgd-hm", "hm-mkl-hm"):
        raise ValueError(method)
    y = t
    for name in method.split("-"):
        y = step(y, name)
    return np.clip(t + strength * (y - t), 0, 1)


def match_frames(frames: DataFrame, references: DataFrame, method: str = "mkl", strength: float = 1.0, c: int = 3) -> DataFrame:
    """Each frame matched to its reference (seq_id, frame_idx, ref): pairs are rows, matched batch by batch."""
    @F.pandas_udf("array<double>")
    def match(data: pd.Series, ref: pd.Series) -> pd.Series:
        n = lambda v: np.asarray(v, np.float64)[: len(v) // c * c].reshape(-1, c)
        return pd.Series([colour_match(n(x), n(y), method, strength).ravel().tolist() for x, y in zip(data, ref, strict=True)])

    joined = frames.join(references, ["seq_id", "frame_idx"])
    return joined.select("seq_id", "frame_idx", match("data", "ref").alias("data"))


def _windows(x: np.ndarray, r: int, mode: str) -> np.ndarray:
    """Sums over (2r + 1) x (2r + 1) windows of pictures (n, h, w, c), edges padded by mode."""
    pad = np.pad(x, ((0, 0), (r, r), (r, r), (0, 0)), mode=mode)
    rows = sum(pad[:, k : k + x.shape[1]] for k in range(2 * r + 1))
    return sum(rows[:, :, k : k + x.shape[2]] for k in range(2 * r + 1))


def stabilised(x: np.ndarray, dark: float = 0.3, bright: float = 0.7, dark_strength: float = 0.8, bright_strength: float = 0.8, dark_smoothing: float = 0.3, bright_smoothing: float = 0.2) -> np.ndarray:
    """Pictures (n, h, w, c), c one or three, whose shadows are lifted and highlights compressed.

    Zones are weights that fade out 0.1 beyond ``dark`` and ``bright``; a zone's core is where its weight
    is over 0.1.  In the core shadows are lifted by a fifth at most and highlights lowered by 15 % at most.
    Shadows move towards their core's mean, highlights away from the mean of the 5 x 5 around them.  At
    last each zone is mixed with its 3 x 3 mean, less so at edges.
    """
    level = x @ np.asarray(LUMA) if x.shape[3] == 3 else x[..., 0] * sum(LUMA)
    low, high = (np.clip(v, 0, 1)[..., None] for v in ((dark + 0.1 - level) / (dark + 0.1), (level - bright + 0.1) / (1.1 - bright)))
    level = level[..., None]

    def core_mean(v: np.ndarray, core: np.ndarray) -> np.ndarray:
        return np.where(core, v, 0).sum((1, 2), keepdims=True) / np.maximum(core.sum((1, 2), keepdims=True), 1)

    out = x.copy()
    if dark_strength > 0:
        core = low > 0.1
        lift = np.where(core, (dark - level) / dark * 0.2 * dark_strength, 0)
        out += low * x * lift + low * core.any((1, 2), keepdims=True) * 0.1 * dark_strength * (core_mean(x, core) - x)
    if bright_strength > 0:
        core = high > 0.1
        kept = np.where(core, np.clip(1 - (level - bright) / (1 - bright) * 0.15 * bright_strength, 0.7, 1), 1)
        detail = 0.8 * core_mean(kept, core)
        out += high * x * (kept - 1) + high * detail * (x - _windows(x, 2, "constant") / 25)
    calm = np.exp(-np.abs(9 * level - _windows(level, 1, "reflect")) / 0.1)
    for zone, strength in ((low, dark_smoothing), (high, bright_smoothing)):
        share = zone * calm * strength
        out = (1 - share) * out + share * _windows(out, 1, "reflect") / 9
    return np.clip(out, 0, 1)


def stabilise(frames: DataFrame, h: int, w: int, **settings: float) -> DataFrame:
    """Frames with stabilised contrast, each by itself, in batches of Arrow rows; see ``stabilised``."""

    @F.pandas_udf("array<double>")
    def run(data: pd.Series) -> pd.Series:
        x = np.stack(data.to_numpy()).astype(np.float64).reshape(len(data), h, w, -1)
        return pd.Series(stabilised(x, **settings).reshape(len(data), -1).tolist())

    return frames.withColumn("data", run("data"))
