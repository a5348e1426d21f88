"""Colour correction against a reference picture: cast, chroma, zones, local contrast, and their sequence in time.

Pictures are (n, h, w, 3) arrays in [0, 1] inside Arrow batches; Spark pairs frames with references, orders
sequences and carries nothing but rows.  Where frames correct each other (rolling, previous), a sequence is
streamed in order through one task, as the recurrence asks, holding a few frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.operators import stats

#: Luminance zones of a picture and the wider ones of its reference.
ZONES = [((-np.inf, 0.3), (-np.inf, 0.4)), ((0.3, 0.7), (0.25, 0.75)), ((0.7, np.inf), (0.6, np.inf))]


def level(x: np.ndarray) -> np.ndarray:
    a, b, c = stats.LUMA
    return a * x[..., 0] + b * x[..., 1] + c * x[..., 2]


def _per_frame(strength) -> np.ndarray:
    return np.asarray(strength, np.float64).reshape(-1, 1, 1, 1)


def white_balance(x: np.ndarray, ref: np.ndarray, strength=0.5) -> np.ndarray:
    """Channels scaled by the ratio of their means, by a fifth at most."""
    ratio = np.clip(ref.mean((1, 2), keepdims=True) / (x.mean((1, 2), keepdims=True) + 1e-8), 0.8, 1.2)
    return np.clip(x * (1 + _per_frame(strength) * (ratio - 1)), 0, 1)


def chroma_shift(x: np.ndarray, ref: np.ndarray, strength=0.5) -> np.ndarray:
    """Colour differences moved by the difference of their means; luminance stays."""
    y, s = level(x), np.asarray(strength, np.float64).reshape(-1, 1, 1)
    mean = lambda p, k: (p[..., k] - level(p)).mean((1, 2), keepdims=True)
    u, v = (x[..., k] - y + s * (mean(ref, k) - mean(x, k)) for k in (2, 0))
    a, b, c = stats.LUMA
    return np.clip(np.stack([y + v, y - a * v / b - c * u / b, y + u], -1), 0, 1)


def zone_shift(x: np.ndarray, ref: np.ndarray, strength=0.5) -> np.ndarray:
    """Each luminance zone moved by the difference of its mean colour and that of the reference's zone, if both have pixels."""
    y, ry, out, s = level(x), level(ref), x.copy(), _per_frame(strength)
    for (low, high), (ref_low, ref_high) in ZONES:
        here, there = ((y >= low) & (y < high))[..., None], ((ry >= ref_low) & (ry < ref_high))[..., None]
        mean = lambda p, zone: np.where(zone, p, 0).sum((1, 2), keepdims=True) / np.maximum(zone.sum((1, 2), keepdims=True), 1)
        both = here & there.any((1, 2), keepdims=True)
        out = np.where(both, np.clip(x + s * (mean(ref, there) - mean(x, here)), 0, 1), out)
    return out


def lighting(x: np.ndarray, ref: np.ndarray) -> dict[str, np.ndarray]:
    """How a picture's light differs from its reference's: dark and bright parts of the histogram, contrast, cast, spread."""
    y, ry = level(x).reshape(len(x), -1), level(ref).reshape(len(x), -1)

    def shares(v):
        counts = np.array([np.histogram(p, 32, (0, 1))[0] for p in v])
        return counts / (counts.sum(1, keepdims=True) + 1e-8)

    gap, std = np.abs(shares(ry) - shares(y)), y.std(1, ddof=1)
    cast = np.abs(x.mean((1, 2)) - ref.mean((1, 2))).max(1)
    return {"dark": gap[:, :10].sum(1), "bright": gap[:, 22:].sum(1), "contrast": std, "cast": cast, "spread": np.abs(ry.std(1, ddof=1) - std)}


def advanced(x: np.ndarray, ref: np.ndarray, strength: float, method: str = "mkl", required: float = 0.1, multiply=(0.8, 0.7, 0.8), share=(1.0, 1.0, 1.0)) -> np.ndarray:
    """One picture (h, w, 3) corrected in steps whose strengths follow what differs, until the strength is used up.

    Cast, then chroma, then zones, then a plain match with what is left; ``multiply`` and ``share`` weigh the three
    steps.  Pictures that hardly differ get a single step.
    """
    if strength <= 0:
        return x
    one = lambda f, p, s: f(p[None], ref[None], s)[0]
    plain = lambda p, s: stats.colour_match(p.reshape(-1, 3), ref.reshape(-1, 3), method, s).reshape(p.shape)
    seen = lambda p: {k: v[0] for k, v in lighting(p[None], ref[None]).items()}
    light = seen(x)
    cast, contrast, mixed = min(light["cast"] * 100, 1), min(light["contrast"] / 0.25, 1), min((light["dark"] + light["bright"]) * 3, 1)
    if cast + contrast + mixed <= required:
        high = light["contrast"] > 0.18
        if light["dark"] > 0.03 and light["bright"] > 0.03 and high:
            return one(zone_shift, x, 0.7 * strength)
        if high:
            return one(chroma_shift, x, strength)
        return one(white_balance, x, strength) if light["cast"] > 0.01 else plain(x, strength)
    out, left = x, strength
    s = min(left * cast / (cast + contrast + mixed) * multiply[0], 0.4 * strength)
    if cast > 0.1 and left > 0.05 and s > 0.05:
        out, left = one(white_balance, out, s * share[0]), left - s
        light = seen(out)
        contrast, mixed = min(light["contrast"] / 0.25, 1), min((light["dark"] + light["bright"]) * 15, 1)
    s = min(left * contrast / max(contrast + mixed, 0.1) * multiply[1], 0.5 * strength)
    if contrast > 0.1 and left > 0.05 and s > 0.05:
        out, left = one(chroma_shift, out, s * share[1]), left - s
    s = min(left * multiply[2], 0.4 * strength)
    if mixed > 0.1 and left > 0.05 and s > 0.05:
        out, left = one(zone_shift, out, s * share[2]), left - s
    return plain(out, left) if left > 0.01 * strength else out


def box_mean(x: np.ndarray, r: int) -> np.ndarray:
    """Means of pictures (n, h, w) over (2r + 1) x (2r + 1) windows, edges reflected.

    From a summed-area table: four corners for each pixel, whatever the radius.
    """
    n, h, w = x.shape
    p = np.pad(x, ((0, 0), (r, r), (r, r)), mode="reflect" if r else "edge")
    area = np.zeros((n, h + 2 * r + 1, w + 2 * r + 1))
    area[:, 1:, 1:] = p.cumsum(1).cumsum(2)
    k = 2 * r + 1
    return (area[:, k:, k:] - area[:, :-k, k:] - area[:, k:, :-k] + area[:, :-k, :-k]) / (k * k)


def with_window_mean(frames: DataFrame, h: int, w: int, r: int, name: str) -> DataFrame:
    """Frames of one channel with a column of the means around each pixel; see ``box_mean``."""

    @F.pandas_udf("array<double>")
    def run(data: pd.Series) -> pd.Series:
        if not len(data):
            return pd.Series([], dtype=object)
        x = np.stack(data.to_numpy()).astype(np.float64).reshape(len(data), h, w)
        return pd.Series(box_mean(x, r).reshape(len(x), -1).tolist())

    return frames.withColumn(name, run("data"))


def local_contrast(x: np.ndarray, ref: np.ndarray, dark: float = 0.3, bright: float = 0.7, dark_strength: float = 0.8, bright_strength: float = 0.8, dark_smoothing: float = 0.3, bright_smoothing: float = 0.2) -> np.ndarray:
    """Shadows and highlights brought to the reference's local means, then smoothed away from edges.

    A zone's weight fades out 0.1 beyond its threshold; where it is over 0.1 pixels are scaled by the ratio of
    local means (7 x 7 in shadows, 11 x 11 in highlights), mixed with the zone's difference in colour.
    """
    y, ry, out = level(x), level(ref), x.copy()
    low = np.clip((dark + 0.1 - y) / (dark + 0.1), 0, 1)
    high = np.clip((y - bright + 0.1) / (1.1 - bright), 0, 1)
    for weight, strength, r, bounds, mix in ((low, dark_strength, 3, (0.85, 1.4), 0.4), (high, bright_strength, 5, (0.6, 1.15), 0.6)):
        core = weight > 0.1
        mean, ref_mean = box_mean(y, r), box_mean(ry, r)
        factor = np.clip(ref_mean / (mean + 1e-8), *bounds)[..., None]
        colour = np.where(core[..., None], ref - x, 0).sum((1, 2), keepdims=True) / np.maximum(core.sum((1, 2)), 1)[:, None, None, None]
        change = strength * (mix * x * (factor - 1) + (1 - mix) * colour)
        out += np.where((core & (mean > 1e-6))[..., None], change * weight[..., None], 0)
    calm = np.exp(-np.abs(9 * (y - box_mean(y, 1))) / 0.1)
    for weight, smoothing in ((low, dark_smoothing), (high, bright_smoothing)):
        share = (weight * calm * smoothing)[..., None]
        smooth = np.stack([box_mean(out[..., k], 1) for k in range(3)], -1)
        out = (1 - share) * out + share * smooth
    return np.clip(out, 0, 1)


STEPS = {"white_balance": white_balance, "chroma": chroma_shift, "zones": zone_shift, "contrast": local_contrast}


def correct(frames: DataFrame, references: DataFrame, h: int, w: int, step: str, **settings) -> DataFrame:
    """Each frame after one of STEPS against its reference (seq_id, frame_idx, ref)."""

    @F.pandas_udf("array<double>")
    def run(data: pd.Series, ref: pd.Series) -> pd.Series:
        if not len(data):
            return pd.Series([], dtype=object)
        x, y = (np.stack(v.to_numpy()).astype(np.float64).reshape(len(v), h, w, 3) for v in (data, ref))
        return pd.Series(STEPS[step](x, y, **settings).reshape(len(x), -1).tolist())

    return frames.join(references, ["seq_id", "frame_idx"]).withColumn("data", run("data", "ref")).drop("ref")


def first_frames(frames: DataFrame, first: int, h: int, w: int, method: str | None = "mkl", strength: float = 1.0, contrast: bool = False, **settings) -> DataFrame:
    """Frames behind a sequence's first ones matched to the nearest of these by brightness; the first ones stay.

    The nearest is found on signatures, so pictures are joined only with the one they are matched to.
    """
    rows = frames.select("seq_id", "frame_idx", "data")
    near = stats.nearest_reference(stats.signature(rows, 3), first)
    refs = rows.where(F.col("frame_idx") < first).select("seq_id", F.col("frame_idx").alias("ref_idx"), F.col("data").alias("ref"))
    pairs = near.join(refs, ["seq_id", "ref_idx"]).select("seq_id", "frame_idx", "ref")
    late = rows.where(F.col("frame_idx") >= first)
    if method and strength > 0:
        late = stats.match_frames(late, pairs, method, strength)
    if contrast:
        late = correct(late, pairs, h, w, "contrast", **settings)
    return rows.where(F.col("frame_idx") < first).unionByName(late.select("seq_id", "frame_idx", "data"))


def zone_signature(frames: DataFrame, dark: float = 0.3, bright: float = 0.7) -> DataFrame:
    """(seq_id, frame_idx, contrast and, for shadows and highlights, area, level, r, g, b, saturation) of colour frames.

    A zone without pixels has area and saturation 0 and a middle grey.  Pixels are exploded and summed on the map side.
    """
    pixel = lambda i, k: F.element_at("data", i * 3 + k + 1)
    pixels = F.transform(F.sequence(F.lit(0), (F.size("data") / 3).cast("int") - 1), lambda i: F.struct(*[pixel(i, k).alias(n) for k, n in enumerate("rgb")]))
    px = frames.select("seq_id", "frame_idx", F.explode(pixels).alias("p")).select("seq_id", "frame_idx", "p.*")
    px = px.withColumn("y", sum(w * F.col(n) for w, n in zip(stats.LUMA, "rgb", strict=True)))
    px = px.withColumn("s", (F.greatest("r", "g", "b") - F.least("r", "g", "b")) / (F.greatest("r", "g", "b") + 1e-8))
    zones = {"shadow": F.col("y") < dark, "highlight": F.col("y") > bright}
    told = []
    for name, inside in zones.items():
        told.append((F.count_if(inside) / F.count("*")).alias(f"{name}_area"))
        for column, label, default in (("y", "level", 0.5), ("r", "r", 0.5), ("g", "g", 0.5), ("b", "b", 0.5), ("s", "saturation", 0.0)):
            told.append(F.coalesce(F.avg(F.when(inside, F.col(column))), F.lit(default)).alias(f"{name}_{label}"))
    ends = F.percentile("y", F.array(F.lit(0.1), F.lit(0.9)))
    return px.groupBy("seq_id", "frame_idx").agg((F.element_at(ends, 2) - F.element_at(ends, 1)).alias("contrast"), *told)


def recoloured(frames: DataFrame, h: int, w: int, reference: str = "rolling", method: str = "mkl", strength: float = 1.0, threshold: float | None = 0.3, smoothing: float = 0.0, steps: bool = True, window: int = 5, **settings) -> DataFrame:
    """Frames corrected in order against corrected ones: the mean of the last ``window``, the previous, or the first as it was.

    With a ``threshold`` the strength falls where scenes change (scores are computed for all frames at once, before the
    sequence is streamed); ``smoothing`` mixes in the corrected frame before; ``steps`` chooses ``advanced`` or a plain match.
    """
    if reference not in ("rolling", "previous", "first"):
        raise ValueError(reference)
    rows = frames.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("frame_idx").cast("long").alias("frame_idx"), "data")
    if threshold is None:
        rows = rows.withColumn("strength", F.lit(float(strength)))
    else:
        score = stats.scene_change(rows, h, w, 3).select("seq_id", "frame_idx", F.coalesce(stats.adaptive_strength(F.col("score"), threshold, strength), F.lit(float(strength))).alias("strength"))
        rows = rows.join(score, ["seq_id", "frame_idx"], "left")

    def run(batches):
        seq, last, first = None, [], None
        for batch in batches:
            out = []
            for k, name in enumerate(batch.column(0).to_pylist()):
                x = batch.column(2)[k].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(h, w, 3)
                if k == 0 and first is None or name != seq:
                    seq, last, first = name, [], x
                ref = first if reference == "first" or not last else np.mean(last, axis=0) if reference == "rolling" else last[-1]
                s = batch.column(3)[k].as_py()
                y = advanced(x, ref, s, method, **settings) if steps else stats.colour_match(x.reshape(-1, 3), ref.reshape(-1, 3), method, s).reshape(x.shape) if s > 0 else x
                if smoothing > 0 and last:
                    y = np.clip((1 - smoothing) * y + smoothing * last[-1], 0, 1)
                last = [*last, y][-(window if reference == "rolling" else 1) :]
                out.append(y.ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["seq_id", "frame_idx", "data"])

    return rows.select("seq_id", "frame_idx", "data", "strength").repartition("seq_id").sortWithinPartitions("seq_id", "frame_idx").mapInArrow(run, "seq_id long, frame_idx long, data array<double>")
