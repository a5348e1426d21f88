"""Poses as pixels: shapes of limbs, hands and faces, scan-converted into rows and painted in order.

Every shape is a row.  It is cut into the pixel rows it covers, each row into its pixels, and of the shapes that
cover a pixel the last one in painting order gives the colour: a map-side aggregate, so what is shuffled are
pixels, not shapes times pixels.  A pixel belongs to a shape if its place does: at most 1 from an ellipse's
centre in units of its axes, at most the radius from a point, at most 1 from a hand's line.

``drawn`` gives the same pixels from whole frames, a row each, and shuffles nothing: a task paints its frames in
Arrow batches.
"""

from __future__ import annotations

import colorsys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelweave.operators import geometry as G

#: Colours of the body's limbs and points, in the order of the body model.
COLOURS = [
    (255, 0, 0), (255, 85, 0), (255, 170, 0), (255, 255, 0), (170, 255, 0), (85, 255, 0), (0, 255, 0), (0, 255, 85), (0, 255, 170),
    (0, 255, 255), (0, 170, 255), (0, 85, 255), (0, 0, 255), (85, 0, 255), (170, 0, 255), (255, 0, 255), (255, 0, 170), (255, 0, 85),
]
#: A hand has five fingers of four points each, which start at its first point.
FINGERS = [(4 * f + j if j else 0, 4 * f + j + 1) for f in range(5) for j in range(4)]
HAND, FACE = (0, 0, 255), (255, 255, 255)
_EPS = 1e-9
#: Cells of the canvases that are painted at once (one canvas at least), and pixels of shapes that are laid at once.
_CELLS, _LAID = 1 << 19, 1 << 17


def load_poses(spark: SparkSession, path: str) -> DataFrame:
    """(columns of the path's partitions, file, poses, frames, error) of JSON files, one row each.

    A file holds one pose frame or a list of them; the error says that it holds neither.  ``poses`` is the list as text, ``frames``
    as an array; both are null with an error.
    """
    files = spark.read.text(path, wholetext=True)
    text = F.when(F.ltrim("value").startswith("{"), F.concat(F.lit("["), F.col("value"), F.lit("]"))).otherwise(F.col("value"))
    # a frame without a canvas is none: JSON of another kind parses to nulls
    odd = lambda frames: F.exists(frames, lambda f: f["canvas_width"].isNull() | f["canvas_height"].isNull())
    # in an array of its own, so that a text is parsed once
    frames = F.get(F.transform(F.array(F.from_json(text, G.POSE)), lambda frames: F.when(~odd(frames), frames)), F.lit(0))
    keys = [c for c in files.columns if c != "value"]
    bad = frames.isNull()
    return files.select(*keys, F.input_file_name().alias("file"), F.when(~bad, text).alias("poses"), frames.alias("frames"), F.when(bad, F.lit("not a list of pose frames")).alias("error"))


def pose_frames(poses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, people) of loaded files; those with an error have none."""
    # outer: else Spark filters by the array first, and so parses again
    return poses.select(*keys, F.posexplode_outer("frames").alias("frame", "f")).where("frame IS NOT NULL").select(*keys, "frame", "f.people")


def keypoints(poses: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, frame, person, part, k, x, y) of JSON lists of pose frames; points scored below 1 are null."""
    frames = poses.select(*keys, F.posexplode(F.from_json(text, G.POSE)).alias("frame", "f"))
    people = frames.select(*keys, "frame", F.posexplode("f.people").alias("person", "p"))
    parts = F.array(*[F.struct(F.lit(n).alias("part"), F.col(f"p.{n}_keypoints_2d").alias("v")) for n in ("pose", "hand_left", "hand_right", "face")])
    flat = people.select(*keys, "frame", "person", F.explode(parts).alias("q")).where(F.size("q.v") >= 3)
    point = lambda k: F.struct(*[F.when(F.element_at("q.v", 3 * k + 3) >= 1, F.element_at("q.v", 3 * k + j + 1)).alias(n) for j, n in enumerate("xy")])
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("q.v") / 3).cast("int") - 1), point)
    return flat.select(*keys, "frame", "person", "q.part", F.posexplode(points).alias("k", "p")).select(*keys, "frame", "person", "part", "k", "p.*")


def _thick(h: int, w: int, wide: bool) -> int:
    return 4 * (min(2 + max(h, w) // 1000, 7) if wide and max(h, w) >= 500 else 1)


def _colour(c: tuple) -> Column:
    return F.array(*[F.lit(int(v)) for v in c])


def shapes(points: DataFrame, h: int, w: int, keys: list[str], wide: bool = False, body: bool = True, hands: bool = True, face: bool = True) -> DataFrame:
    """(keys, frame, person, z, kind, cx, cy, a, b, angle, x2, y2, colour) of all shapes that points in [0, 1] make.

    ``wide`` scales the limbs with large canvases.  ``z`` orders a person's shapes: limbs, body points, then each hand's lines and
    points, then the face.
    """
    thick = _thick(h, w, wide)
    own = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys, "frame", "person", "part").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct((F.col("x") * w).alias("x"), (F.col("y") * h).alias("y"))))).alias("at"))
    number = lambda v: v.cast("int")

    def shape(z, kind, colour, cx, cy, a=None, b=None, angle=None, x2=None, y2=None):
        rest = {"a": a, "b": b, "angle": angle, "x2": x2, "y2": y2}
        return F.struct(F.lit(z).alias("z"), F.lit(kind).alias("kind"), number(cx).alias("cx"), number(cy).alias("cy"), *[(F.lit(None) if v is None else v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in rest.items()], _colour(colour).alias("colour"))

    def pair(i, j, made):
        p, q = (F.element_at("at", F.lit(k)) for k in (i, j))
        return F.when(p.isNotNull() & q.isNotNull(), made(p, q))

    def limb(i, a, b):
        def made(p, q):
            length = F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2)
            angle = number(F.degrees(F.atan2(p["y"] - q["y"], p["x"] - q["x"])))
            return shape(i, "ellipse", [int(v * 0.6) for v in COLOURS[i]], (p["x"] + q["x"]) / 2, (p["y"] + q["y"]) / 2, F.greatest(number(length / 2).cast("double"), F.lit(0.5)), thick, angle)

        return pair(a - 1, b - 1, made)

    def line(i, a, b, base):
        tone = [round(255 * v) for v in colorsys.hsv_to_rgb(i / len(FINGERS), 1, 1)]
        return pair(a, b, lambda p, q: shape(base + i, "line", tone, p["x"], p["y"], x2=number(q["x"]), y2=number(q["y"])))

    def dot(k, colour, base, r):
        return F.when(F.element_at("at", F.lit(k)).isNotNull(), shape(base + k, "ellipse", colour, F.element_at("at", F.lit(k))["x"], F.element_at("at", F.lit(k))["y"], r, r, 0))

    made = {}
    if body:
        made["pose"] = F.array(*[limb(i, a, b) for i, (a, b) in enumerate(G.LIMBS)], *[dot(k, c, 100, 4) for k, c in enumerate(COLOURS)])
    if hands:
        for base, part in ((200, "hand_left"), (300, "hand_right")):
            made[part] = F.array(*[line(i, a, b, base) for i, (a, b) in enumerate(FINGERS)], *[dot(k, HAND, base + 50, 4) for k in range(21)])
    out = [own.where(F.col("part") == part).select(*keys, "frame", "person", F.explode(F.filter(some, lambda s: s.isNotNull())).alias("s")) for part, some in made.items()]
    if face:
        each = F.explode(F.map_entries("at")).alias("e")
        dots = own.where("part = 'face'").select(*keys, "frame", "person", each)
        out.append(dots.select(*keys, "frame", "person", F.struct((F.col("e.key") + 400).cast("int").alias("z"), F.lit("ellipse").alias("kind"), *[number(F.col(f"e.value.{n}")).alias(f"c{n}") for n in "xy"], *[F.lit(v).cast("double").alias(n) for n, v in zip("ab", (3, 3), strict=True)], F.lit(0.0).alias("angle"), F.lit(None).cast("double").alias("x2"), F.lit(None).cast("double").alias("y2"), _colour(FACE).alias("colour")).alias("s")))
    if not out:
        raise ValueError("nothing to draw")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select(*keys, "frame", "person", "s.*")


def _inside() -> Column:
    """Whether the pixel (x, y) belongs to its row's shape."""
    dx, dy, t = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.radians("angle")
    along, across = (dx * F.cos(t) + dy * F.sin(t)) / F.col("a"), (dy * F.cos(t) - dx * F.sin(t)) / F.col("b")
    lx, ly = F.col("x2") - F.col("cx"), F.col("y2") - F.col("cy")
    share = F.least(F.greatest((dx * lx + dy * ly) / F.greatest(lx * lx + ly * ly, F.lit(_EPS)), F.lit(0.0)), F.lit(1.0))
    gap = (dx - share * lx) ** 2 + (dy - share * ly) ** 2
    return F.when(F.col("kind") == "line", gap <= 1 + _EPS).otherwise(along**2 + across**2 <= 1 + _EPS)


def raster(shapes: DataFrame, h: int, w: int, keys: list[str], separate: bool = False) -> DataFrame:
    """(keys, frame, y, x, r, g, b) of the pixels that shapes cover; with ``separate`` a canvas for each person."""
    t, a, b = F.radians("angle"), F.col("a"), F.col("b")
    line = F.col("kind") == "line"
    # half the height of a turned ellipse; a line reaches 1 beyond its ends
    tall = F.sqrt((a * F.sin(t)) ** 2 + (b * F.cos(t)) ** 2)
    low = F.when(line, F.least("cy", "y2") - 1).otherwise(F.col("cy") - tall)
    high = F.when(line, F.greatest("cy", "y2") + 1).otherwise(F.col("cy") + tall)
    whole = lambda v, f, most: F.least(F.greatest(f(v).cast("int"), F.lit(-1)), F.lit(most))
    rows = shapes.withColumns({"_low": whole(low - 1e-6, F.ceil, h), "_high": whole(high + 1e-6, F.floor, h)})
    rows = rows.where("_high >= _low AND _high >= 0 AND _low < " + str(h)).withColumn("y", F.explode(F.sequence(F.greatest("_low", F.lit(0)), F.least("_high", F.lit(h - 1)))))
    # an ellipse's row: where A dx^2 + B dx dy + C dy^2 = 1
    dy = F.col("y") - F.col("cy")
    p, q, s = (F.cos(t) / a) ** 2 + (F.sin(t) / b) ** 2, 2 * F.cos(t) * F.sin(t) * (1 / a**2 - 1 / b**2), (F.sin(t) / a) ** 2 + (F.cos(t) / b) ** 2
    root = F.sqrt(F.greatest((q * dy) ** 2 - 4 * p * (s * dy * dy - 1), F.lit(0.0)))
    # a line's row: the part of the line within 1 of it, and 1 to both sides
    rise = F.col("y2") - F.col("cy")
    at = lambda y: F.when(rise == 0, F.lit(None)).otherwise(F.least(F.greatest((y - F.col("cy")) / rise, F.lit(0.0)), F.lit(1.0)))
    ends = [F.col("cx") + F.coalesce(at(F.col("y") + k), F.lit(e)) * (F.col("x2") - F.col("cx")) for k, e in ((-1, 0.0), (1, 1.0))]
    left = F.when(line, F.least(*ends) - 1).otherwise(F.col("cx") + (-q * dy - root) / (2 * p))
    right = F.when(line, F.greatest(*ends) + 1).otherwise(F.col("cx") + (-q * dy + root) / (2 * p))
    rows = rows.withColumns({"_left": whole(left - 1e-6, F.ceil, w), "_right": whole(right + 1e-6, F.floor, w)})
    rows = rows.where("_right >= _left AND _right >= 0 AND _left < " + str(w)).withColumn("x", F.explode(F.sequence(F.greatest("_left", F.lit(0)), F.least("_right", F.lit(w - 1)))))
    canvas = [*keys, "frame", *(["person"] if separate else [])]
    last = F.max_by("colour", F.struct("person", "z")).alias("c")
    return rows.where(_inside()).groupBy(*canvas, "y", "x").agg(last).select(*canvas, "y", "x", *[F.element_at("c", k + 1).alias(n) for k, n in enumerate("rgb")])


def _lists(v: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers and (x, y, score) of the points of each list; a value that is null is -inf."""
    n = pc.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = v.flatten().cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
    whole = np.repeat(np.cumsum(n) - n, n // 3 * 3) + _counted(n // 3 * 3)
    return np.cumsum(n // 3) - n // 3, n // 3, values[whole].reshape(-1, 3)


def _counted(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of n numbers, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _outlines(people: pa.StructArray, h: int, w: int, thick: int, body: bool, hands: bool, face: bool) -> dict[str, np.ndarray]:
    """Shapes as in ``shapes``, in the order of people and z: who, z, cx, cy, a, b, angle, a line's way (to_x, to_y) and its colour as one number."""
    parts = dict(zip([f.name for f in people.type], people.flatten(), strict=True))
    found: list[dict] = []

    def add(who, z, colour, cx, cy, a=0.0, b=0.0, angle=0.0, to_x=0.0, to_y=0.0):
        red, green, blue = np.asarray(colour).reshape(-1, 3).T
        every = np.broadcast_arrays(who, z, cx, cy, a, b, angle, to_x, to_y, red << 16 | green << 8 | blue)
        found.append(dict(zip(("who", "z", "cx", "cy", "a", "b", "angle", "to_x", "to_y", "colour"), [x.ravel() for x in every], strict=True)))

    def points(part):
        start, n, p = _lists(parts[f"{part}_keypoints_2d"])
        at = p[:, :2] * [w, h]
        seen = ~(p[:, 2] < 1) & (np.abs(at) < 2**31).all(axis=1)
        return start, n, np.where(seen[:, None], at, np.nan)

    def first(part, count):
        """(people, count, 2): the first points, NaN where there is none."""
        start, n, p = points(part)
        at = np.arange(count)
        there = at < n[:, None]
        out = np.full((len(n), count, 2), np.nan)
        out[there] = p[(start[:, None] + at)[there]]
        return out

    def dots(p, z, colour, r):
        who, k = np.nonzero(~np.isnan(p[..., 0]))
        add(who, z + k, np.broadcast_to(colour, (p.shape[1], 3))[k], *np.trunc(p[who, k]).T, a=r, b=r)

    def pairs(p, ends):
        i, j = np.array(ends).T
        who, k = np.nonzero(~np.isnan(p[:, i, 0]) & ~np.isnan(p[:, j, 0]))
        return who, k, p[who, i[k]], p[who, j[k]]

    if body:
        p = first("pose", 18)
        who, k, one, other = pairs(p, [(a - 1, b - 1) for a, b in G.LIMBS])
        d = one - other
        angle = np.trunc(np.degrees(np.arctan2(d[:, 1], d[:, 0])))
        add(who, k, (np.array(COLOURS) * 0.6).astype(int)[k], *np.trunc((one + other) / 2).T, a=np.maximum(np.trunc(np.sqrt((d**2).sum(axis=1)) / 2), 0.5), b=thick, angle=angle)
        dots(p, 100, COLOURS, 4)
    if hands:
        tones = np.array([[round(255 * v) for v in colorsys.hsv_to_rgb(i / len(FINGERS), 1, 1)] for i in range(len(FINGERS))])
        for base, part in ((200, "hand_left"), (300, "hand_right")):
            p = first(part, 21)
            who, k, one, other = pairs(p, FINGERS)
            one, other = np.trunc(one), np.trunc(other)
            add(who, base + k, tones[k], *one.T, to_x=(other - one)[:, 0], to_y=(other - one)[:, 1])
            dots(p, base + 50, HAND, 4)
    if face:
        _, n, p = points("face")
        seen = ~np.isnan(p[:, 0])
        add(np.repeat(np.arange(len(n)), n)[seen], 400 + _counted(n)[seen], np.array([FACE]), *np.trunc(p[seen]).T, a=3, b=3)
    shape = {k: np.concatenate([x[k] for x in found]) for k in found[0]}
    order = np.lexsort((shape["z"], shape["who"]))
    return {k: v[order] for k, v in shape.items()}


def _stencils(f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of pixels of forms around (0, 0) within windows, and the pixels' y and x: row by row as in ``raster``."""
    line, a, b, t, lx, ly = f["b"] == 0, f["a"], f["b"], np.radians(f["angle"]), f["to_x"], f["to_y"]
    a, b = np.where(line, 1, a), np.where(line, 1, b)
    cos, sin = np.cos(t), np.sin(t)
    tall = np.sqrt((a * sin) ** 2 + (b * cos) ** 2)
    top = np.maximum(np.ceil(np.where(line, np.minimum(ly, 0) - 1, -tall) - 1e-6), f["y0"])
    n = np.maximum(np.minimum(np.floor(np.where(line, np.maximum(ly, 0) + 1, tall) + 1e-6), f["y1"]) - top + 1, 0).astype(np.int64)
    i = np.repeat(np.arange(len(n)), n)
    y = top[i] + _counted(n)
    p, q, s = ((cos / a) ** 2 + (sin / b) ** 2)[i], (2 * cos * sin * (1 / a**2 - 1 / b**2))[i], ((sin / a) ** 2 + (cos / b) ** 2)[i]
    root = np.sqrt(np.maximum((q * y) ** 2 - 4 * p * (s * y * y - 1), 0))
    rise = ly[i]
    ends = [np.where(rise == 0, e, np.clip((y + k) / np.where(rise == 0, 1, rise), 0, 1)) * lx[i] for k, e in ((-1, 0), (1, 1))]
    left = np.where(line[i], np.minimum(*ends) - 1, (-q * y - root) / (2 * p))
    right = np.where(line[i], np.maximum(*ends) + 1, (-q * y + root) / (2 * p))
    left = np.maximum(np.ceil(left - 1e-6), f["x0"][i])
    wide = np.maximum(np.minimum(np.floor(right + 1e-6), f["x1"][i]) - left + 1, 0).astype(np.int64)
    x, y, i = np.repeat(left, wide) + _counted(wide), np.repeat(y, wide), np.repeat(i, wide)
    along, across = (x * cos[i] + y * sin[i]) / a[i], (y * cos[i] - x * sin[i]) / b[i]
    share = np.clip((x * lx[i] + y * ly[i]) / np.maximum(lx * lx + ly * ly, _EPS)[i], 0, 1)
    inside = np.where(line[i], (x - share * lx[i]) ** 2 + (y - share * ly[i]) ** 2, along**2 + across**2) <= 1 + _EPS
    return np.bincount(i[inside], minlength=len(n)), y[inside].astype(np.int32), x[inside].astype(np.int32)


def _paint(canvas: np.ndarray, own: np.ndarray, shape: dict[str, np.ndarray], h: int, w: int) -> None:
    """Lay shapes one after the other onto the flat canvases that own them."""
    near = (shape["cx"] >= 0) & (shape["cx"] <= w) & (shape["cy"] >= 0) & (shape["cy"] <= h)
    # shapes of one form share its pixels; a centre beyond the canvas has a form of its own
    line, alone = shape["b"] == 0, np.where(near, -1, np.arange(len(near)))
    form = {"u": np.where(line, shape["to_x"], shape["a"]), "v": np.where(line, shape["to_y"], shape["angle"]), "b": shape["b"], "alone": alone}
    ids = pd.DataFrame(form).groupby(list(form), sort=False).ngroup().to_numpy()
    _, example = np.unique(ids, return_index=True)
    f = {k: shape[k][example] for k in ("a", "b", "angle", "to_x", "to_y")}
    for c, size in (("x", w), ("y", h)):
        f[f"{c}0"], f[f"{c}1"] = (np.where(near, v, e - shape[f"c{c}"])[example] for v, e in ((-size, 0), (size, size - 1)))
    most = np.where(f["b"] == 0, 4 * (np.abs(f["to_x"]) + np.abs(f["to_y"])), 4 * f["a"] * f["b"]) + 64
    parts = [_stencils({k: v[j] for k, v in f.items()}) for j in _pieces(np.minimum(most, 4 * (h + 1) * (w + 1)))]
    n, dy, dx = (np.concatenate(x) for x in zip(*parts, strict=True))
    start, n = (np.cumsum(n) - n)[ids], n[ids]
    cy, cx, base = shape["cy"].astype(np.int32), shape["cx"].astype(np.int32), own * h * w
    for j in _pieces(n):
        many = lambda v: np.repeat(v[j], n[j])  # noqa: B023, E731
        at = many(start) + _counted(n[j])
        y, x = many(cy) + dy[at], many(cx) + dx[at]
        on = (y >= 0) & (y < h) & (x >= 0) & (x < w)
        # of equal places the last one stays
        canvas[(many(base) + y * w + x)[on]] = many(shape["colour"])[on]


def _pieces(n: np.ndarray) -> list[slice]:
    """Cuts of a list whose sums are about _LAID at most, with one item at least."""
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // _LAID)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(n)], strict=True)]


def drawn(frames: DataFrame, h: int, w: int, keys: list[str], wide: bool = False, body: bool = True, hands: bool = True, face: bool = True) -> DataFrame:
    """(keys, frame, y, x, r, g, b) of the pixels that the people of each frame cover: what ``raster`` gives for their shapes, without a shuffle."""
    if not (body or hands or face):
        raise ValueError("nothing to draw")
    thick = _thick(h, w, wide)
    schema = T.StructType([*[frames.schema[k] for k in [*keys, "frame"]], *[T.StructField(c, T.IntegerType()) for c in ("y", "x", "r", "g", "b")]])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, _CELLS // (h * w))):
                some = batch.slice(at, step)
                own = np.repeat(np.arange(some.num_rows), pc.list_value_length(some["people"]).fill_null(0).to_numpy(zero_copy_only=False))
                with np.errstate(all="ignore"):
                    shape = _outlines(some["people"].flatten(), h, w, thick, body, hands, face)
                    canvas = np.full(some.num_rows * h * w, -1, np.int32)
                    if len(shape["who"]):
                        _paint(canvas, own[shape["who"]], shape, h, w)
                place = np.flatnonzero(canvas >= 0)
                colour = canvas[place]
                rest = [place % (h * w) // w, place % w, colour >> 16, colour >> 8 & 255, colour & 255]
                held = some.select([*keys, "frame"]).take(pa.array(place // (h * w)))
                yield pa.RecordBatch.from_arrays([*held.columns, *[pa.array(v.astype(np.int32)) for v in rest]], names=schema.names)

    return frames.select(*keys, "frame", "people").mapInArrow(run, schema)


def canvases(pixels: DataFrame, h: int, w: int, keys: list[str]) -> DataFrame:
    """(keys, data) of pictures in [0, 1] from covered pixels, black elsewhere; a group is one picture at most."""

    @F.pandas_udf("array<double>")
    def fill(some: pd.Series) -> pd.Series:
        out = []
        for covered in some:
            x = np.zeros((h * w, 3))
            table = np.array([[p["i"], p["r"], p["g"], p["b"]] for p in covered])
            x[table[:, 0]] = table[:, 1:] / 255
            out.append(x.ravel().tolist())
        return pd.Series(out)

    held = pixels.select(*keys, F.struct((F.col("y") * w + F.col("x")).alias("i"), "r", "g", "b").alias("p"))
    return held.groupBy(*keys).agg(F.collect_list("p").alias("p")).select(*keys, fill("p").alias("data"))
