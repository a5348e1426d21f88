"""Queries of resampling, batch functions, tiles and carried memories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reelweave.operators import resample as R
from reelweave.operators import transform as T
from reelweave.plans._query import query
from reelweave.plans.media_queries import _FRAMES, _pixels, _show, frames
from reelweave.streaming import tiles as S


def _passes(n: int, m: int, weights: str, between: str, places: str, start: str = "data[i + 1]") -> str:
    """SQL of two passes over 8 x 8 frames: weights of (o, i, d), places a condition on them, between what a pass ends with."""
    return f"""WITH {_FRAMES}, w AS (SELECT o, least(greatest(i, 0), {n - 1}) AS i, {weights} AS w FROM (SELECT o, i, (o + 0.5) * ({n} / {m}::DOUBLE) AS c FROM range({m}) AS a(o), range(-4, {n + 4}) AS b(i)) WHERE {places}),
t AS (SELECT o, i, sum(w) / sum(sum(w)) OVER (PARTITION BY o) AS w FROM w GROUP BY 1, 2),
p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, {start} AS v FROM f, range(64) AS r(i)),
q AS (SELECT vec_id, y, o AS x, {between.format('sum(v * w)')} AS v FROM p JOIN t ON p.x = t.i GROUP BY 1, 2, 3),
z AS (SELECT vec_id, o AS y, x, {between.format('sum(v * w)')} AS v FROM q JOIN t ON q.y = t.i GROUP BY 1, 2, 3)"""


_NEAR, _FAR = "1.25 * pow(abs(d), 3) - 2.25 * pow(d, 2) + 1", "-0.75 * (pow(abs(d), 3) - 5 * pow(d, 2) + 8 * abs(d) - 4)"
_D = "(c - 0.5 - i)"


@query(f"{_passes(8, 13, f'CASE WHEN abs{_D} <= 1 THEN {_NEAR} ELSE {_FAR} END'.replace('abs(d)', f'abs{_D}').replace('pow(d, 2)', f'pow({_D}, 2)'), '{}', f'i - floor(c - 0.5) BETWEEN -1 AND 2')} SELECT vec_id, CAST(y * 13 + x AS INTEGER) AS i, round(v, 6) AS v FROM z")
def scale_bicubic(spark, d):
    """Frames scaled to 13 x 13 by bicubic weights."""
    return _pixels(frames(spark, d), R.resample(F.col("data"), 8, 8, 13, 13, "bicubic"))


_X = "((i - c + 0.5) / 1.6)"
_LANCZOS = f"CASE WHEN {_X} = 0 THEN 1 WHEN abs{_X} < 3 THEN sin(pi() * {_X}) / (pi() * {_X}) * sin(pi() * {_X} / 3) / (pi() * {_X} / 3) ELSE 0 END"


@query(f"{_passes(8, 5, _LANCZOS, 'floor(greatest(0, least(255, {} + 0.5)))', 'i BETWEEN 0 AND 7 AND i >= greatest(trunc(c - 4.8 + 0.5), 0) AND i < least(trunc(c + 4.8 + 0.5), 8)', 'floor(least(greatest(data[i + 1] * 255, 0), 255))')} SELECT vec_id, CAST(y * 5 + x AS INTEGER) AS i, round(v / 255, 6) AS v FROM z")
def scale_lanczos(spark, d):
    """Frames shrunk to 5 x 5 by Lanczos weights, in 255 levels."""
    return _pixels(frames(spark, d), R.resample(F.col("data"), 8, 8, 5, 5, "lanczos"))


@query(f"""WITH {_FRAMES}, m AS (SELECT *, CASE WHEN list_avg(data) < 0.49 THEN 0 WHEN list_avg(data) > 0.51 THEN 2 ELSE 1 END AS times FROM f),
n AS (SELECT *, sum(times) OVER (PARTITION BY seq_id ORDER BY frame_idx) - times AS start FROM m)
SELECT seq_id, CAST(start + k AS BIGINT) AS frame_idx, CAST(i AS INTEGER) AS i, round(data[i + 1], 6) AS v FROM n, range(2) AS a(k), range(64) AS b(i) WHERE k < times""")
def frames_dropped_and_doubled(spark, d):
    """Dark frames dropped and bright ones doubled in batches of 16, numbered anew without gaps."""

    def fn(x: np.ndarray) -> np.ndarray:
        m = x.mean(1)
        return np.repeat(x, np.where(m < 0.49, 0, np.where(m > 0.51, 2, 1)), axis=0)

    return _show(T.transform(frames(spark, d), fn, 16))


def _upscaled(spark, d):
    """Each pixel four times; tiles with bright pixels must be smaller ones."""

    def fn(x: np.ndarray) -> np.ndarray:
        if x.size > 4 and x.max() > 0.75 or x.size > 36 and x.max() > 0.7:
            raise MemoryError
        return x.repeat(2, 0).repeat(2, 1)

    return T.upscale_tiled(frames(spark, d).select("vec_id", "data"), ["vec_id"], fn, 8, 8, tile=8, overlap=2, least=2)


@query(f"WITH {_FRAMES} SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(data[(y // 2) * 8 + x // 2 + 1], 6) AS v FROM f, range(16) AS a(y), range(16) AS b(x)")
def upscaled_pixels(spark, d):
    """Frames doubled in size tile by tile, tiles halved where they are too large, merged."""
    return _upscaled(spark, d)[0].select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query(f"""WITH {_FRAMES}, s AS (SELECT * FROM (VALUES (8, 0, 8), (4, 0, 4), (4, 2, 6), (4, 4, 8), (2, 0, 2), (2, 1, 3), (2, 2, 4), (2, 3, 5), (2, 4, 6), (2, 5, 7), (2, 6, 8)) AS v(tile, a, b)),
t AS (SELECT p.tile, p.a AS y0, p.b AS y1, q.a AS x0, q.b AS x1 FROM s p JOIN s q USING (tile)),
k AS (SELECT vec_id, CASE WHEN list_max(data) > 0.75 THEN 2 WHEN list_max(data) > 0.7 THEN 4 ELSE 8 END AS tile FROM f)
SELECT vec_id, y0, y1, x0, x1, tile FROM k JOIN t USING (tile)""")
def upscale_tiles(spark, d):
    """The tiles that each frame was upscaled with."""
    return _upscaled(spark, d)[1]


def _fading(x: np.ndarray, memory: np.ndarray | None):
    y = x if memory is None else 0.7 * x + 0.3 * memory
    return y, y


@query(f"""WITH RECURSIVE {_FRAMES}, r AS (SELECT seq_id, frame_idx, data AS y FROM f WHERE frame_idx = 0 UNION ALL
 SELECT f.seq_id, f.frame_idx, list_transform(range(1, 65), lambda i: 0.7 * f.data[i] + 0.3 * r.y[i]) FROM r JOIN f ON f.seq_id = r.seq_id AND f.frame_idx = r.frame_idx + 1)
SELECT seq_id, frame_idx, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, round(y[i + 1], 6) AS v FROM r, range(64) AS t(i)""")
def carried_tiles(spark, d):
    """Overlapping tiles of each sequence with a fading memory, carried from frame to frame and merged."""
    tiles = S.carried(S.cut(frames(spark, d), 8, 8, 5, 3), _fading)
    return S.merge(tiles, 8, 8, 5, 3).withColumn("v", F.round("v", 6))
