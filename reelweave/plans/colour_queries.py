"""Queries of colour correction: three neighbouring frames are the channels of one picture."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelweave.operators import colour as C
from reelweave.plans._query import query
from reelweave.plans.media_queries import _DIST, _FRAMES, _show, frames

_RGB = f"""{_FRAMES}, c AS MATERIALIZED (SELECT seq_id, frame_idx, data AS r, lead(data) OVER w AS g, lead(data, 2) OVER w AS b FROM f WINDOW w AS (PARTITION BY seq_id ORDER BY frame_idx)),
px AS MATERIALIZED (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS y FROM (SELECT seq_id, frame_idx, i, r[i + 1] AS r, g[i + 1] AS g, b[i + 1] AS b FROM c, range(64) AS t(i) WHERE b IS NOT NULL)),
pair AS MATERIALIZED (SELECT p.*, q.r AS rr, q.g AS rg, q.b AS rb, q.y AS ry FROM px p JOIN px q ON p.seq_id = q.seq_id AND p.i = q.i AND q.frame_idx = 0)"""
_CLIP = "greatest(0, least(1, {}))"


def _shown(*values: str, source: str = "o") -> str:
    """One row for each value of a pixel, in the order of the channels."""
    return " UNION ALL ".join(f"SELECT seq_id, frame_idx, CAST(3 * i + {k} AS INTEGER) AS i, round({v}, 6) AS v FROM {source}" for k, v in enumerate(values))


def coloured(spark, d):
    w = Window.partitionBy("seq_id").orderBy("frame_idx")
    f = frames(spark, d).select("seq_id", "frame_idx", F.col("data").alias("r"), F.lead("data").over(w).alias("g"), F.lead("data", 2).over(w).alias("b")).where("b IS NOT NULL")
    return f.select("seq_id", "frame_idx", F.flatten(F.transform(F.arrays_zip("r", "g", "b"), lambda p: F.array(p["r"], p["g"], p["b"]))).alias("data"))


def _to_first(spark, d, step: str, **settings):
    f = coloured(spark, d)
    first = f.where("frame_idx = 0").select("seq_id", F.col("data").alias("ref"))
    return _show(C.correct(f, f.join(first, "seq_id").select("seq_id", "frame_idx", "ref"), 8, 8, step, **settings))


_RATIO = "greatest(0.8, least(1.2, avg(r{0}) OVER w / (avg({0}) OVER w + 1e-8)))"


@query(f"WITH {_RGB}, o AS (SELECT *, {', '.join(_RATIO.format(k) + f' AS k{k}' for k in 'rgb')} FROM pair WINDOW w AS (PARTITION BY seq_id, frame_idx)) {_shown(*[_CLIP.format(f'{k} * (1 + 0.6 * (k{k} - 1))') for k in 'rgb'])}")
def colour_white_balance(spark, d):
    """Colour casts against each sequence's first picture."""
    return _to_first(spark, d, "white_balance", strength=0.6)


@query(f"""WITH {_RGB}, o AS (SELECT *, b - y + 0.6 * (avg(rb - ry) OVER w - avg(b - y) OVER w) AS u, r - y + 0.6 * (avg(rr - ry) OVER w - avg(r - y) OVER w) AS v FROM pair WINDOW w AS (PARTITION BY seq_id, frame_idx))
{_shown(_CLIP.format('y + v'), _CLIP.format('y - 0.299 * v / 0.587 - 0.114 * u / 0.587'), _CLIP.format('y + u'))}""")
def colour_chroma_shift(spark, d):
    """Colour differences moved to those of each sequence's first picture."""
    return _to_first(spark, d, "chroma", strength=0.6)


_ZONE = "CASE WHEN y < 0.3 THEN 0 WHEN y < 0.7 THEN 1 ELSE 2 END"
_REFS = ", ".join(f"avg(r{k}) FILTER (WHERE {c}) AS {k}{z}" for z, c in enumerate(("ry < 0.4", "ry >= 0.25 AND ry < 0.75", "ry >= 0.6")) for k in "rgb")
_MOVED = "CASE WHEN {0}z IS NULL THEN {0} ELSE greatest(0, least(1, {0} + 0.6 * ({0}z - m{0}))) END"


@query(f"""WITH {_RGB}, z AS (SELECT *, {_ZONE} AS z FROM pair), ref AS (SELECT seq_id, frame_idx, {_REFS} FROM pair GROUP BY 1, 2),
o AS (SELECT z.*, {', '.join(f'avg({k}) OVER w AS m{k}, CASE z WHEN 0 THEN {k}0 WHEN 1 THEN {k}1 ELSE {k}2 END AS {k}z' for k in 'rgb')} FROM z JOIN ref USING (seq_id, frame_idx) WINDOW w AS (PARTITION BY seq_id, frame_idx, z))
{_shown(*[_MOVED.format(k) for k in 'rgb'])}""")
def colour_zone_shift(spark, d):
    """Shadows, middle tones and highlights moved to those of each sequence's first picture."""
    return _to_first(spark, d, "zones", strength=0.6)


_AREAS = ", ".join(
    f"round(count(*) FILTER (WHERE {c}) / count(*), 9) AS {n}_area, round(coalesce(avg(y) FILTER (WHERE {c}), 0.5), 9) AS {n}_level, "
    + ", ".join(f"round(coalesce(avg({k}) FILTER (WHERE {c}), 0.5), 9) AS {n}_{k}" for k in "rgb")
    + f", round(coalesce(avg((greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + 1e-8)) FILTER (WHERE {c}), 0), 9) AS {n}_saturation"
    for n, c in (("shadow", "y < 0.3"), ("highlight", "y > 0.7"))
)


@query(f"WITH {_RGB} SELECT seq_id, frame_idx, round(quantile_cont(y, 0.9) - quantile_cont(y, 0.1), 9) AS contrast, {_AREAS} FROM px GROUP BY 1, 2")
def zone_signature(spark, d):
    """Area, mean colour and saturation of each picture's shadows and highlights."""
    s = C.zone_signature(coloured(spark, d))
    return s.select("seq_id", "frame_idx", *[F.round(c, 9).alias(c) for c in s.columns[2:]])


def _near(r: int, name: str) -> str:
    """(i, near): the places of the window around each place of an 8 x 8 picture, reflected at its edges."""
    at = lambda v: f"(CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > 7 THEN 14 - ({v}) ELSE {v} END)"
    return f"{name} AS MATERIALIZED (SELECT i, list({at('i // 8 + dy')} * 8 + {at('i % 8 + dx')} + 1) AS near FROM range(64) AS a(i), range({-r}, {r + 1}) AS b(dy), range({-r}, {r + 1}) AS c(dx) GROUP BY 1)"


def _mean(values: str, near: str) -> str:
    return f"list_avg(list_transform({near}.near, lambda j: {values}[j]))"


@query(f"WITH {_FRAMES}, {_near(3, 'a')}, {_near(5, 'b')} SELECT seq_id, frame_idx, CAST(a.i AS INTEGER) AS i, round({_mean('data', 'a')}, 9) AS m7, round({_mean('data', 'b')}, 9) AS m11 FROM f, a JOIN b USING (i)")
def window_means(spark, d):
    """Means over 7 x 7 and 11 x 11 windows around each pixel."""
    f = C.with_window_mean(C.with_window_mean(frames(spark, d), 8, 8, 3, "m7"), 8, 8, 5, "m11")
    got = f.select("seq_id", "frame_idx", F.posexplode(F.arrays_zip("m7", "m11")).alias("i", "m"))
    return got.select("seq_id", "frame_idx", "i", F.round("m.m7", 9).alias("m7"), F.round("m.m11", 9).alias("m11"))


def _zone_sql(name: str, n: int, low: float, high: float, mix: float, strength: float = 0.8) -> str:
    """Change of each channel in a zone: name its weight, n the window."""
    core = f"{name} > 0.1 AND m{n} > 1e-6"
    factor = f"greatest({low}, least({high}, q{n} / (m{n} + 1e-8)))"
    return ", ".join(f"CASE WHEN {core} THEN {name} * {strength} * ({mix} * {k} * ({factor} - 1) + {1 - mix} * (sum(r{k} - {k}) FILTER (WHERE {name} > 0.1) OVER w / (count(*) FILTER (WHERE {name} > 0.1) OVER w))) ELSE 0 END AS {name}_{k}" for k in "rgb")


def _smooth_sql(source: str, name: str, strength: float) -> str:
    """Lists of the channels after smoothing in a zone: each place mixed with the mean around it."""
    held = f"{name}l AS MATERIALIZED (SELECT seq_id, frame_idx, {', '.join(f'list({k} ORDER BY i) AS l{k}' for k in 'rgb')} FROM {source} GROUP BY 1, 2)"
    mixed = ", ".join(f"(1 - {name} * calm * {strength}) * {k} + {name} * calm * {strength} * {_mean('l' + k, 'n3')} AS {k}" for k in "rgb")
    return f"{held}, {name}s AS MATERIALIZED (SELECT s.seq_id, s.frame_idx, s.i, low, high, calm, {mixed} FROM {source} s JOIN {name}l USING (seq_id, frame_idx) JOIN n3 USING (i))"


_CONTRAST = f"""WITH {_RGB},
s AS MATERIALIZED (SELECT seq_id, frame_idx, avg(y) AS mean, stddev_samp(y) AS std, [{", ".join(f"quantile_cont(y, {q})" for q in (0.1, 0.25, 0.5, 0.75, 0.9))}] AS pct,
 [{", ".join(f"count(*) FILTER (WHERE y BETWEEN 0 AND 1 AND least(floor(y * 16), 15) = {k}) / (count(*) FILTER (WHERE y BETWEEN 0 AND 1) + 1e-8)" for k in range(16))}] AS hist FROM px GROUP BY 1, 2),
near AS (SELECT a.seq_id, a.frame_idx, arg_min(b.frame_idx, ({_DIST}, b.frame_idx)) AS ref_idx FROM s a JOIN s b ON a.seq_id = b.seq_id AND a.frame_idx >= 5 AND b.frame_idx < 5 GROUP BY 1, 2),
{_near(1, 'n3')}, {_near(3, 'n7')}, {_near(5, 'n11')},
t AS (SELECT p.*, q.r AS rr, q.g AS rg, q.b AS rb, q.y AS ry, greatest(0, least(1, (0.4 - p.y) / 0.4)) AS low, greatest(0, least(1, (p.y - 0.6) / 0.4)) AS high
 FROM near JOIN px p USING (seq_id, frame_idx) JOIN px q ON q.seq_id = p.seq_id AND q.frame_idx = near.ref_idx AND q.i = p.i),
l AS MATERIALIZED (SELECT seq_id, frame_idx, list(y ORDER BY i) AS l, list(ry ORDER BY i) AS rl FROM t GROUP BY 1, 2),
m AS MATERIALIZED (SELECT t.*, {_mean('l', 'n7')} AS m7, {_mean('rl', 'n7')} AS q7, {_mean('l', 'n11')} AS m11, {_mean('rl', 'n11')} AS q11, exp(-abs(9 * (y - {_mean('l', 'n3')})) / 0.1) AS calm
 FROM t JOIN l USING (seq_id, frame_idx) JOIN n3 USING (i) JOIN n7 USING (i) JOIN n11 USING (i)),
z AS (SELECT *, {_zone_sql('low', 7, 0.85, 1.4, 0.4)}, {_zone_sql('high', 11, 0.6, 1.15, 0.6)} FROM m WINDOW w AS (PARTITION BY seq_id, frame_idx)),
x AS MATERIALIZED (SELECT seq_id, frame_idx, i, low, high, calm, {', '.join(f'{k} + low_{k} + high_{k} AS {k}' for k in 'rgb')} FROM z),
{_smooth_sql('x', 'low', 0.3)}, {_smooth_sql('lows', 'high', 0.2)},
o AS (SELECT seq_id, frame_idx, i, r, g, b FROM px WHERE frame_idx < 5 UNION ALL SELECT seq_id, frame_idx, i, {', '.join(_CLIP.format(k) for k in 'rgb')} FROM highs)
{_shown('r', 'g', 'b')}"""


@query(_CONTRAST)
def first_frames_contrast(spark, d):
    """Shadows and highlights brought to the nearest of each sequence's first five pictures."""
    return _show(C.first_frames(coloured(spark, d), 5, 8, 8, method=None, contrast=True))


@query()
def first_frames_matched(spark, d):
    """Pictures matched in colour and contrast to the nearest of each sequence's first five."""
    return _show(C.first_frames(coloured(spark, d), 5, 8, 8, "mkl", 0.8, contrast=True))


@query()
def recoloured_frames(spark, d):
    """Pictures corrected in steps against the mean of the corrected ones before them, less where scenes change."""
    return _show(C.recoloured(coloured(spark, d), 8, 8, strength=0.9, smoothing=0.1))
