"""Queries of poses: each frame's values are the points of two people, stored as JSON files and drawn."""

from __future__ import annotations

import colorsys

from pyspark.sql import functions as F

from reelweave.operators import geometry as G
from reelweave.operators import pose as P
from reelweave.plans._query import query
from reelweave.plans.media_queries import _FRAMES, frames
from reelweave.sources.shared import fresh

_H, _W, _CHUNK = 24, 32, 50
_PARTS = {"pose": (18, 2, 0), "hand_left": (21, 3, 0), "hand_right": (21, 3, 30), "face": (5, 7, 3)}


def pose_files(spark, d):
    """JSON files of up to 50 pose frames; every seventh point is scored too low to be seen."""

    def points(at, part):
        n, step, shift = _PARTS[part]
        one = lambda k: (at((k * step + shift) % 64), at((k * step + shift + 1) % 64), F.lit(0.5 if k % 7 == 6 else 1.0))
        return F.array(*[v for k in range(n) for v in one(k)]).alias(f"{part}_keypoints_2d")

    person = lambda at: F.struct(*[points(at, p) for p in _PARTS])
    people = lambda data: F.array(person(lambda k: F.get(data, F.lit(k))), person(lambda k: F.get(data, F.size(data) - 1 - k)))
    frame = lambda x: F.struct(F.lit(_H).alias("canvas_height"), F.lit(_W).alias("canvas_width"), people(x["data"]).alias("people"))
    # frames are grouped and sorted before their points are made, as these take ten times the room
    chunk = F.floor(F.col("frame_idx") / _CHUNK).cast("int")
    # 32 folders in a folder: Spark starts no task to list so few
    keys = {"seq_id": F.col("seq_id"), "block": F.floor(chunk / 32), "chunk": chunk}
    f = frames(spark, d).select(*[c.alias(n) for n, c in keys.items()], F.struct("frame_idx", "data").alias("x"))
    chunks = f.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x")).sortWithinPartitions(*keys)
    where = fresh(spark, "poses")
    chunks.select(*keys, F.to_json(F.transform("x", frame)).alias("value")).write.partitionBy(*keys).text(where)
    return where


def _points_sql() -> str:
    """(seq_id, frame, person, part, k, x, y): the points that are seen."""
    one = " UNION ALL ".join(f"SELECT seq_id, frame, person, '{part}' AS part, k, d[(k * {s} + {t}) % 64 + 1] AS x, d[(k * {s} + {t} + 1) % 64 + 1] AS y FROM p, range({n}) AS r(k) WHERE k % 7 <> 6" for part, (n, s, t) in _PARTS.items())
    return f"""p AS (SELECT seq_id, frame_idx AS frame, 0 AS person, data AS d FROM f UNION ALL SELECT seq_id, frame_idx, 1, list_reverse(data) FROM f), pts AS MATERIALIZED ({one})"""


_LIMBS = ", ".join(f"({i}, {a - 1}, {b - 1}, {', '.join(str(int(v * 0.6)) for v in P.COLOURS[i])})" for i, (a, b) in enumerate(G.LIMBS))
_DOTS = ", ".join(f"({k}, {c[0]}, {c[1]}, {c[2]})" for k, c in enumerate(P.COLOURS))
_LINES = ", ".join(f"({i}, {a}, {b}, {', '.join(str(round(255 * v)) for v in colorsys.hsv_to_rgb(i / 20, 1, 1))})" for i, (a, b) in enumerate(P.FINGERS))
_AT = "CAST(trunc({0} * {1}) AS INTEGER)"
_DOT = f"{_AT.format('x', _W)} AS cx, {_AT.format('y', _H)} AS cy, {{r}}.0 AS a, {{r}}.0 AS b, 0.0 AS t, NULL AS x2, NULL AS y2"


@query(f"""WITH {_FRAMES}, {_points_sql()}, limbs(i, a, b, red, green, blue) AS (VALUES {_LIMBS}), dots(i, red, green, blue) AS (VALUES {_DOTS}), lines(i, a, b, red, green, blue) AS (VALUES {_LINES}),
s AS MATERIALIZED (
 SELECT p.seq_id, p.frame, p.person, i AS z, CAST(trunc((p.x * {_W} + q.x * {_W}) / 2) AS INTEGER) AS cx, CAST(trunc((p.y * {_H} + q.y * {_H}) / 2) AS INTEGER) AS cy,
  greatest(trunc(sqrt(pow(p.x * {_W} - q.x * {_W}, 2) + pow(p.y * {_H} - q.y * {_H}, 2)) / 2), 0.5) AS a, 4.0 AS b, radians(trunc(degrees(atan2(p.y * {_H} - q.y * {_H}, p.x * {_W} - q.x * {_W})))) AS t, NULL AS x2, NULL AS y2, red, green, blue
  FROM limbs l JOIN pts p ON p.part = 'pose' AND p.k = l.a JOIN pts q ON q.part = 'pose' AND q.k = l.b AND q.seq_id = p.seq_id AND q.frame = p.frame AND q.person = p.person
 UNION ALL SELECT seq_id, frame, person, 100 + k, {_DOT.format(r=4)}, red, green, blue FROM pts JOIN dots ON k = i WHERE part = 'pose'
 UNION ALL SELECT seq_id, frame, person, CASE part WHEN 'hand_left' THEN 250 ELSE 350 END + k, {_DOT.format(r=4)}, 0, 0, 255 FROM pts WHERE part LIKE 'hand%'
 UNION ALL SELECT seq_id, frame, person, 400 + k, {_DOT.format(r=3)}, 255, 255, 255 FROM pts WHERE part = 'face'
 UNION ALL SELECT p.seq_id, p.frame, p.person, CASE p.part WHEN 'hand_left' THEN 200 ELSE 300 END + i, {_AT.format('p.x', _W)}, {_AT.format('p.y', _H)}, NULL, NULL, NULL, {_AT.format('q.x', _W)}, {_AT.format('q.y', _H)}, red, green, blue
  FROM lines l JOIN pts p ON p.part LIKE 'hand%' AND p.k = l.a JOIN pts q ON q.part = p.part AND q.k = l.b AND q.seq_id = p.seq_id AND q.frame = p.frame AND q.person = p.person),
c AS (SELECT *, unnest(range({_W})) AS x FROM (SELECT *, unnest(range({_H})) AS y FROM s)),
g AS (SELECT *, least(1, greatest(0, ((x - cx) * (x2 - cx) + (y - cy) * (y2 - cy)) / greatest(pow(x2 - cx, 2) + pow(y2 - cy, 2), 1e-9))) AS share FROM c),
h AS (SELECT * FROM g WHERE CASE WHEN x2 IS NULL THEN pow(((x - cx) * cos(t) + (y - cy) * sin(t)) / a, 2) + pow(((y - cy) * cos(t) - (x - cx) * sin(t)) / b, 2) <= 1 + 1e-9
 ELSE pow(x - cx - share * (x2 - cx), 2) + pow(y - cy - share * (y2 - cy), 2) <= 1 + 1e-9 END)
SELECT seq_id, frame AS frame, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, arg_max(red, (person, z)) AS r, arg_max(green, (person, z)) AS g, arg_max(blue, (person, z)) AS b FROM h GROUP BY 1, 2, 3, 4""")
def pose_raster(spark, d):
    """Every pose of the JSON files drawn: the covered pixels with their colours."""
    keys = ["seq_id", "chunk"]
    px = P.drawn(P.pose_frames(P.load_poses(spark, pose_files(spark, d)), keys), _H, _W, keys)
    return px.select(F.col("seq_id").cast("long").alias("seq_id"), (F.col("chunk") * _CHUNK + F.col("frame")).cast("long").alias("frame"), "y", "x", "r", "g", "b")


@query(f"""WITH {_FRAMES}, {_points_sql()}, limbs(limb, a, b) AS (VALUES {", ".join(f"({i}, {a - 1}, {b - 1})" for i, (a, b) in enumerate(G.LIMBS))})
SELECT p.seq_id, p.frame, CAST(p.person AS INTEGER) AS person, limb, round(p.x, 9) AS x1, round(p.y, 9) AS y1, round(q.x, 9) AS x2, round(q.y, 9) AS y2
FROM limbs l JOIN pts p ON p.part = 'pose' AND p.k = l.a JOIN pts q ON q.part = 'pose' AND q.k = l.b AND q.seq_id = p.seq_id AND q.frame = p.frame AND q.person = p.person""")
def pose_limbs(spark, d):
    """The limbs of all people in the pose files, both ends seen."""
    poses = P.load_poses(spark, pose_files(spark, d)).where("error IS NULL")
    points = P.keypoints(poses, "poses", ["seq_id", "chunk"]).withColumn("frame", (F.col("chunk") * _CHUNK + F.col("frame")).cast("long"))
    at = F.map_from_entries(F.collect_list(F.struct("k", F.struct("x", "y"))))
    people = points.where("part = 'pose' AND x IS NOT NULL").groupBy(F.col("seq_id").cast("long").alias("seq_id"), "frame", "person").agg(at.alias("at"))
    limb = lambda i, a, b: F.struct(F.lit(i).alias("limb"), F.element_at("at", F.lit(a - 1)).alias("p"), F.element_at("at", F.lit(b - 1)).alias("q"))
    each = people.select("seq_id", "frame", "person", F.explode(F.array(*[limb(i, a, b) for i, (a, b) in enumerate(G.LIMBS)])).alias("l")).where("l.p IS NOT NULL AND l.q IS NOT NULL")
    return each.select("seq_id", "frame", "person", "l.limb", *[F.round(f"l.{e}.{c}", 9).alias(f"{c}{n}") for n, e in ((1, "p"), (2, "q")) for c in "xy"])
