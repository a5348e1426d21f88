"""Pose files and their pixels against a plain painter."""

import colorsys
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelweave.operators import geometry as G
from reelweave.operators import pose as P
from reelweave.plans import pose_queries

H, W = 40, 56


def person(seed, n_face=6, hole=5):
    rng = np.random.default_rng(seed)
    part = lambda n: [v for k in range(n) for v in (*rng.uniform(-0.1, 1.1, 2).tolist(), 0.5 if k % hole == 2 else 1.0)]
    return {"pose_keypoints_2d": part(18), "hand_left_keypoints_2d": part(21), "hand_right_keypoints_2d": [] if seed % 2 else part(21), "face_keypoints_2d": part(n_face)}


def painted(people):
    canvas = np.full((H, W, 3), -1)

    def paint(colour, inside):
        for y in range(H):
            for x in range(W):
                if inside(x, y):
                    canvas[y, x] = colour

    def dot(p, r, colour):
        cx, cy = int(p[0] * W), int(p[1] * H)
        paint(colour, lambda x, y: (x - cx) ** 2 + (y - cy) ** 2 <= r * r)

    def line(p, q, colour):
        (ax, ay), (bx, by) = ((int(v[0] * W), int(v[1] * H)) for v in (p, q))

        def near(x, y):
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(max(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n, 0), 1) if n else 0
            return (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2 <= 1 + 1e-9

        paint(colour, near)

    for who in people:
        part = {k: [tuple(v[i : i + 2]) if v[i + 2] >= 1 else None for i in range(0, len(v), 3)] for k, v in who.items()}
        body = part["pose_keypoints_2d"]
        for (a, b), colour in zip(G.LIMBS, P.COLOURS, strict=False):
            if (p := body[a - 1]) and (q := body[b - 1]):
                cx, cy, dx, dy = int((p[0] + q[0]) * W / 2), int((p[1] + q[1]) * H / 2), (p[0] - q[0]) * W, (p[1] - q[1]) * H
                major, t = max(int(math.hypot(dx, dy) / 2), 0.5), math.radians(int(math.degrees(math.atan2(dy, dx))))
                paint([int(c * 0.6) for c in colour], lambda x, y: (((x - cx) * math.cos(t) + (y - cy) * math.sin(t)) / major) ** 2 + (((y - cy) * math.cos(t) - (x - cx) * math.sin(t)) / 4) ** 2 <= 1 + 1e-9)
        for p, colour in zip(body, P.COLOURS, strict=True):
            if p:
                dot(p, 4, colour)
        for hand in (part["hand_left_keypoints_2d"], part["hand_right_keypoints_2d"]):
            for i, (a, b) in enumerate([(a, b) for f in range(5) for a, b in zip([0, *range(4 * f + 1, 4 * f + 4)], range(4 * f + 1, 4 * f + 5), strict=True)] if hand else []):
                tone = colorsys.hsv_to_rgb(i / 20, 1, 1)
                if hand[a] and hand[b]:
                    line(hand[a], hand[b], [round(255 * v) for v in tone])
            for p in hand:
                if p:
                    dot(p, 4, (0, 0, 255))
        for p in part["face_keypoints_2d"]:
            if p:
                dot(p, 3, (255, 255, 255))
    return canvas


@pytest.fixture(scope="module")
def poses(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("poses")
    frame = lambda *people: {"canvas_height": H, "canvas_width": W, "people": list(people)}
    held = {"a.json": [frame(person(1), person(2)), frame(), frame(person(3))], "b.json": frame(person(4)), "empty.json": []}
    for name, content in held.items():
        (folder / name).write_text(json.dumps(content, indent=1))
    (folder / "bad.json").write_text('[{"canvas_height": ')
    (folder / "other.json").write_text('[{"k": 1}]')
    return P.load_poses(spark, f"file://{folder}").withColumn("name", F.regexp_extract("file", "([^/]*).json", 1)), held


def test_pose_files(poses):
    df, _ = poses
    got = {r.name: (r.poses is None, r.error) for r in df.collect()}
    assert {k for k, v in got.items() if v[1]} == {"bad", "other"} and all(v[0] == bool(v[1]) for v in got.values())
    assert P.keypoints(df, "poses", ["name"]).where("name = 'b' AND part = 'face'").count() == 6


def test_raster_like_a_painter(poses):
    df, held = poses
    points = P.keypoints(df, "poses", ["name"])
    got = {}
    for r in P.raster(P.shapes(points, H, W, ["name"]), H, W, ["name"]).collect():
        got.setdefault((r.name, r.frame), np.full((H, W, 3), -1))[r.y, r.x] = (r.r, r.g, r.b)
    assert set(got) == {("a", 0), ("a", 2), ("b", 0)}
    assert np.array_equal(got["a", 0], painted(held["a.json"][0]["people"]))
    assert np.array_equal(got["a", 2], painted(held["a.json"][2]["people"]))
    apart = P.raster(P.shapes(points, H, W, ["name"]), H, W, ["name"], separate=True)
    px = P.canvases(apart.where("name = 'a' AND frame = 0"), H, W, ["person"]).collect()
    for r in px:
        want = np.maximum(painted([held["a.json"][0]["people"][r.person]]), 0) / 255
        assert np.allclose(np.reshape(r.data, (H, W, 3)), want)
    assert len(px) == 2


def test_parts_of_a_pose(poses):
    df, held = poses
    points = P.keypoints(df, "poses", ["name"]).where("name = 'b'")
    face = P.raster(P.shapes(points, H, W, ["name"], body=False, hands=False), H, W, ["name"]).collect()
    want = painted([{k: v if k.startswith("face") else [0.0] * len(v) for k, v in held["b.json"]["people"][0].items()}])
    assert len(face) == (want[..., 0] >= 0).sum() and {(r.r, r.g, r.b) for r in face} == {(255, 255, 255)}
    assert P.raster(P.shapes(points.limit(0), H, W, ["name"]), H, W, ["name"]).count() == 0
    thick = P.shapes(points, 1200, 900, ["name"], wide=True).where("kind = 'ellipse' AND z < 100").select("b").distinct().collect()
    assert [r.b for r in thick] == [12.0]
    with pytest.raises(ValueError):
        P.shapes(points, H, W, ["name"], body=False, hands=False, face=False)


@pytest.mark.parametrize("cells, laid", [(P._CELLS, P._LAID), (1, 1), (3 * H * W, 500)])
def test_drawn_like_a_painter(poses, monkeypatch, cells, laid):
    df, held = poses
    run = P.drawn

    def bounded(*a, **k):
        monkeypatch.setattr(P, "_CELLS", cells)
        monkeypatch.setattr(P, "_LAID", laid)
        return run(*a, **k)

    got = {}
    for r in local(bounded, P.pose_frames(df, ["name"]), H, W, ["name"]):
        got.setdefault((r["name"], r["frame"]), np.full((H, W, 3), -1))[r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    assert set(got) == {("a", 0), ("a", 2), ("b", 0)}
    assert np.array_equal(got["a", 0], painted(held["a.json"][0]["people"]))
    assert np.array_equal(got["a", 2], painted(held["a.json"][2]["people"]))
    assert np.array_equal(got["b", 0], painted(held["b.json"]["people"]))


def local(draw, frames, *rest, **more):
    """Rows of ``drawn`` without workers, so that its bounds can be set."""

    class Here:
        schema = frames.schema
        select = lambda self, *_: self
        mapInArrow = lambda self, run, schema: [r for b in run(frames.toArrow().to_batches()) for r in b.to_pylist()]

    return draw(Here(), *rest, **more)


def test_drawn_like_shapes_as_rows(spark, tmp_path):
    """Odd people: parts that are absent, cut short, null or far off the canvas, on narrow, small and large canvases."""
    rng = np.random.default_rng(5)
    part = lambda n, low, high: [None if rng.random() < 0.05 else float(v) for k in range(n) for v in (*rng.uniform(low, high, 2), rng.choice([0.5, 1.0, 2.0]))]
    who = lambda low, high: {"pose_keypoints_2d": part(20, low, high), "hand_left_keypoints_2d": part(9, low, high)[:-1], "hand_right_keypoints_2d": part(21, low, high), "face_keypoints_2d": part(3, low, high)}
    people = [[who(0, 1) for _ in range(3)], [who(-2, 3)], [{}], [{"face_keypoints_2d": [0.5, 0.5, 1.0], "pose_keypoints_2d": None}], [], [who(0.4, 0.6), {}, who(-50, 50)], [{"pose_keypoints_2d": [0.0, 0.0, 1.0] * 9 + [1.0, 1.0, 1.0] * 9}]]
    (tmp_path / "odd.json").write_text(json.dumps([{"canvas_height": 1, "canvas_width": 1, "people": p} for p in people]))
    df = P.load_poses(spark, f"file://{tmp_path}")
    frames, points = P.pose_frames(df, ["file"]), P.keypoints(df, "poses", ["file"])
    for h, w, more in [(24, 32, {}), (1, 70, {}), (70, 1, {"body": False}), (13, 13, {"hands": False}), (600, 520, {"wide": True, "face": False})]:
        rows = lambda d: sorted(tuple(r) for r in d.collect())
        want = rows(P.raster(P.shapes(points, h, w, ["file"], **more), h, w, ["file"]))
        assert rows(P.drawn(frames, h, w, ["file"], **more)) == want and want
    with pytest.raises(ValueError):
        P.drawn(frames, H, W, ["file"], body=False, hands=False, face=False)


def test_raster_query_shuffles_no_pixels(spark, data):
    """A file is parsed once and its frames are painted where they are read."""
    plan = pose_queries.pose_raster(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Aggregate|Join|Sort", plan)
    assert plan.count("from_json(") == 1
