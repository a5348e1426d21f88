"""Colour correction against plain loops over pixels."""

import time

import numpy as np
import pytest

from reelweave.operators import colour as C
from reelweave.operators import stats


def pictures(n, seed, h=6, w=7, low=0.0, high=1.0):
    return np.random.default_rng(seed).uniform(low, high, (n, h, w, 3))


def luma(p):
    return 0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]


def clip(v):
    return min(max(v, 0.0), 1.0)


def pixels(x):
    return [tuple(p) for p in x.reshape(-1, 3).tolist()]


def mean(values):
    values = list(values)
    return sum(values) / len(values)


def plain_balance(x, ref, s):
    k = [min(max(mean(p[c] for p in pixels(ref)) / (mean(p[c] for p in pixels(x)) + 1e-8), 0.8), 1.2) for c in range(3)]
    return np.reshape([[clip(p[c] * (1 + s * (k[c] - 1))) for c in range(3)] for p in pixels(x)], x.shape)


def plain_chroma(x, ref, s):
    du, dv = (s * (mean(p[c] - luma(p) for p in pixels(ref)) - mean(p[c] - luma(p) for p in pixels(x))) for c in (2, 0))
    out = []
    for p in pixels(x):
        y = luma(p)
        u, v = p[2] - y + du, p[0] - y + dv
        out.append([clip(y + v), clip(y - 0.299 * v / 0.587 - 0.114 * u / 0.587), clip(y + u)])
    return np.reshape(out, x.shape)


def plain_zones(x, ref, s):
    out = [list(p) for p in pixels(x)]
    for here, there in ((lambda y: y < 0.3, lambda y: y < 0.4), (lambda y: 0.3 <= y < 0.7, lambda y: 0.25 <= y < 0.75), (lambda y: y >= 0.7, lambda y: y >= 0.6)):
        own, other = [p for p in pixels(x) if here(luma(p))], [p for p in pixels(ref) if there(luma(p))]
        if own and other:
            for k, p in enumerate(pixels(x)):
                if here(luma(p)):
                    out[k] = [clip(p[c] + s * (mean(q[c] for q in other) - mean(q[c] for q in own))) for c in range(3)]
    return np.reshape(out, x.shape)


def seen(x, ref):
    def bins(p):
        return np.histogram([luma(q) for q in pixels(p)], 32, (0, 1))[0] / (len(pixels(p)) + 1e-8)

    gap, spread = np.abs(bins(ref) - bins(x)), lambda p: np.std([luma(q) for q in pixels(p)], ddof=1)
    return gap[:10].sum(), gap[22:].sum(), spread(x), max(abs(mean(p[c] for p in pixels(x)) - mean(p[c] for p in pixels(ref))) for c in range(3))


def plain_advanced(x, ref, strength, required=0.1):
    plain = lambda p, s: stats.colour_match(p.reshape(-1, 3), ref.reshape(-1, 3), "reinhard", s).reshape(p.shape)
    dark, bright, contrast, cast = seen(x, ref)
    a, b, m = min(cast * 100, 1), min(contrast / 0.25, 1), min((dark + bright) * 3, 1)
    used = []
    if a + b + m <= required:
        if dark > 0.03 and bright > 0.03 and contrast > 0.18:
            return plain_zones(x, ref, strength * 0.7), ["only zones"]
        if contrast > 0.18:
            return plain_chroma(x, ref, strength), ["only chroma"]
        return (plain_balance(x, ref, strength), ["only balance"]) if cast > 0.01 else (plain(x, strength), ["only plain"])
    left, total = strength, a + b + m
    if a > 0.1 and left > 0.05 and (s := min(left * (a / total) * 0.8, strength * 0.4)) > 0.05:
        x, left = plain_balance(x, ref, s), left - s
        used.append("balance")
        dark, bright, contrast, _ = seen(x, ref)
        b, m = min(contrast / 0.25, 1), min((dark + bright) * 15, 1)
    if b > 0.1 and left > 0.05 and (s := min(left * (b / max(b + m, 0.1)) * 0.7, strength * 0.5)) > 0.05:
        x, left = plain_chroma(x, ref, s), left - s
        used.append("chroma")
    if m > 0.1 and left > 0.05 and (s := min(left * 0.8, strength * 0.4)) > 0.05:
        x, left = plain_zones(x, ref, s), left - s
        used.append("zones")
    if left > strength * 0.01:
        x = plain(x, left)
        used.append("plain")
    return x, used


def test_steps_like_loops():
    x, ref = pictures(4, 1), pictures(4, 2) * 0.8
    for f, g in ((C.white_balance, plain_balance), (C.chroma_shift, plain_chroma), (C.zone_shift, plain_zones)):
        for s in (0.0, 0.4, 1.0):
            assert np.allclose(f(x, ref, s), [g(a, b, s) for a, b in zip(x, ref, strict=True)])
        assert np.allclose(f(x, ref, np.linspace(0, 1, 4)), [g(a, b, s) for a, b, s in zip(x, ref, np.linspace(0, 1, 4), strict=True)])
    dark = np.full((1, 4, 4, 3), 0.1)
    assert (C.zone_shift(dark, np.full((1, 4, 4, 3), 0.9), 1.0) == dark).all()  # no dark pixel to move to


def test_advanced_like_loops():
    paths = set()
    for seed in range(12):
        for high, low, shift, required in ((1, 0, 1.0, 0.1), (0.7, 0.3, 0.9, 0.1), (0.55, 0.5, 0.97, 9.0), (1, 0, 1.0, 9.0), (0.52, 0.5, 1.0, 9.0), (0.5, 0.5, 1.0, 0.1)):
            ref = pictures(1, seed, low=low, high=high)[0]
            x = np.clip(pictures(1, seed + 50, low=low, high=high)[0] * shift, 0, 1) if seed % 2 else ref * shift
            want, used = plain_advanced(x, ref, 0.9, required)
            paths.update(used)
            assert np.allclose(C.advanced(x, ref, 0.9, "reinhard", required), want, atol=1e-9), (seed, used)
    assert paths >= {"balance", "chroma", "zones", "plain", "only chroma", "only balance", "only plain", "only zones"}
    x = pictures(1, 3)[0]
    assert C.advanced(x, x * 0.5, 0.0) is x


def test_window_means_of_any_radius():
    x = np.random.default_rng(7).random((2, 13, 17))
    for r in (0, 1, 3, 5, 12):
        p = np.pad(x, ((0, 0), (r, r), (r, r)), mode="reflect" if r else "edge")
        want = [[[p[n, a : a + 2 * r + 1, b : b + 2 * r + 1].mean() for b in range(17)] for a in range(13)] for n in range(2)]
        assert np.allclose(C.box_mean(x, r), want)
    big = np.random.default_rng(7).random((1, 700, 900))
    took = {}
    for r in (2, 60):
        took[r] = min(_timed(big, r) for _ in range(5))
    assert took[60] < 3 * took[2]  # 880 times the window


def _timed(x, r):
    began = time.perf_counter()
    C.box_mean(x, r)
    return time.perf_counter() - began


def rows_of(spark, data):
    return spark.createDataFrame([(q, t, x.ravel().tolist()) for (q, t), x in data.items()], "seq_id long, frame_idx long, data array<double>").repartition(3)


def collected(df, shape):
    return {(r.seq_id, r.frame_idx): np.reshape(r.data, shape) for r in df.collect()}


def test_local_contrast(spark):
    x = pictures(3, 9, 12, 13)
    assert np.allclose(C.local_contrast(x, x, dark_smoothing=0, bright_smoothing=0), x)
    grey = np.full((1, 12, 12, 3), 0.5)
    assert (C.local_contrast(grey, grey * 0.2) == grey).all()
    dark, ref = np.full((1, 12, 12, 3), 0.1), np.full((1, 12, 12, 3), 0.12)
    assert np.allclose(C.local_contrast(dark, ref), 0.1 + 0.75 * 0.8 * (0.4 * 0.1 * 0.2 + 0.6 * 0.02))
    df = rows_of(spark, {(1, 0): dark[0]})
    got = C.correct(df, df.selectExpr("seq_id", "frame_idx", "transform(data, v -> 0.12d) AS ref"), 12, 12, "contrast")
    assert np.allclose(collected(got, (12, 12, 3))[1, 0], C.local_contrast(dark, ref)[0])
    assert C.correct(df.limit(0), df.selectExpr("seq_id", "frame_idx", "data AS ref"), 12, 12, "zones").count() == 0


def test_first_frames(spark):
    data = {(q, t): pictures(1, 10 * q + t, low=0.05 * t, high=0.4 + 0.06 * t)[0] for q in (1, 2) for t in range(9)}
    df = rows_of(spark, data)
    near = {(r.seq_id, r.frame_idx): r.ref_idx for r in stats.nearest_reference(stats.signature(df, 3), 3).collect()}
    got = collected(C.first_frames(df, 3, 6, 7, "reinhard", 0.5, contrast=True), (6, 7, 3))
    assert set(got) == set(data)
    for (q, t), x in data.items():
        want = x
        if t >= 3:
            ref = data[q, near[q, t]]
            want = stats.colour_match(x.reshape(-1, 3), ref.reshape(-1, 3), "reinhard", 0.5).reshape(x.shape)
            want = C.local_contrast(want[None], ref[None])[0]
        assert np.allclose(got[q, t], want)


@pytest.mark.parametrize("reference", ["rolling", "previous", "first"])
@pytest.mark.parametrize("steps", [True, False])
def test_recoloured(spark, reference, steps):
    data = {(q, t): pictures(1, 10 * q + t, low=0.02 * t, high=0.5 + 0.04 * t)[0] for q in (1, 2) for t in range(11)}
    df = rows_of(spark, data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = collected(C.recoloured(df, 6, 7, reference, "reinhard", 0.8, 0.3, 0.2, steps), (6, 7, 3))
        assert C.recoloured(df.limit(0), 6, 7).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    score = {(r.seq_id, r.frame_idx): r.score for r in stats.scene_change(df, 6, 7, 3).collect()}
    for q in (1, 2):
        done = []
        for t in range(11):
            x, z = data[q, t], score[q, t]
            s = 0.8 * (1 - min((z - 0.3) / 0.7, 1) * 0.8) if z is not None and z > 0.3 else 0.8
            ref = data[q, 0] if reference == "first" or not done else np.mean(done[-5:], axis=0) if reference == "rolling" else done[-1]
            y = plain_advanced(x, ref, s)[0] if steps else stats.colour_match(x.reshape(-1, 3), ref.reshape(-1, 3), "reinhard", s).reshape(x.shape)
            if done:
                y = np.clip(0.8 * y + 0.2 * done[-1], 0, 1)
            done.append(y)
            assert np.allclose(got[q, t], y, atol=1e-9), (q, t)
    with pytest.raises(ValueError):
        C.recoloured(df, 6, 7, "none")


def test_zone_signature_of_plain_pictures(spark):
    got = {r.frame_idx: r for r in C.zone_signature(rows_of(spark, {(1, 0): np.full((2, 2, 3), 0.5), (1, 1): np.full((2, 2, 3), 0.1), (1, 2): np.full((2, 2, 3), 0.9)})).collect()}
    assert got[0].shadow_area == got[0].highlight_area == got[0].shadow_saturation == 0 and got[0].shadow_r == got[0].highlight_level == 0.5
    assert got[1].shadow_area == 1 and abs(got[1].shadow_level - 0.1) < 1e-12 and got[2].highlight_area == 1 and got[2].contrast < 1e-12
