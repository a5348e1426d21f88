"""Resampling, batch functions, tiles that shrink, and memories carried through streams."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelweave.operators import resample as R
from reelweave.operators import transform as T
from reelweave.streaming import tiles as S


def sequences(spark, sizes, k=4, seed=0):
    rng = np.random.default_rng(seed)
    data = {(q, t): rng.random(k) for q, n in sizes.items() for t in range(n)}
    return data, spark.createDataFrame([(q, t, x.tolist()) for (q, t), x in data.items()], "seq_id long, frame_idx long, data array<double>").repartition(5)


def weights(n, m, method):
    w = np.zeros((m, n))
    for o, row in enumerate(R.taps(n, m, method)):
        for i, v in row:
            w[o, i] += v
    return w


@pytest.mark.parametrize(("h", "w", "oh", "ow", "c"), [(5, 7, 9, 4, 3), (6, 6, 6, 6, 1), (2, 3, 7, 8, 4), (9, 8, 1, 1, 3)])
def test_resampling_is_two_matrix_products(spark, h, w, oh, ow, c):
    x = np.random.default_rng(1).random((h, w, c))
    df = spark.createDataFrame([(x.ravel().tolist(),)], "data array<double>")
    got = np.reshape(df.select(R.resample(F.col("data"), h, w, oh, ow, "bicubic", c)).first()[0], (oh, ow, c))
    assert np.allclose(got, np.einsum("ay,bx,yxc->abc", weights(h, oh, "bicubic"), weights(w, ow, "bicubic"), x))
    whole = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    rows = whole(np.einsum("bx,yxc->ybc", weights(w, ow, "lanczos"), np.floor(x * 255)))
    got = np.reshape(df.select(R.resample(F.col("data"), h, w, oh, ow, "lanczos", c)).first()[0], (oh, ow, c))
    assert np.abs(got * 255 - whole(np.einsum("ay,ybc->abc", weights(h, oh, "lanczos"), rows))).max() <= 1
    assert np.allclose(weights(h, oh, "lanczos").sum(1), 1) and np.allclose(weights(w, ow, "bicubic").sum(1), 1)
    with pytest.raises(ValueError):
        R.taps(h, oh, "sinc")


def test_scaling_to_a_shape(spark):
    x = np.random.default_rng(2).random((4, 10, 1))
    df = spark.createDataFrame([(x.ravel().tolist(),)], "data array<double>")
    for width, height, crop, want in ((0, 0, True, (4, 10)), (5, 0, False, (2, 5)), (0, 2, False, (2, 5)), (3, 3, True, (3, 3)), (1, 9, True, (9, 1))):
        out, h, w = R.scale(F.col("data"), 4, 10, width, height, "bicubic", crop)
        got = df.select(out).first()[0]
        assert (h, w) == want and len(got) == h * w
    square = df.select(R.scale(F.col("data"), 4, 10, 4, 4, "bicubic", True)[0]).first()[0]
    assert np.allclose(np.reshape(square, (4, 4)), x[:, 3:7, 0])


@pytest.mark.parametrize("batch", [1, 3, 7, 100])
def test_batches_whose_number_changes(spark, batch):
    data, df = sequences(spark, {1: 20, 2: 1, 3: 8})

    def fn(x):
        return np.repeat(x[::-1] + len(x), np.where(x[::-1, 0] < 0.4, 0, np.where(x[::-1, 0] > 0.7, 3, 1)), axis=0)

    got = {(r.seq_id, r.frame_idx): r.data for r in T.transform(df, fn, batch).collect()}
    for q, n in ((1, 20), (2, 1), (3, 8)):
        x = [data[q, t] for t in range(n)]
        want = [row for k in range(0, n, batch) for row in fn(np.stack(x[k : k + batch]))]
        assert sorted(i for p, i in got if p == q) == list(range(len(want)))
        assert all(np.allclose(got[q, i], row) for i, row in enumerate(want))
    assert T.transform(df, lambda x: x[:0], batch).count() == 0 and T.transform(df.limit(0), fn, batch).count() == 0


def test_tiles_are_halved_until_they_fit(spark):
    rng = np.random.default_rng(3)
    held = {k: rng.random((13, 9, 3)) for k in "abc"}
    df = spark.createDataFrame([(k, x.ravel().tolist()) for k, x in held.items()], "k string, data array<double>")
    limit = {k: n for k, n in zip("abc", (10_000, 40, 20), strict=True)}

    def fn(x):  # the picture is told by a value that only it has
        name = next(k for k, y in held.items() if np.isin(x, y).any())
        if x.shape[0] * x.shape[1] > limit[name]:
            raise MemoryError
        return x.repeat(3, 0).repeat(3, 1)

    px, tiles = T.upscale_tiled(df, ["k"], fn, 13, 9, 3, 3, 16, 3, 4)
    used = {(r.k, r.tile) for r in tiles.collect()}
    assert used == {("a", 16), ("b", 4), ("c", 4)} or used == {("a", 16), ("b", 8), ("c", 4)}
    out = {k: np.full((39, 27, 3), np.nan) for k in held}
    for r in px.collect():
        out[r.k][r.y, r.x, r.ch] = r.v
    assert all(np.allclose(out[k], x.repeat(3, 0).repeat(3, 1)) for k, x in held.items())
    with pytest.raises(MemoryError):
        T.upscale_tiled(df, ["k"], fn, 13, 9, 3, 3, 16, 3, 8)
    assert T.upscale_tiled(df.limit(0), ["k"], fn, 13, 9, 3, 3)[0].count() == 0


def test_tiles_fade_over_their_overlap(spark):
    df = spark.createDataFrame([(1, [1.0] * 40)], "k int, data array<double>")
    px, tiles = T.upscale_tiled(df, ["k"], lambda x: np.full((2 * x.shape[0], 2 * x.shape[1], 1), float(x.shape[1])), 1, 40, tile=24, overlap=8, least=8)
    assert sorted((r.x0, r.x1) for r in tiles.collect()) == [(0, 24), (16, 40)]
    assert {r.v for r in px.collect()} == {24.0}


def fader():
    def fading(x, memory):  # workers don't have this module, so the function travels
        y = x if memory is None else 0.6 * x + 0.4 * memory
        return y, y

    return fading


def shown(df):
    return {(r.seq_id, r.tile, r.frame_idx): tuple(round(v, 12) for v in r.data) for r in df.collect()}


def test_streams_carry_the_same_memories(spark, tmp_path):
    fading = fader()
    data, df = sequences(spark, {1: 17, 2: 5}, 30, 6)
    want = shown(S.carried(S.cut(df, 5, 6, 3, 2), fading))
    assert len(want) == 22 * len(S.places(5, 6, 3, 2))
    for q in (1, 2):
        memory = None
        for t in range(17 if q == 1 else 5):
            y, memory = fading(data[q, t], memory)
            for k, (y0, y1, x0, x1) in enumerate(S.places(5, 6, 3, 2)):
                assert np.allclose(want[q, k, t], y.reshape(5, 6)[y0:y1, x0:x1].ravel())
    merged = S.merge(S.carried(S.cut(df, 5, 6, 3, 2), fading), 5, 6, 3, 2)
    assert merged.count() == 22 * 30 and merged.where("seq_id = 1 AND frame_idx = 0").join(df.select("seq_id", "frame_idx", F.posexplode("data").alias("i", "d")).where("seq_id = 1 AND frame_idx = 0"), F.expr("y * 6 + x = i")).where("abs(v - d) > 1e-9").count() == 0
    # frames come in three files, out of order and one of them twice
    rows = [(q, t, x.tolist()) for (q, t), x in data.items()]
    np.random.default_rng(8).shuffle(rows)
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"seq_id": int(q), "frame_idx": int(t), "data": list(map(float, x))}) for q, t, x in [*rows[k::3], rows[0]]))
        os.utime(source / f"{k}.json", (k + 1, k + 1))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(f"file://{source}")
        out = S.carried_stream(S.cut(stream, 5, 6, 3, 2), fading)
        q = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        q.processAllAvailable()
        q.awaitTermination()
    finally:
        spark.conf.unset(provider)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.count() == len(want) and shown(got) == want
