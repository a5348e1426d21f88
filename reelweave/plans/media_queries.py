"""Queries over frame sequences, latents and geometry, on the embeddings table as 8 x 8 frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelweave.operators import frames as R
from reelweave.operators import geometry as G
from reelweave.operators import latent as L
from reelweave.operators import stats as S
from reelweave.plans._query import query, table

_FRAMES = """f AS (SELECT CAST(label AS BIGINT) AS seq_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, vec_id,
  list_transform(embedding, lambda v: least(greatest((CAST(v AS DOUBLE) + 0.75) / 1.5, 0.0), 1.0)) AS data FROM embeddings)"""


def frames(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    data = F.transform("embedding", lambda v: F.least(F.greatest((v.cast("double") + 0.75) / 1.5, F.lit(0.0)), F.lit(1.0)))
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("seq_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), "vec_id", data.alias("data"))


@query(f"WITH {_FRAMES} SELECT seq_id, frame_idx - 5 AS frame_idx, vec_id FROM f WHERE frame_idx BETWEEN 5 AND 14")
def frame_slice(spark, d):
    """Ten frames of each sequence from the sixth."""
    return R.take(frames(spark, d), 5, 10).select("seq_id", "frame_idx", "vec_id")


@query(f"WITH {_FRAMES}, n AS (SELECT seq_id, count(*) AS n FROM f GROUP BY 1) SELECT seq_id, frame_idx - (n - 7) AS frame_idx, vec_id FROM f JOIN n USING (seq_id) WHERE frame_idx >= n - 7")
def frame_tail(spark, d):
    """The last seven frames of each sequence."""
    return R.take(frames(spark, d), -7).select("seq_id", "frame_idx", "vec_id")


@query(f"""WITH RECURSIVE {_FRAMES}, t AS (SELECT 0 AS i, 0.0::DOUBLE AS t UNION ALL SELECT i + 1, CASE WHEN t <= i THEN t + 10.0::DOUBLE / 3.0::DOUBLE ELSE t END FROM t WHERE i < (SELECT max(frame_idx) FROM f)),
k AS (SELECT i AS source_idx, row_number() OVER (ORDER BY i) - 1 AS frame_idx FROM t WHERE t <= i)
SELECT seq_id, k.frame_idx, k.source_idx, vec_id FROM f JOIN k ON f.frame_idx = k.source_idx""")
def fps_reduce(spark, d):
    """Sequences reduced from 10 to 3 frames a second."""
    return R.reduce_fps(frames(spark, d), 10, 3).select("seq_id", "frame_idx", "source_idx", "vec_id")


@query(f"WITH {_FRAMES}, n AS (SELECT seq_id, count(*) AS n FROM f GROUP BY 1) SELECT seq_id, frame_idx, vec_id FROM f JOIN n USING (seq_id) WHERE frame_idx % CAST(ceil(n / 16) AS BIGINT) = 0 AND frame_idx / CAST(ceil(n / 16) AS BIGINT) < 16")
def preview_indexes(spark, d):
    """At most 16 evenly spaced frames of each sequence."""
    return R.preview(frames(spark, d), 16).select("seq_id", "frame_idx", "vec_id")


@query(f"WITH {_FRAMES} SELECT seq_id, frame_idx, vec_id FROM f WHERE frame_idx < 20")
def max_frames(spark, d):
    """The first twenty frames of each sequence."""
    return R.preview(frames(spark, d), 20, stride=False).select("seq_id", "frame_idx", "vec_id")


@query(f"""WITH {_FRAMES}, n AS (SELECT seq_id, count(*) AS n FROM f GROUP BY 1), c AS (SELECT *, CAST(greatest(1, least(round_even(sqrt(n * 1.0), 0), 12, n)) AS BIGINT) AS cols FROM n)
SELECT seq_id, frame_idx, frame_idx // cols AS row, frame_idx % cols AS col, CAST(ceil(n / cols) AS BIGINT) AS rows FROM f JOIN c USING (seq_id)""")
def contact_sheet(spark, d):
    """Places of the frames on a contact sheet."""
    return R.contact_sheet(frames(spark, d), 8, 8, 12)


_PAIR = f"""{_FRAMES}, a AS (SELECT seq_id // 2 AS seq_id, frame_idx, data FROM f WHERE seq_id % 2 = 0), b AS (SELECT seq_id // 2 AS seq_id, frame_idx, data FROM f WHERE seq_id % 2 = 1),
na AS (SELECT seq_id, count(*) AS n FROM a GROUP BY 1)"""
_SHOW = "SELECT seq_id, frame_idx, CAST(i AS INTEGER) AS i, round(data[i + 1], 6) AS v FROM range(64) AS r(i), "


def _pair(spark, d):
    f = frames(spark, d).select("seq_id", "frame_idx", "data")
    half = F.floor(F.col("seq_id") / 2).cast("long")
    return f.where("seq_id % 2 = 0").withColumn("seq_id", half), f.where("seq_id % 2 = 1").withColumn("seq_id", half)


def _show(df):
    return df.select("seq_id", "frame_idx", F.posexplode("data").alias("i", "v")).withColumn("v", F.round("v", 6))


@query(f"WITH {_PAIR}, o AS (SELECT a.* FROM a JOIN na USING (seq_id) WHERE frame_idx < n - 8 UNION ALL SELECT seq_id, frame_idx + n - 8, data FROM b JOIN na USING (seq_id)) {_SHOW} o")
def extend_overlap_cut(spark, d):
    """A sequence continued by another, eight frames cut off its end."""
    return _show(R.extend_with_overlap(*_pair(spark, d), 8, "cut"))


def _fade_sql(alpha: str, mix: str, side: str = "x.data, y.data") -> str:
    return f"""WITH {_PAIR}, m AS (SELECT x.seq_id, x.frame_idx, {side.split(', ')[0]} AS p, {side.split(', ')[1]} AS q, (y.frame_idx + 1) / 9.0::DOUBLE AS t FROM a x JOIN na ON na.seq_id = x.seq_id JOIN b y ON y.seq_id = x.seq_id AND y.frame_idx = x.frame_idx - (na.n - 8) WHERE y.frame_idx < 8),
g AS (SELECT seq_id, frame_idx, p, q, {alpha} AS w FROM m),
o AS (SELECT a.* FROM a JOIN na USING (seq_id) WHERE frame_idx < n - 8 UNION ALL SELECT seq_id, frame_idx, list_transform(range(1, 65), lambda i: {mix}) FROM g
 UNION ALL SELECT seq_id, frame_idx + n - 8, data FROM b JOIN na USING (seq_id) WHERE frame_idx >= 8) {_SHOW} o"""


@query(_fade_sql("t", "(1 - w) * p[i] + w * q[i]"))
def extend_overlap_linear(spark, d):
    """Cross-faded in a straight line."""
    return _show(R.extend_with_overlap(*_pair(spark, d), 8, "linear_blend"))


@query(_fade_sql("3 * t * t - 2 * t * t * t", "(1 - w) * p[i] + w * q[i]", "y.data, x.data"))
def extend_overlap_ease(spark, d):
    """Cross-faded with an ease at both ends, the new side leading."""
    return _show(R.extend_with_overlap(*_pair(spark, d), 8, "ease_in_out", "new_images"))


@query(_fade_sql("t", "pow((1 - w) * pow(p[i], 2.2) + w * pow(q[i], 2.2), 1 / 2.2)"))
def extend_overlap_filmic(spark, d):
    """Cross-faded in linear light."""
    return _show(R.extend_with_overlap(*_pair(spark, d), 8, "filmic_crossfade"))


_SIG = f"""{_FRAMES}, px AS (SELECT seq_id, frame_idx, unnest(list_transform(data, lambda v: 0.299 * v + 0.587 * v + 0.114 * v)) AS v FROM f),
s AS (SELECT seq_id, frame_idx, avg(v) AS mean, stddev_samp(v) AS std, [quantile_cont(v, 0.1), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), quantile_cont(v, 0.9)] AS pct,
 [{", ".join(f"count(*) FILTER (WHERE v BETWEEN 0 AND 1 AND least(floor(v * 16), 15) = {k}) / (count(*) FILTER (WHERE v BETWEEN 0 AND 1) + 1e-8)" for k in range(16))}] AS hist FROM px GROUP BY 1, 2)"""


_SHOWN = {"p10": ("pct", 1), "p25": ("pct", 2), "p50": ("pct", 3), "p75": ("pct", 4), "p90": ("pct", 5)} | {f"h{k}": ("hist", k + 1) for k in range(16)}


@query(f"WITH {_SIG} SELECT seq_id, frame_idx, round(mean, 6) AS mean, round(std, 6) AS std, {', '.join(f'round({c}[{k}], 6) AS {n}' for n, (c, k) in _SHOWN.items())} FROM s")
def brightness_signature(spark, d):
    """Luminance histogram, moments and quantiles of each frame."""
    s = S.signature(frames(spark, d))
    return s.select("seq_id", "frame_idx", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *[F.round(F.element_at(c, k), 6).alias(n) for n, (c, k) in _SHOWN.items()])


_DIST = """0.6 * list_sum(list_transform(range(1, 17), lambda k: abs(a.hist[k] - b.hist[k]))) + 0.2 * abs(a.mean - b.mean) + 0.1 * abs(a.std - b.std)
 + 0.1 * list_sum(list_transform(range(1, 6), lambda k: abs(a.pct[k] - b.pct[k]))) / 5"""


@query(f"WITH {_SIG}, p AS (SELECT a.seq_id, a.frame_idx, b.frame_idx AS ref_idx, round({_DIST}, 9) AS distance FROM s a JOIN s b ON a.seq_id = b.seq_id AND a.frame_idx >= 5 AND b.frame_idx < 5) SELECT seq_id, frame_idx, arg_min(ref_idx, (distance, ref_idx)) AS ref_idx, round(min(distance), 6) AS distance FROM p GROUP BY 1, 2")
def nearest_reference_frame(spark, d):
    """The nearest of each sequence's first five frames to later ones, and its distance."""
    return S.nearest_reference(S.signature(frames(spark, d)), 5).select("seq_id", "frame_idx", "ref_idx", F.round(F.round("distance", 9), 6).alias("distance"))


def _scene_sql() -> str:
    hist = lambda e, n: f"list_transform(range(64), lambda k: len(list_filter({e}, lambda v: v BETWEEN 0 AND 1 AND least(floor(v * 64), 63) = k)) / ({n} + 1e-8))"
    cols = lambda e: f"list_transform(range(8), lambda x: list_sum(list_transform(range(8), lambda y: {e}[y * 8 + x + 1])) / 8)"
    lum = "list_transform(data, lambda v: 0.299 * v + 0.587 * v + 0.114 * v)"
    return f"""WITH {_FRAMES}, g AS (SELECT seq_id, frame_idx, data, {lum} AS l FROM f),
h AS (SELECT seq_id, frame_idx, {hist("data", 64)} AS h1, {cols("data")} AS m1, {hist("list_concat(l, list_transform(range(128), lambda i: 0.5))", 192)} AS h2, {cols("l")} AS m2 FROM g),
w AS (SELECT *, lag(h1) OVER o AS p1, lag(m1) OVER o AS q1, lag(h2) OVER o AS p2, lag(m2) OVER o AS q2 FROM h WINDOW o AS (PARTITION BY seq_id ORDER BY frame_idx)),
s AS (SELECT seq_id, frame_idx, CASE WHEN p1 IS NOT NULL THEN 20 * greatest(
 least(1, 0.7 * 0.5 * list_sum(list_transform(range(1, 65), lambda k: abs(h1[k] - p1[k]))) + 0.3 * list_sum(list_transform(range(1, 9), lambda k: abs(m1[k] - q1[k]))) / 8),
 least(1, 0.7 * 0.5 * list_sum(list_transform(range(1, 65), lambda k: abs(h2[k] - p2[k]))) + 0.3 * list_sum(list_transform(range(1, 9), lambda k: abs(m2[k] - q2[k]))) / 24)) END AS score FROM w)"""


@query(f"{_scene_sql()} SELECT seq_id, frame_idx, round(score, 6) AS score FROM s")
def scene_change_score(spark, d):
    """Scene-change score of each frame against the one before."""
    return S.scene_change(frames(spark, d), 8, 8).withColumn("score", F.round("score", 6))


@query(f"{_scene_sql()} SELECT seq_id, frame_idx, round(CASE WHEN score > 0.5 THEN 0.9 * (1 - least((score - 0.5) / 0.5, 1) * 0.8) ELSE 0.9 END, 6) AS strength FROM s")
def adaptive_strength(spark, d):
    """Matching strength that falls where scenes change."""
    s = S.scene_change(frames(spark, d), 8, 8)
    return s.select("seq_id", "frame_idx", F.round(S.adaptive_strength(F.col("score"), 0.5, 0.9), 6).alias("strength"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
r AS (SELECT user_id, t, event_id, value AS y FROM e WHERE t = 1 UNION ALL SELECT e.user_id, e.t, e.event_id, 0.4 * e.value + 0.6 * r.y FROM r JOIN e ON e.user_id = r.user_id AND e.t = r.t + 1) SELECT user_id, event_id, round(y, 6) AS smoothed FROM r""")
def ema_smooth(spark, d):
    """Each user's event values, exponentially smoothed."""
    return S.smooth(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.6).select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query()
def corrected_frames(spark, d):
    """Frames matched to the average of the corrected frames before them."""
    return _show(S.corrected(frames(spark, d), 0.8))


@query()
def colour_matched_frames(spark, d):
    """Frames matched to their sequence's first frame in colour."""
    f = frames(spark, d).select("seq_id", "frame_idx", "data")
    ref = f.where("frame_idx = 0").select("seq_id", F.col("data").alias("ref"))
    m = S.match_frames(f, f.join(ref, "seq_id").select("seq_id", "frame_idx", "ref"), "mkl", 0.7)
    return _show(m)


@query()
def sharpened_frames(spark, d):
    """Sharpened frames."""
    return _show(G.sharpen(frames(spark, d), 8, 8, 1, 1.0, 0.5))


_LAG = """l AS (SELECT CAST(label AS BIGINT) AS seq_id, vec_id, embedding AS x, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings),
e AS (SELECT seq_id, vec_id, i, CAST(x[i + 1] AS DOUBLE) AS x, CAST(y[i + 1] AS DOUBLE) AS y FROM l, unnest(range(64)) AS r(i) WHERE y IS NOT NULL)"""


def _elements(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("seq_id"), "vec_id", F.col("embedding").alias("x"), F.lead("embedding").over(w).alias("y")).where("y IS NOT NULL")
    return L.pairs(rows, ["seq_id", "vec_id"], "x", "y")


_NAMES = ["min_x", "max_x", "mean_x", "std_x", "min_y", "max_y", "mean_y", "std_y", "max_diff", "mean_diff", "slope", "intercept", "corr"]


@query(f"""WITH {_LAG}, c AS (SELECT seq_id, count(*) AS n, min(x) AS min_x, max(x) AS max_x, avg(x) AS mean_x, stddev_samp(x) AS std_x, min(y) AS min_y, max(y) AS max_y, avg(y) AS mean_y, stddev_samp(y) AS std_y, max(abs(x - y)) AS max_diff, avg(abs(x - y)) AS mean_diff,
 bool_and(x = y) AS equal, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(x, y) AS corr FROM e GROUP BY 1)
SELECT seq_id, n, equal, {", ".join(f"round({c}, 6) AS {c}" for c in _NAMES)}, CASE WHEN max_diff < 1e-6 THEN 'identical' WHEN max_diff < 1e-4 THEN 'very close' ELSE 'different' END AS grade FROM c""")
def latent_compare(spark, d):
    """Neighbouring latents of each sequence compared."""
    return L.compare(_elements(spark, d), ["seq_id"]).select("seq_id", "n", "equal", *[F.round(c, 6).alias(c) for c in _NAMES], "grade")


@query(f"""WITH {_LAG}, m AS (SELECT seq_id, count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM e GROUP BY 1),
q AS (SELECT seq_id, s4*(s2*s0-s1*s1) - s3*(s3*s0-s1*s2) + s2*(s3*s1-s2*s2) AS w, t2*(s2*s0-s1*s1) - s3*(t1*s0-s1*t0) + s2*(t1*s1-s2*t0) AS w2, s4*(t1*s0-s1*t0) - t2*(s3*s0-s1*s2) + s2*(s3*t0-t1*s2) AS w1, s4*(s2*t0-t1*s1) - s3*(s3*t0-t1*s2) + t2*(s3*s1-s2*s2) AS w0 FROM m)
SELECT seq_id, round(w2 / w, 4) + 0.0 AS c2, round(w1 / w, 4) + 0.0 AS c1, round(w0 / w, 4) + 0.0 AS c0 FROM q""")
def latent_quadratic(spark, d):
    """Parabola through neighbouring latents."""
    return L.quadratic(_elements(spark, d), ["seq_id"]).select("seq_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("c2", "c1", "c0")])


_PARAMS = "VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(L.CHANNEL_PARAMS))


@query(f"WITH p(ch, a, b) AS ({_PARAMS}) SELECT vec_id, CAST(i AS INTEGER) AS i, round(CAST(embedding[i + 1] AS DOUBLE) * a + b, 6) + 0.0 AS v FROM embeddings, range(64) AS r(i), p WHERE p.ch = i % 16")
def latent_convert_fixed(spark, d):
    """Latents under the fixed affine map."""
    e = table(spark, d, "embeddings").select("vec_id", L.convert_fixed(F.transform("embedding", lambda v: v.cast("double")), 16).alias("c"))
    return e.select("vec_id", F.posexplode("c").alias("i", "v")).withColumn("v", F.round("v", 6) + 0.0)


@query(f"WITH p(ch, a, b) AS ({_PARAMS}) SELECT vec_id, CAST(i AS INTEGER) AS i, round((CAST(embedding[i + 1] AS DOUBLE) - b) / a, 6) + 0.0 AS v FROM embeddings, range(64) AS r(i), p WHERE p.ch = i % 16")
def latent_convert_inverse(spark, d):
    """Latents under the inverse map."""
    e = table(spark, d, "embeddings").select("vec_id", L.convert_fixed(F.transform("embedding", lambda v: v.cast("double")), 16, inverse=True).alias("c"))
    return e.select("vec_id", F.posexplode("c").alias("i", "v")).withColumn("v", F.round("v", 6) + 0.0)


@query("SELECT vec_id, CAST(i AS INTEGER) AS i, round((CAST(embedding[i + 1] AS DOUBLE) + 0.224886) / 1.868329 * 0.752230 - 0.084378, 6) + 0.0 AS v FROM embeddings, range(64) AS r(i)")
def latent_convert_normalize(spark, d):
    """Latents standardised in one space and spread out in the other."""
    e = table(spark, d, "embeddings").select("vec_id", L.convert_normalised(F.transform("embedding", lambda v: v.cast("double"))).alias("c"))
    return e.select("vec_id", F.posexplode("c").alias("i", "v")).withColumn("v", F.round("v", 6) + 0.0)


@query(f"WITH {_LAG}, p AS (SELECT i % 16 AS ch, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM e GROUP BY 1) SELECT seq_id, vec_id, CAST(i AS INTEGER) AS i, round(a * x + b, 6) + 0.0 AS v FROM e JOIN p ON p.ch = e.i % 16")
def latent_convert_learned(spark, d):
    """Latents under the line fitted to each channel."""
    e = _elements(spark, d)
    return L.apply_params(e, L.learned_params(e, 16), 16).select("seq_id", "vec_id", "i", (F.round("converted", 6) + 0.0).alias("v"))


@query("SELECT CAST(label AS BIGINT) AS list_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS b, CASE WHEN vec_id % 5 = 0 THEN vec_id ELSE row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 END AS batch_index FROM embeddings")
def latent_batching(spark, d):
    """Latents of a label as one batch, indices carried or counted on."""
    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("list_id"), "vec_id", F.when(F.col("vec_id") % 5 == 0, F.col("vec_id")).alias("batch_index"))
    return L.to_batch(rows, ["vec_id"]).select("list_id", "vec_id", "b", "batch_index")


@query(f"WITH {_FRAMES}, x AS (SELECT seq_id, frame_idx, CAST(i AS INTEGER) AS i, data[i + 1] AS p FROM f, range(64) AS r(i)), m AS (SELECT seq_id, min(p) AS lo, max(p) AS hi FROM x GROUP BY 1) SELECT seq_id, frame_idx, i, round((p - lo) / greatest(hi - lo, 1e-8), 6) AS v FROM x JOIN m USING (seq_id)")
def normalize_to_scale(spark, d):
    """Pixels rescaled to [0, 1] in each sequence."""
    rows = frames(spark, d).select("seq_id", "frame_idx", F.posexplode("data").alias("i", "v"))
    return L.rescale(rows, ["seq_id"], "v").withColumn("v", F.round("v", 6))


_FACTORS = [(ch, rgb, round(0.05 * (ch % 5) - 0.1 * (rgb - 1), 3)) for ch in range(16) for rgb in range(3)]


@query(f"""WITH {_LAG}, w(ch, rgb, w) AS (VALUES {", ".join(f"({c}, {r}, {v}::DOUBLE)" for c, r, v in _FACTORS)}) SELECT vec_id, i // 16 AS pixel, rgb, CAST(least(greatest(round_even(round((sum(x * w) + 1) * 127.5, 6), 0), 0), 255) AS INTEGER) AS level FROM e JOIN w ON w.ch = e.i % 16 GROUP BY 1, 2, 3""")
def latent_preview(spark, d):
    """Latents as preview pixels by a linear map."""
    factors = spark.createDataFrame(_FACTORS, "ch int, rgb int, w double")
    return L.preview_rgb(_elements(spark, d), factors, 16)


@query("""WITH s AS (SELECT p_partkey, p_size * 7 + 20 AS h, p_size * 5 + 33 AS w FROM part),
y AS (SELECT *, unnest(generate_series(0, h - 1, 24)) AS y0 FROM s), t AS (SELECT *, unnest(generate_series(0, w - 1, 24)) AS x0 FROM y)
SELECT p_partkey, CAST(y0 AS INTEGER) AS y0, CAST(least(y0 + 40, h) AS INTEGER) AS y1, CAST(x0 AS INTEGER) AS x0, CAST(least(x0 + 40, w) AS INTEGER) AS x1 FROM t
WHERE NOT (y0 - 24 >= 0 AND y0 - 24 + 40 >= h) AND NOT (x0 - 24 >= 0 AND x0 - 24 + 40 >= w)""")
def tile_grid(spark, d):
    """Overlapping tiles over pictures of the parts' sizes."""
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 7 + 20).alias("h"), (F.col("p_size") * 5 + 33).alias("w"))
    return G.tiles(s, 40, 24).select("p_partkey", "y0", "y1", "x0", "x1")


_TILES = [(y0, x0) for y0 in (0, 3) for x0 in (0, 3)]


@query(f"""WITH {_FRAMES}, t AS (SELECT y0, x0, y0 + y AS y, x0 + x AS x, y, x FROM (VALUES {", ".join(str(t) for t in _TILES)}) AS v(y0, x0), range(5) AS a(y), range(5) AS b(x)),
k AS (SELECT y0, x0, y0 + ly AS y, x0 + lx AS x, ly, lx FROM (VALUES {", ".join(str(t) for t in _TILES)}) AS v(y0, x0), range(5) AS a(ly), range(5) AS b(lx)),
w AS (SELECT *, (CASE WHEN y0 > 0 AND ly < 2 THEN (ly + 1) / 3.0::DOUBLE WHEN y0 = 0 AND ly >= 3 THEN 1 - (ly - 2) / 3.0::DOUBLE ELSE 1 END) * (CASE WHEN x0 > 0 AND lx < 2 THEN (lx + 1) / 3.0::DOUBLE WHEN x0 = 0 AND lx >= 3 THEN 1 - (lx - 2) / 3.0::DOUBLE ELSE 1 END) AS weight FROM k)
SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum((data[y * 8 + x + 1] + 0.01 * (y0 + x0)) * weight) / greatest(sum(weight), 1e-6), 6) AS v FROM f, w GROUP BY 1, 2, 3""")
def feather_merge(spark, d):
    """Four overlapping 5 x 5 tiles of each frame, merged with feathered weights."""
    size = spark.range(1).select(F.lit(8).alias("h"), F.lit(8).alias("w"))
    t = G.tiles(size, 5, 3).withColumn("ly", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("lx", F.explode(F.sequence(F.lit(0), F.lit(4))))
    side = lambda k, a, b, n: G.feather(F.col(k), F.col(b) - F.col(a), F.col(a) == 0, F.col(b) >= F.col(n), 2)
    t = t.select("y0", "x0", (F.col("y0") + F.col("ly")).alias("y"), (F.col("x0") + F.col("lx")).alias("x"), (side("ly", "y0", "y1", "h") * side("lx", "x0", "x1", "w")).alias("weight"))
    # the tiles of one picture size are a small fixed table: each pixel finds its tiles in it by an equality
    px = frames(spark, d).select("vec_id", F.posexplode("data").alias("i", "v")).select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")
    parts = px.join(F.broadcast(t), ["y", "x"]).withColumn("v", F.col("v") + 0.01 * (F.col("y0") + F.col("x0")))
    return G.merge_tiles(parts, ["vec_id"]).withColumn("v", F.round("v", 6))


@query(f"""WITH {_FRAMES}, p AS (SELECT *, lead(data) OVER (PARTITION BY seq_id ORDER BY frame_idx) AS nxt FROM f)
SELECT seq_id, frame_idx * 3 + k AS frame_idx, CAST(i AS INTEGER) AS i, round(CASE WHEN k = 0 THEN data[i + 1] ELSE (1 - k / 3.0::DOUBLE) * data[i + 1] + k / 3.0::DOUBLE * nxt[i + 1] END, 6) AS v FROM p, range(3) AS r(k), range(64) AS s(i) WHERE k = 0 OR nxt IS NOT NULL""")
def interp_time_grid(spark, d):
    """Two frames put between each two neighbours."""
    return _show(R.interpolate(frames(spark, d).select("seq_id", "frame_idx", "data"), 3))


@query("""WITH n AS (SELECT CAST(label AS BIGINT) AS seq_id, count(*) AS n FROM embeddings GROUP BY 1), w AS (SELECT *, unnest(range(1 + greatest(0, CAST(ceil((n - 21) / 16) AS BIGINT)))) AS loop FROM n)
SELECT seq_id, CAST(loop AS INTEGER) AS loop, CASE WHEN loop = 0 THEN 0 ELSE 16 * loop END AS start, least(n, 21 + 16 * loop) AS end FROM w""")
def loop_windows(spark, d):
    """Overlapping windows over each sequence's latents."""
    n = table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("seq_id")).agg(F.count("*").alias("n"))
    return R.loop_windows(n, 81, 17)


#: Frames as 22 pixels of three channels: all values, and two zeros.
_PIXELS = "list_concat(data, [0.0::DOUBLE, 0.0::DOUBLE])"


def _padded(data):
    return F.concat(data, F.array(F.lit(0.0), F.lit(0.0)))


@query(f"""WITH {_FRAMES}, q AS (SELECT vec_id, list_transform({_PIXELS}, lambda v: floor(v * 2) / 2) AS d FROM f),
c AS (SELECT vec_id, i, CAST(round_even(d[3*i+1] * 255, 0) * 65536 + round_even(d[3*i+2] * 255, 0) * 256 + round_even(d[3*i+3] * 255, 0) AS INTEGER) AS p FROM q, range(22) AS r(i))
SELECT vec_id, count(*) FILTER (WHERE p IN (8421504, 128)) AS n_mask, string_agg(CASE WHEN p IN (8421504, 128) THEN '1' ELSE '0' END, '' ORDER BY i) AS mask FROM c GROUP BY 1""")
def color_mask(spark, d):
    """Which pixels of each frame have one of two colours, and how many."""
    colours = G.parse_colours("#808080, 128")[0]
    q = frames(spark, d).select("vec_id", F.transform(_padded(F.col("data")), lambda v: F.floor(v * 2) / 2).alias("d"))
    masks = q.select("vec_id", G.colour_mask(F.col("d"), colours).alias("m"))
    return masks.select("vec_id", F.aggregate("m", F.lit(0.0), lambda s, v: s + v).cast("long").alias("n_mask"), F.array_join(F.transform("m", lambda v: v.cast("int").cast("string")), "").alias("mask"))


@query(f"""WITH {_FRAMES}, m AS (SELECT vec_id, data, i % 8 AS x, i // 8 AS y, data[i + 1] > 0.62 AS hit, data[i + 1] AS v FROM f, range(64) AS r(i)),
b AS (SELECT vec_id, coalesce(min(x) FILTER (WHERE hit), 0) AS x1, coalesce(min(y) FILTER (WHERE hit), 0) AS y1, coalesce(max(x) FILTER (WHERE hit), 0) AS x2, coalesce(max(y) FILTER (WHERE hit), 0) AS y2, NOT bool_or(hit) AS e FROM m GROUP BY 1),
c AS (SELECT vec_id, CASE WHEN e THEN 0 ELSE x1 END AS x, CASE WHEN e THEN 0 ELSE y1 END AS y, CASE WHEN e THEN 3 ELSE greatest(x2 - x1 + 1, 3) END AS w, CASE WHEN e THEN 3 ELSE greatest(y2 - y1 + 1, 3) END AS h FROM b)
SELECT c.vec_id, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, CAST(c.w AS INTEGER) AS w, CAST(c.h AS INTEGER) AS h, count(*) AS n, round(sum(v), 5) AS total FROM c JOIN m ON m.vec_id = c.vec_id AND m.x >= c.x AND m.x < c.x + c.w AND m.y >= c.y AND m.y < c.y + c.h GROUP BY ALL""")
def mask_bbox_crop(spark, d):
    """Crops around each frame's bright pixels."""
    f = frames(spark, d).withColumn("mask", F.transform("data", lambda v: F.when(v > 0.62, 1.0).otherwise(0.0)))
    f = f.withColumn("box", G.crop_box(G.mask_box(F.col("mask"), 8), 3)).withColumn("c", G.crop(F.col("data"), 8, 8, F.col("box")))
    return f.select("vec_id", "box.*", F.size("c").cast("long").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query(f"""WITH {_FRAMES}, m AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, data[i + 1] AS v FROM f, range(64) AS r(i)),
n AS (SELECT a.vec_id, a.x, a.y, max(b.v) AS grown, min(b.v) AS shrunk FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3) SELECT vec_id, CAST(y * 8 + x AS INTEGER) AS i, round(grown, 6) AS grown, round(shrunk, 6) AS shrunk FROM n""")
def dilate_erode(spark, d):
    """Frames dilated and eroded by a 3 x 3 square, pixel by pixel."""
    f = frames(spark, d).select("vec_id", G.dilate(F.col("data"), 8, 8, 1).alias("a"), G.dilate(F.col("data"), 8, 8, -1).alias("b"))
    both = f.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "p"))
    return both.select("vec_id", "i", F.round("p.a", 6).alias("grown"), F.round("p.b", 6).alias("shrunk"))


@query(f"""WITH {_FRAMES}, p AS (SELECT vec_id, data, lead(data) OVER (PARTITION BY seq_id ORDER BY frame_idx) AS s FROM f)
SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, round(CASE WHEN i // 8 BETWEEN 3 AND 6 AND i % 8 >= 5 THEN 0.25 * s[(i // 8 - 3) * 4 + i % 8 - 5 + 1] + 0.75 * data[i + 1] ELSE data[i + 1] END, 6) AS v FROM p, range(64) AS r(i) WHERE s IS NOT NULL""")
def composite_masked(spark, d):
    """A 4 x 4 patch of the next frame laid over each frame at (5, 3), a quarter opaque."""
    w = Window.partitionBy("seq_id").orderBy("frame_idx")
    f = frames(spark, d).withColumn("s", F.slice(F.lead("data").over(w), 1, 16)).where("s IS NOT NULL")
    mask = F.array_repeat(F.lit(0.25), 16)
    out = f.select("vec_id", F.posexplode(G.composite(F.col("data"), F.col("s"), mask, 8, 8, 4, 4, 5, 3)).alias("i", "v"))
    return out.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.round("v", 6).alias("v"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_linenumber * 10.0::DOUBLE AS y, l_discount * 100 AS w, l_tax * 200 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round_even(least(1, greatest(0, x / 64)), 3) AS x1, round_even(least(1, greatest(0, y / 48)), 3) AS y1, round_even(least(1, greatest(0, (x + w) / 64)), 3) AS x2, round_even(least(1, greatest(0, (y + h) / 48)), 3) AS y2 FROM b""")
def bbox_normalize(spark, d):
    """Boxes from line items as shares of a 64 x 48 picture."""
    b = table(spark, d, "lineitem")
    box = G.normalise_box(F.col("l_quantity"), F.col("l_linenumber") * 10.0, F.col("l_discount") * 100, F.col("l_tax") * 200, 64.0, 48.0, 3)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)])


@query("SELECT p_partkey, round(greatest(512 / least(h, w), 768 / greatest(h, w)), 6) AS larger, round(least(512 / least(h, w), 768 / greatest(h, w)), 6) AS smaller FROM (SELECT p_partkey, p_size + 10 AS h, p_partkey % 37 + 12 AS w FROM part)")
def upscale_amount(spark, d):
    """Factors to two target sizes."""
    a, b = G.upscale_amount(F.col("p_size") + 10, F.col("p_partkey") % 37 + 12, 512, 768)
    return table(spark, d, "part").select("p_partkey", F.round(a, 6).alias("larger"), F.round(b, 6).alias("smaller"))


@query("""WITH s AS (SELECT p_partkey, CAST(p_size + 10 AS BIGINT) AS w, p_partkey % 37 + 12 AS h FROM part), a AS (SELECT *, CAST(round_even(512 * (greatest(w, h) / least(w, h)), 0) AS BIGINT) AS nl, CAST(round_even(768 / (greatest(w, h) / least(w, h)), 0) AS BIGINT) AS ns FROM s),
o AS (SELECT p_partkey, CASE WHEN nl <= 768 THEN CASE WHEN w < h THEN 512 ELSE nl END ELSE CASE WHEN w < h THEN ns ELSE 768 END END AS ow, CASE WHEN nl <= 768 THEN CASE WHEN h < w THEN 512 ELSE nl END ELSE CASE WHEN h < w THEN ns ELSE 768 END END AS oh FROM a)
SELECT p_partkey, CAST(ow - ow % 8 AS BIGINT) AS width, CAST(oh - oh % 8 AS BIGINT) AS height FROM o""")
def scale_dims(spark, d):
    """Target sizes that fit the short side, divisible by eight."""
    w, h = G.scale_dims((F.col("p_size") + 10).cast("long"), F.col("p_partkey") % 37 + 12, 512, 768, "small", 8)
    return table(spark, d, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query(f"WITH {_FRAMES} SELECT vec_id, CAST(i AS INTEGER) AS i, round(data[CAST(least(floor((i // 5 + 0.5) * (8 / 5)), 7) * 8 + least(floor((i % 5 + 0.5) * (8 / 5)), 7) AS BIGINT) + 1], 6) AS v FROM f, range(25) AS r(i)")
def scale_nearest(spark, d):
    """Frames scaled to 5 x 5 by the nearest pixel."""
    return _pixels(frames(spark, d), G.scale_nearest(F.col("data"), 8, 8, 5, 5))


def _pixels(f, data):
    return f.select("vec_id", F.posexplode(data).alias("i", "v")).withColumn("v", F.round("v", 6))


@query(f"""WITH {_FRAMES}, g AS (SELECT o, CAST(floor(s) AS BIGINT) AS a, CAST(least(floor(s) + 1, 7) AS BIGINT) AS b, s - floor(s) AS t FROM (SELECT o, greatest(0, (o + 0.5) * (8 / 12::DOUBLE) - 0.5) AS s FROM range(12) AS r(o)))
SELECT vec_id, CAST(y.o * 12 + x.o AS INTEGER) AS i, round((data[y.a*8+x.a+1] * (1 - x.t) + data[y.a*8+x.b+1] * x.t) * (1 - y.t) + (data[y.b*8+x.a+1] * (1 - x.t) + data[y.b*8+x.b+1] * x.t) * y.t, 6) AS v FROM f, g y, g x""")
def scale_bilinear(spark, d):
    """Frames scaled to 12 x 12 with bilinear sampling."""
    return _pixels(frames(spark, d), G.scale_bilinear(F.col("data"), 8, 8, 12, 12))


@query(f"""WITH {_FRAMES}, p AS (SELECT vec_id, j // 8 AS y, j % 8 AS x, data[j + 1] AS v FROM f, range(64) AS r(j)), g AS (SELECT o, floor(o * (8 / 3)) AS a, ceil((o + 1) * (8 / 3)) AS b FROM range(3) AS r(o))
SELECT vec_id, CAST(gy.o * 3 + gx.o AS INTEGER) AS i, round(avg(v), 6) AS v FROM p JOIN g gy ON y >= gy.a AND y < gy.b JOIN g gx ON x >= gx.a AND x < gx.b GROUP BY 1, 2""")
def scale_area(spark, d):
    """Frames scaled to 3 x 3 by area means."""
    return _pixels(frames(spark, d), G.scale_area(F.col("data"), 8, 8, 3, 3))


@query("""SELECT w AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2""")
def event_windows(spark, d):
    """Counts of two-hour windows that start every hour."""
    from reelweave.streaming import events as E

    return E.sliding(table(spark, d, "events"), "2 hours", "1 hour", ["event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def throttled_last(spark, d):
    """The last value of each event type in each hour."""
    from reelweave.streaming import events as E

    return E.throttled(table(spark, d, "events"), "1 hour", ["event_type"])


@query("""WITH k AS (SELECT p_partkey, p_type || '.' || p_name AS name, p_name AS short, p_brand AS family, p_size AS n_params FROM part WHERE p_size <= 30 AND lower(p_brand) = 'brand#13')
SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY short) > 1 THEN short || ' (' || family || ')' ELSE short END AS option, name, n_params FROM k""")
def catalog_filter(spark, d):
    """Parts as a catalogue: those of a brand with few enough parameters, names that occur twice told apart."""
    from reelweave.operators import registry

    name = F.concat("p_type", F.lit("."), "p_name")
    cat = table(spark, d, "part").select("p_partkey", name.alias("name"), F.col("p_brand").alias("family"), F.col("p_size").alias("n_params"))
    return registry.options(cat, "BRAND#13", 30).select("p_partkey", "option", "name", "n_params")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber * 7 AS x, l_linenumber * 5 AS y, CAST(floor(l_quantity) AS INTEGER) AS q, l_partkey % 30 AS h FROM lineitem),
s AS (SELECT *, [round_even(least(1, x / 64), 3), round_even(least(1, y / 48), 3), round_even(least(1, (x + q) / 64), 3), round_even(least(1, (y + h) / 48), 3)] AS one,
 [round_even(1 / 64, 3), round_even(2 / 48, 3), round_even(least(1, q / 64), 3), round_even(least(1, l_linenumber * 40 / 48), 3)] AS two FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(one, ',') || ';' || array_to_string(two, ',') AS boxes, array_to_string(two, ',') AS second FROM s""")
def bbox_texts(spark, d):
    """Boxes of two frames, of both kinds, as texts: all, and the second alone."""
    q, n = F.floor("l_quantity").cast("string"), F.col("l_linenumber")
    text = F.format_string('[[{"x": %d, "y": %d, "width": %s, "height": %d}], [{"x1": 1, "y1": 2, "x2": %s, "y2": %d}]]', n * 7, n * 5, q, F.col("l_partkey") % 30, q, n * 40)
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.parse_boxes(text).alias("b"))
    joined = lambda k: F.array_join(G.box_texts(F.col("b"), 64.0, 48.0, 3, k), ";")
    return b.select("l_orderkey", "l_linenumber", "l_partkey", joined(-1).alias("boxes"), joined(1).alias("second"))


@query(f"WITH {_FRAMES} SELECT seq_id, CAST(i AS INTEGER) AS i, round(max(abs(data[i + 1] - 0.5)), 6) AS v FROM f, range(64) AS r(i) GROUP BY 1, 2")
def mask_union(spark, d):
    """One mask for each sequence from all of its signed frames."""
    f = frames(spark, d).withColumn("data", F.transform("data", lambda v: v - 0.5))
    u = G.union_masks(f, ["seq_id"], "data").select("seq_id", F.posexplode("data").alias("i", "v"))
    return u.withColumn("v", F.round("v", 6))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * (p_partkey % 37 + 12) * 3 * 2 AS bytes FROM part")
def frame_bytes(spark, d):
    """Bytes of half-precision colour pictures of the parts' sizes."""
    return table(spark, d, "part").select("p_partkey", R.bytes_estimate([F.col("p_size"), F.col("p_partkey") % 37 + 12, F.lit(3)], 2).alias("bytes"))


_LATENTS = """l AS (SELECT vec_id, CAST(b AS INTEGER) AS item, CAST(i AS INTEGER) AS i, embedding[b * 16 + i + 1] AS v,
 CASE vec_id % 3 WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN CASE WHEN b = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END END AS mask, CASE WHEN vec_id % 2 = 0 THEN CASE WHEN b = 0 THEN vec_id ELSE vec_id + 100 END END AS batch_index
 FROM embeddings, range(4) AS q(b), range(16) AS r(i))"""


def _latents(spark, d):
    samples = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.slice("embedding", b * 16 + 1, 16))
    one = lambda *v: F.array(*[F.array(F.lit(x)) for x in v])
    masks = F.when(F.col("vec_id") % 3 == 1, one(1.0)).when(F.col("vec_id") % 3 == 2, one(0.25, 0.5))
    index = F.when(F.col("vec_id") % 2 == 0, F.array(F.col("vec_id"), F.col("vec_id") + 100))
    return L.split_batches(table(spark, d, "embeddings").select(F.col("vec_id").alias("latent_id"), samples.alias("samples"), masks.alias("noise_mask"), index.alias("batch_index")))


def _items_shown(items):
    rows = items.select(F.col("latent_id").alias("vec_id"), "item", F.posexplode("samples").alias("i", "v"), F.get("noise_mask", F.lit(0)).alias("mask"), "batch_index")
    return rows.withColumn("v", F.round(F.col("v").cast("double"), 6))


@query(f"WITH {_LATENTS} SELECT vec_id, item, i, round(CAST(v AS DOUBLE), 6) AS v, mask, batch_index FROM l")
def latent_split(spark, d):
    """Batches of four latents taken apart, with no mask, one or two and with fewer indices than items."""
    return _items_shown(_latents(spark, d))


@query(f"WITH {_LATENTS} SELECT vec_id, item, i, round(CAST(v AS DOUBLE), 6) AS v, mask, CAST(item AS BIGINT) AS batch_index FROM l")
def latent_merge(spark, d):
    """The same put together again: indices counted through."""
    return _items_shown(L.merge_outputs(_latents(spark, d), ["latent_id"], ["item"]))


_BOTH = ["mean_x", "mean_y", "std_x", "std_y"]


@query(f"""WITH {_LAG} SELECT seq_id, CAST(i % 16 AS INTEGER) AS ch, round(corr(x, y), 6) + 0.0 AS corr, round(avg(x), 6) + 0.0 AS mean_x, round(avg(y), 6) + 0.0 AS mean_y, round(stddev_samp(x), 6) AS std_x, round(stddev_samp(y), 6) AS std_y FROM e GROUP BY 1, 2""")
def latent_channels(spark, d):
    """Neighbouring latents compared channel by channel."""
    c = L.channel_correlations(_elements(spark, d), ["seq_id"], 16)
    return c.select("seq_id", "ch", *[(F.round(n, 6) + 0.0).alias(n) for n in ("corr", *_BOTH)])


@query(f"""WITH {_LAG}, s AS (SELECT seq_id, i % 16 AS ch, i // 16 AS place, avg(x) AS x, avg(y) AS y FROM e GROUP BY ALL), t AS (SELECT seq_id, vec_id, i % 16 AS ch, avg(x) AS x, avg(y) AS y FROM e GROUP BY ALL),
a AS (SELECT seq_id, corr(x, y) AS c FROM s GROUP BY 1), b AS (SELECT seq_id, corr(x, y) AS c FROM t GROUP BY 1), o AS (SELECT seq_id, corr(x, y) AS c FROM e GROUP BY 1)
SELECT seq_id, round(a.c, 6) + 0.0 AS spatial, round(b.c, 6) + 0.0 AS temporal, CASE WHEN abs(o.c) > 0.9 THEN 'strong' WHEN abs(o.c) > 0.7 THEN 'moderate' ELSE 'weak' END AS grade FROM a JOIN b USING (seq_id) JOIN o USING (seq_id)""")
def latent_patterns(spark, d):
    """Correlations of neighbouring latents over places and over time, and a grade of the whole."""
    e = _elements(spark, d).withColumns({"ch": F.col("i") % 16, "place": F.floor(F.col("i") / 16)})
    of = lambda cells, name: L.mean_correlation(e, ["seq_id"], cells).select("seq_id", (F.round("corr", 6) + 0.0).alias(name))
    whole = L.compare(e, ["seq_id"]).select("seq_id", L.correlation_grade(F.col("corr")).alias("grade"))
    return of(["ch", "place"], "spatial").join(of(["vec_id", "ch"], "temporal"), "seq_id").join(whole, "seq_id")


# Parabolas by elimination on centred powers, unlike the operator's determinants.
_FITS = f"""WITH {_LAG}, m AS (SELECT seq_id, min(x) AS x0, max(x) AS x1, avg(x) AS mx, stddev_samp(x) AS sx, min(y) AS y0, max(y) AS y1, avg(y) AS my, stddev_samp(y) AS sy, regr_slope(y, x) AS a, regr_intercept(y, x) AS b,
 covar_pop(x, x) AS xx, covar_pop(x, x * x) AS xq, covar_pop(x * x, x * x) AS qq, covar_pop(x, y) AS xy, covar_pop(x * x, y) AS qy, avg(x * x) AS mq FROM e GROUP BY 1),
q AS (SELECT *, (qy * xx - xy * xq) / (qq * xx - xq * xq) AS c2, (xy * qq - qy * xq) / (qq * xx - xq * xq) AS c1 FROM m),
g AS (SELECT seq_id, unnest([struct_pack(method := 'linear', gap := abs(a * x + b - y)), struct_pack(method := 'normalise', gap := abs((x - mx) / sx * sy + my - y)),
 struct_pack(method := 'quadratic', gap := abs(c2 * x * x + c1 * x + my - c2 * mq - c1 * mx - y)), struct_pack(method := 'range', gap := abs((x - x0) / (x1 - x0) * (y1 - y0) + y0 - y))], recursive := true) FROM e JOIN q USING (seq_id)),
r AS (SELECT seq_id, method, max(gap) AS error, avg(gap) AS mean_error FROM g GROUP BY 1, 2)"""


@query(f"{_FITS} SELECT seq_id, method, round(error, 5) AS error, round(mean_error, 5) AS mean_error, CASE WHEN error < 0.001 THEN 'excellent' WHEN error < 0.01 THEN 'good' WHEN error < 0.1 THEN 'usable' ELSE 'poor' END AS grade FROM r")
def latent_conversion_errors(spark, d):
    """Errors of four ways from each sequence's latents to their neighbours."""
    e = L.conversion_errors(_elements(spark, d), ["seq_id"])
    return e.withColumns({c: F.round(c, 5) for c in ("error", "mean_error")})


@query(f"{_FITS} SELECT seq_id, arg_min(method, error) AS method, round(min(error), 5) AS error, CASE WHEN min(error) < 0.01 THEN 'excellent' WHEN min(error) < 0.1 THEN 'moderate' WHEN min(error) < 1 THEN 'poor' ELSE 'incompatible' END AS verdict FROM r GROUP BY 1")
def latent_best_fit(spark, d):
    """The best of the four ways for each sequence."""
    best = L.best_fit(L.conversion_errors(_elements(spark, d), ["seq_id"]), ["seq_id"])
    return best.select("seq_id", "method", F.round("error", 5).alias("error"), L.feasibility(F.col("error")).alias("verdict"))


_LIN = "list_transform({}, lambda c: CASE WHEN c > 0.04045 THEN pow((c + 0.055) / 1.055, 2.4) ELSE c / 12.92 END)"
_NORM = "list_transform([{}], lambda v: CASE WHEN v > 0.008856 THEN pow(v, 1 / 3::DOUBLE) ELSE v * 7.787 + 4 / 29::DOUBLE END)"
_CUBE = "CASE WHEN {0} > 0.2068966 THEN pow({0}, 3) ELSE ({0} - 4 / 29::DOUBLE) / 7.787 END"


def _sum_sql(row, values, by: str = "") -> str:
    return "(" + " + ".join(f"{k}::DOUBLE * {v}" for k, v in zip(row, values, strict=True)) + f"){by}"


def _lab_sql(v: str) -> str:
    return _NORM.format(", ".join(_sum_sql(row, [f"{v}[{k}]" for k in (1, 2, 3)], f" / {white}::DOUBLE") for row, white in zip(R._TO_XYZ, R._WHITE, strict=True)))


_PERCEPTUAL = f"""WITH {_PAIR}, pa AS (SELECT * REPLACE ({_PIXELS} AS data) FROM a), pb AS (SELECT * REPLACE ({_PIXELS} AS data) FROM b), m AS (SELECT x.seq_id, x.frame_idx, j, x.data[3 * j + 1:3 * j + 3] AS p, y.data[3 * j + 1:3 * j + 3] AS q, (y.frame_idx + 1) / 9.0::DOUBLE AS t
 FROM pa x JOIN na ON na.seq_id = x.seq_id JOIN pb y ON y.seq_id = x.seq_id AND y.frame_idx = x.frame_idx - (na.n - 8), range(22) AS s(j) WHERE y.frame_idx < 8),
l AS (SELECT seq_id, frame_idx, j, t, {_LIN.format("p")} AS p, {_LIN.format("q")} AS q FROM m), n AS (SELECT seq_id, frame_idx, j, t, {_lab_sql("p")} AS p, {_lab_sql("q")} AS q FROM l),
k AS (SELECT seq_id, frame_idx, j, list_transform(range(1, 4), lambda i: (1 - t) * p[i] + t * q[i]) AS f FROM n),
x AS (SELECT seq_id, frame_idx, j, [{_CUBE.format("f[1]")} * {R._WHITE[0]}, {_CUBE.format("f[2]")}, {_CUBE.format("greatest(f[3], 0)")} * {R._WHITE[2]}] AS z FROM k),
r AS (SELECT seq_id, frame_idx, j, list_transform([{", ".join(_sum_sql(row, [f"z[{k}]" for k in (1, 2, 3)]) for row in R._FROM_XYZ)}], lambda c: least(1, greatest(0, CASE WHEN c > 0.0031308 THEN 1.055 * pow(greatest(c, 0.0031308), 1 / 2.4::DOUBLE) - 0.055 ELSE 12.92 * greatest(c, 0) END))) AS c FROM x),
o AS (SELECT seq_id, frame_idx, i, data[i + 1] AS v FROM pa JOIN na USING (seq_id), range(66) AS s(i) WHERE frame_idx < n - 8 UNION ALL SELECT seq_id, frame_idx, 3 * j + i, c[i + 1] FROM r, range(3) AS s(i)
 UNION ALL SELECT seq_id, frame_idx + n - 8, i, data[i + 1] FROM pb JOIN na USING (seq_id), range(66) AS s(i) WHERE frame_idx >= 8)
SELECT seq_id, frame_idx, CAST(i AS INTEGER) AS i, round(v, 5) AS v FROM o"""


@query(_PERCEPTUAL)
def extend_overlap_perceptual(spark, d):
    """Cross-faded in Lab, frames taken as 22 pixels of three channels, the last two values zero."""
    a, b = (f.withColumn("data", _padded(F.col("data"))) for f in _pair(spark, d))
    out = R.extend_with_overlap(a, b, 8, "perceptual_crossfade")
    return out.select("seq_id", "frame_idx", F.posexplode("data").alias("i", "v")).withColumn("v", F.round("v", 5))


_AROUND = "CASE WHEN {0} < 0 THEN -{0} WHEN {0} > 7 THEN 14 - {0} ELSE {0} END"


def _box_sql(v: str) -> str:
    at = f"({_AROUND.format('(i // 8 + k // 3 - 1)')}) * 8 + {_AROUND.format('(i % 8 + k % 3 - 1)')} + 1"
    return f"list_transform(range(64), lambda i: list_sum(list_transform(range(9), lambda k: {v}[CAST({at} AS BIGINT)])))"


@query(f"""WITH {_FRAMES}, z AS (SELECT seq_id, frame_idx, data, list_transform(data, lambda v: least(1, greatest(0, (0.4 - v) / 0.4))) AS s, list_transform(data, lambda v: least(1, greatest(0, (v - 0.6) / 0.4))) AS g,
 list_transform(range(64), lambda i: list_sum(list_transform(range(25), lambda k: CASE WHEN i // 8 + k // 5 BETWEEN 2 AND 9 AND i % 8 + k % 5 BETWEEN 2 AND 9 THEN data[(i // 8 + k // 5 - 2) * 8 + i % 8 + k % 5 - 2 + 1] ELSE 0 END)) / 25) AS near, {_box_sql("data")} AS box FROM f),
m AS (SELECT *, list_avg(list_filter(data, lambda v, i: s[i] > 0.1)) AS ms, list_avg(list_transform(list_filter(data, lambda v, i: g[i] > 0.1), lambda v: least(1, greatest(0.7, 1 - (v - 0.7) / 0.3 * 0.12)))) AS mg FROM z),
p AS (SELECT *, list_transform(data, lambda v, i: v + s[i] * (CASE WHEN s[i] > 0.1 THEN v * (0.3 - v) / 0.3 * 0.16 ELSE 0 END + coalesce(ms - v, 0) * 0.08)
 + g[i] * (CASE WHEN g[i] > 0.1 THEN v * (least(1, greatest(0.7, 1 - (v - 0.7) / 0.3 * 0.12)) - 1) ELSE 0 END + 0.8 * coalesce(mg, 0) * (v - near[i]))) AS p0 FROM m),
a AS (SELECT *, {_box_sql("p0")} AS b0 FROM p), b AS (SELECT *, list_transform(p0, lambda v, i: v + s[i] * exp(-abs(9 * data[i] - box[i]) / 0.1) * 0.3 * (b0[i] / 9 - v)) AS p1 FROM a), c AS (SELECT *, {_box_sql("p1")} AS b1 FROM b),
o AS (SELECT seq_id, frame_idx, list_transform(p1, lambda v, i: least(1, greatest(0, v + g[i] * exp(-abs(9 * data[i] - box[i]) / 0.1) * 0.2 * (b1[i] / 9 - v)))) AS data FROM c) {_SHOW} o""")
def stabilised_frames(spark, d):
    """Frames with shadows lifted, highlights compressed and both zones smoothed."""
    return _show(S.stabilise(frames(spark, d).select("seq_id", "frame_idx", "data"), 8, 8))


_SIZED = f"{_FRAMES}, z AS (SELECT seq_id, frame_idx, 3 + (vec_id + seq_id) % 4 AS h, 4 + vec_id % 5 AS w, data FROM f)"


@query(f"""WITH {_SIZED}, m AS (SELECT seq_id, max(h) AS mh, max(w) AS mw FROM z GROUP BY 1)
SELECT seq_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN y < h AND x < w THEN round(data[CAST(y * w + x + 1 AS BIGINT)], 6) ELSE 0.0::DOUBLE END AS v FROM z JOIN m USING (seq_id), range(8) AS a(y), range(8) AS b(x) WHERE y < mh AND x < mw""")
def padded_frames(spark, d):
    """Frames of many sizes on black pictures of their sequence's largest."""
    f = frames(spark, d).withColumns({"h": 3 + (F.col("vec_id") + F.col("seq_id")) % 4, "w": 4 + F.col("vec_id") % 5})
    sized = f.select("seq_id", "frame_idx", "h", "w", F.slice("data", F.lit(1), (F.col("h") * F.col("w")).cast("int")).alias("data"))
    rows = G.pad_to_largest(sized, ["seq_id"]).select("seq_id", "frame_idx", "w", F.posexplode("data").alias("i", "v"))
    return rows.select("seq_id", "frame_idx", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), F.round("v", 6).alias("v"))


@query("""WITH n AS (SELECT c_nationkey AS place, c_custkey AS key, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS slot, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey),
m AS (SELECT place, max(slot) AS most FROM n GROUP BY 1), g AS (SELECT DISTINCT place, key FROM n)
SELECT g.place, g.key, CAST(s AS INTEGER) AS slot, coalesce(price, 0) AS price FROM g JOIN m USING (place), unnest(range(most + 1)) AS r(s) LEFT JOIN n ON n.place = g.place AND n.key = g.key AND n.slot = s""")
def filled_slots(spark, d):
    """Orders in numbered slots, as many for each customer as the busiest one of the nation has; missing ones cost nothing."""
    both = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    slot = F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderkey")) - 1
    rows = both.select(F.col("c_nationkey").alias("place"), F.col("c_custkey").alias("key"), slot.alias("slot"), F.col("o_totalprice").alias("price"))
    return G.fill_slots(rows, ["place"], "key", "slot", {"price": F.lit(0.0)})


@query(f"""WITH {_FRAMES}, q AS (SELECT vec_id, list_transform({_PIXELS}, lambda v: floor(v * 2) / 2) AS d FROM f)
SELECT vec_id, CAST(i AS INTEGER) AS i, CASE WHEN (d[3*i+1], d[3*i+2], d[3*i+3]) IN ((0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (0.5, 0.5, 0.0)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM q, range(22) AS r(i)""")
def named_color_mask(spark, d):
    """Where each frame, in three levels a channel, is grey, black or olive."""
    q = frames(spark, d).select("vec_id", F.transform(_padded(F.col("data")), lambda v: F.floor(v * 2) / 2).alias("d"))
    return q.select("vec_id", F.posexplode(G.colour_mask(F.col("d"), G.parse_colours("Gray, black, olive")[0])).alias("i", "v"))
