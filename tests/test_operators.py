import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelweave.functions import text as T
from reelweave.operators import frames as R
from reelweave.operators import geometry as G
from reelweave.operators import latent as L
from reelweave.operators import lists, models, registry, stats, tags
from reelweave.sources import images


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def clean(text):
    """Plain model of text cleaning: rules to a fixed point, twice."""
    for _ in range(2):
        text = re.sub(r"(?<!\d)\.(?!\d)", ". ", text).replace(",", ", ").replace("\n", ". ").replace("\r", "").replace("\t", ", ")
        while True:
            old = text
            for pattern, new in T.CLEANING_RULES:
                text = re.sub(pattern, new, text)
            words = text.split()
            text = " ".join(w for i, w in enumerate(words) if not i or w != words[i - 1])
            if text == old:
                break
    return text


def test_clean_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a b.,\n\t`1 the") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.clean_text(F.col("t")).alias("c")).collect()
    assert [(texts[r.i], r.c) for r in rows if r.c != clean(texts[r.i])] == []


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.batch_prompts(lit(" a .. b\n"), "..")) == ["a", "b"]
    assert one(spark, T.batch_prompts(lit("  "), ",")) == [""]
    assert one(spark, T.batch_prompts(lit("a\nb"), "\\n")) == ["a", "b"]
    assert one(spark, T.batch_prompt(lit("x|y"), "|", 24, 16, 100)) == '"0" :"x",\n"2" :"y"'
    assert one(spark, T.merge_delimited(",", lit("a,b,c"), lit("1,,3,4"), "-")) == "a-1,b,c-3,4"
    assert one(spark, T.replace_text(lit("ab"), lit(0), "", "-", 0)) == "-a-b-" == "ab".replace("", "-")
    assert one(spark, T.replace_text(lit("a.b"), lit(0), ".", "$", 1)) == "a.b"
    assert [one(spark, T.person_kind(lit(s))) for s in ("A Woman", "mention", "tree", " LADY man")] == ["woman", "man", None, "woman"]
    assert [one(spark, T.to_boolean(lit(s))) for s in ("0", "false", "[]", "{}", " ", "x", "null")] == [True, True, False, False, False, True, True]
    assert one(spark, T.to_boolean(lit("0"), lit(0))) is False
    assert [one(spark, c) for c in T.math(lit(-2.7), lit(0), "add")] == [-2.7, -2]
    assert [one(spark, c) for c in T.math(lit(5), lit(0), "divide")] == [0.0, 0]
    assert [one(spark, c) for c in T.math(lit(None), lit(1), "add")] == [0.0, 0]
    assert one(spark, T.character_colours("object", lit(3))) == "#00fc00"
    assert one(spark, T.character_colours("face", lit(1))) == "#fe8080"


def test_tags(spark):
    df = spark.createDataFrame([(1, "(a:0.5),(b:1),(a:0.9),(c:-0.2),(d:0.1),(e:+3)")], "k int, t string")
    assert [(r.tag, r.score) for r in tags.top_tags(df, "k", "t", 0.95, 2).orderBy("rank").collect()] == [("b", 1.0), ("a", 0.9)]
    assert [r.tag for r in tags.negative_tags(df, "k", "t").collect()] == ["c"]


def test_lists(spark):
    a = spark.createDataFrame([(1, i, v) for i, v in enumerate("abc")], "list_id long, pos int, value string")
    b = spark.createDataFrame([(1, i, v) for i, v in enumerate("xy")], "list_id long, pos int, value string")
    rows = lambda df: [tuple(r)[2:] for r in df.orderBy("pos").collect()]
    assert rows(lists.merge_lists(a, b, "-")) == [("a-x",), ("b-y",), ("c",)]
    assert rows(lists.zip_repeat_last(a, b)) == [("a", "x"), ("b", "y"), ("c", "y")]
    assert rows(lists.zip_modulo(a, b)) == [("a", "x"), ("b", "y"), ("c", "x")]
    for broken in (lists.zip_strict(a, b), lists.broadcast_one_or_all(a, b)):
        with pytest.raises(Exception, match="lists differ|one reference"):
            broken.collect()
    assert rows(lists.broadcast_one_or_all(a, b.where("pos = 1").withColumn("pos", F.lit(0)))) == [("a", "x")] * 0 + [("a", "y"), ("b", "y"), ("c", "y")]
    rng = random.Random(7)
    got = [int(r.seed) for r in lists.seeds(spark, 0, 2**64 - 1, "random", 5, 7).orderBy("pos").collect()]
    assert got == [rng.randint(0, 2**64 - 1) for _ in range(5)]
    draw = random.Random(3)
    want = [f"a {draw.choice(['x', 'y'])} b[" for _ in range(4)]
    assert [r.prompt for r in lists.random_prompts(spark, "a [x|y] b[", 4, 3).orderBy("pos").collect()] == want


def plain_prompts(template, n, seed):
    if not template.strip():
        return [""]
    draw, out = random.Random(seed), []
    for _ in range(n):
        text, rest = "", template
        while "[" in rest and "]" in rest[rest.index("[") :]:
            head, _, rest = rest.partition("[")
            block, _, rest = rest.partition("]")
            options = [o.strip() for o in block.split("|") if o.strip()]
            text += head + (draw.choice(options) if options else "")
        out.append((text + rest).strip())
    return out


def test_drawn_lists(spark):
    texts = ["a [x|y] b[", "[one] and [ |p| q|] []", " ", "", None, "] [a\n|b [c] d", "plain"]
    rows = [(i, t, n, s) for i, (t, n, s) in enumerate((t, n, s) for t in texts for n in (0, 1, 7, None) for s in (0, 2**64 - 1, None))]
    df = spark.createDataFrame([(i, t, n, None if s is None else str(s), 5, "kept") for i, t, n, s in rows], "i int, t string, n int, s string, pos int, _given string")
    got = {}
    for r in lists.prompt_lists(df, F.col("t"), F.col("n"), F.col("s")).orderBy("i", "pos").collect():
        assert r["_given"] == "kept"
        got.setdefault(r.i, []).append(r.prompt)
    want = {i: plain_prompts(t or "", n, s or 0) for i, t, n, s in rows if n is not None}
    assert got == {i: p for i, p in want.items() if p}
    big = lists.seed_lists(spark.range(2), F.lit(2**40), F.lit(3), "random", F.lit(lists.PART + 5), F.col("id")).orderBy("id", "pos").collect()
    draws = [random.Random(0), random.Random(1)]
    assert [int(r.seed) for r in big] == [d.randint(3, 2**40) for d in draws for _ in range(lists.PART + 5)]
    odd = spark.createDataFrame([(1, None, 3, 2), (2, 1, 3, 0), (3, 1, 3, None), (4, 3, 1, 4)], "i int, a int, b int, n int")
    for method, found in (("increment", [1, 2, 3, 3]), ("decrement", [3, 2, 1, 1])):
        assert [(r.i, r.pos, int(r.seed)) for r in lists.seed_lists(odd, F.col("a"), F.col("b"), method, F.col("n")).orderBy("pos").collect()] == [(4, k, v) for k, v in enumerate(found)]
    assert lists.seed_lists(odd.limit(0), F.col("a"), F.col("b"), "random", F.col("n")).count() == 0


def test_drawn_queries(spark):
    from reelweave.plans.catalogue import QUERIES

    d = "/root/testdata/sf0.001"
    got = {}
    for r in QUERIES["seed_list_random"](spark, d).orderBy("c_custkey", "pos").collect():
        got.setdefault(r.c_custkey, []).append(int(r.seed))
    keys = [r.c_custkey for r in spark.read.parquet(f"{d}/customer.parquet").collect()]
    assert len(keys) > 50
    assert got == {k: [g.randint(0, 2**64 - 1) for g in [random.Random(k)] for _ in range(4)] for k in keys}
    want = {}
    for p in spark.read.parquet(f"{d}/part.parquet").collect():
        template = f"a [{p.p_name.replace(' ', '|')}], [] [{p.p_type}], by [{p.p_brand}| |no one] [open"
        want[p.p_partkey] = " | ".join(plain_prompts(template, 1 + p.p_size % 5, p.p_partkey))
    assert {r.p_partkey: r.prompts for r in QUERIES["random_prompts"](spark, d).collect()} == want


def seq(spark, n, size=4, seq_id=1, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(seq_id, i, rng.random(size).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "seq_id long, frame_idx long, data array<double>"), np.array([r[2] for r in rows])


def frames_of(df):
    return np.array([r.data for r in df.orderBy("frame_idx").collect()])


def test_frames(spark):
    f, x = seq(spark, 10)
    assert (frames_of(R.take(f, -3)) == x[-3:]).all()
    assert (frames_of(R.take(f, 50, 5)) == x[9:]).all()
    for o, r, last in ((10, 3, False), (24, 16, True), (30, 1, False), (7, 5, True)):
        t, keep, added = 0.0, [], False
        for i in range(10):
            added = t <= i
            if added:
                keep.append(i)
                t += o / r
        if last and not added:
            keep.append(9)
        if o / r > 10:
            keep = list(range(10))
        assert (frames_of(R.reduce_fps(f, o, r, last)) == x[keep]).all()
    g, y = seq(spark, 6, seed=1)
    out = frames_of(R.extend_with_overlap(f, g, 3))
    w = np.array([1, 2, 3])[:, None] / 4
    assert np.allclose(out, np.concatenate([x[:7], (1 - w) * x[7:] + w * y[:3], y[3:]]))
    assert (frames_of(R.extend_with_overlap(f, g, 3, "cut", "new_images")) == np.concatenate([x, y[3:]])).all()
    with pytest.raises(Exception, match="overlap longer"):
        R.extend_with_overlap(f, g, 7).collect()
    assert len(frames_of(R.interpolate(f, 4))) == 9 * 4 + 1
    with pytest.raises(ValueError):
        R.loop_windows(f, 5, 17)


def test_lab_round_trip(spark):
    f, x = seq(spark, 4, 6)
    g, _ = seq(spark, 4, 6)
    assert np.allclose(frames_of(R.extend_with_overlap(f, g, 4, "perceptual_crossfade")), x, atol=2e-3)


@pytest.mark.parametrize(("skip", "part"), [(10 / 3, 7), (1.7, 16), (1.0, 5), (0.4, 9), (24 / 23.976, 64), (50.0, 8), (3.0, 10)])
def test_kept_frames_in_parts(spark, skip, part):
    total, keep = 0.0, []
    for i in range(403):
        keep.append(total <= i)
        total += skip if keep[-1] else 0.0
    got = R.kept_frames(spark.createDataFrame([(403,)], "n long"), skip, part).orderBy("source_idx").collect()
    assert [r.source_idx for r in got] == list(range(403)) and [r.kept for r in got] == keep
    assert [r["rank"] for r in got] == [sum(keep[:i]) for i in range(403)]
    assert R.kept_frames(spark.createDataFrame([(None,)], "n long"), skip, part).count() == 0


def test_zips_with_one_short_side(spark):
    rows = lambda df: [tuple(r)[1:] for r in df.orderBy("pos").collect()]
    long = spark.createDataFrame([(1, i, f"a{i}") for i in range(301)], "list_id long, pos int, value string")
    for n in (1, 2, 7, 300):
        short = spark.createDataFrame([(1, i, f"b{i}") for i in range(n)], "list_id long, pos int, value string")
        want = [(i, f"a{i}", f"b{min(i, n - 1)}") for i in range(301)]
        assert rows(lists.zip_repeat_last(long, short)) == want
        assert rows(lists.zip_repeat_last(short, long)) == [(i, b, a) for i, a, b in want]
        assert rows(lists.zip_modulo(long, short)) == [(i, f"a{i}", f"b{i % n}") for i in range(301)]
        assert rows(lists.zip_modulo(short, long)) == [(i, f"b{i}", f"a{i}") for i in range(n)]


def test_smoothing_of_many_sequences(spark):
    rng = np.random.default_rng(4)
    rows = [(s, t, float(rng.random())) for s, n in ((None, 30), (1, 1), (2, 97), (3, 8), (4, 16)) for t in range(n)] + [(5, 0, 1.0), (5, 1, None), (5, 2, 2.0)]
    df = spark.createDataFrame(rows, "s int, t int, v double").repartition(5)
    got = {(r.s, r.t): r.smoothed for r in stats.smooth(df, "s", ["t"], "v", 0.6, chunk=4).collect()}
    last, want = {}, {}
    for s, t, v in rows:
        y = v if t == 0 else None if v is None or last[s] is None else 0.4 * v + 0.6 * last[s]
        last[s] = want[s, t] = y
    assert got.keys() == want.keys()
    assert all(got[k] is None if y is None else abs(got[k] - y) < 1e-12 for k, y in want.items())
    assert stats.smooth(df.limit(0), "s", ["t"], "v", 0.6).count() == 0


def test_smoothing_in_chunks(spark):
    rng = np.random.default_rng(2)
    v = rng.random(57)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)] + [(2, 0, 5.0)], "s int, t int, v double")
    got = {(r.s, r.t): r.smoothed for r in stats.smooth(df, "s", ["t"], "v", 0.7, chunk=8).collect()}
    y = v[0]
    for i in range(57):
        y = v[i] if i == 0 else 0.3 * v[i] + 0.7 * y
        assert abs(got[1, i] - y) < 1e-12
    assert got[2, 0] == 5.0


def test_colour_match():
    rng = np.random.default_rng(0)
    t, r = rng.random((500, 3)) * 0.3 + 0.2, rng.random((400, 3)) @ np.array([[0.4, 0.1, 0], [0, 0.3, 0.1], [0.1, 0, 0.3]]) + 0.2
    for method in ("mkl", "mvgd", "reinhard", "hm", "hm-mkl-hm", "hm-mvgd-hm"):
        out = stats.colour_match(t, r, method)
        assert np.allclose(out.mean(0), r.mean(0), atol=0.02)
        if method in ("mkl", "mvgd"):
            assert np.allclose(np.cov(out.T), np.cov(r.T), atol=2e-3)
    assert np.allclose(stats.colour_match(t, r, "mkl", 0.0), t)


def test_latents(spark):
    df = spark.createDataFrame([([float(i) for i in range(40)],)], "d array<double>")
    back = df.select(L.convert_fixed(L.convert_fixed(F.col("d"), 20), 20, inverse=True).alias("d")).first().d
    assert np.allclose(back, np.arange(40))
    again = df.select(L.convert_normalised(L.convert_normalised(F.col("d")), inverse=True).alias("d")).first().d
    assert np.allclose(again, np.arange(40))
    x = np.linspace(-1, 1, 30)
    e = spark.createDataFrame([(1, i, float(a), float(2 * a * a - a + 3)) for i, a in enumerate(x)], "k int, i int, x double, y double")
    assert np.allclose(list(L.quadratic(e, ["k"]).first())[1:], [2, -1, 3])
    errors = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.7)], "k int, method string, error double")
    assert L.best_fit(errors, ["k"]).first().method == "a"


def test_geometry(spark):
    assert G.parse_colours('["#FFFFFF, 16", "#000000"]') == [[16777215, 16], [0]]
    assert G.parse_colours(" #0000ff ,\n 7") == [[255, 7]]
    empty = spark.createDataFrame([([0.0] * 9,)], "m array<double>").select(G.crop_box(G.mask_box(F.col("m"), 3)).alias("b")).first().b
    assert tuple(empty) == (0, 0, 8, 8)
    rng = np.random.default_rng(1)
    x = rng.random(64)
    df = spark.createDataFrame([(1, 0, x.tolist())], "seq_id long, frame_idx long, data array<double>")
    flat = spark.createDataFrame([(1, 0, [0.3] * 64)], "seq_id long, frame_idx long, data array<double>")
    assert np.allclose(frames_of(G.sharpen(flat, 8, 8, 1, 1.0, 0.5)), 0.3)
    assert (frames_of(G.sharpen(df, 8, 8, 0, 1.0, 0.5)) == x).all()
    pose = '[{"canvas_height":10,"canvas_width":20,"people":[{"pose_keypoints_2d":[1,2,1,3,4,1,5,6,0.5],"face_keypoints_2d":[]}]}]'
    points = G.pose_keypoints(spark.createDataFrame([(pose,)], "t string"), "t")
    assert [(r.k, r.x) for r in points.orderBy("k").collect()] == [(0, 1.0), (1, 3.0), (2, None)]
    assert [(r.limb, r.x1, r.x2) for r in G.pose_limbs(points, spark).collect()] == [(12, 3.0, 1.0)]


def test_feathered_tiles_give_the_picture_back(spark):
    size = spark.createDataFrame([(13, 9)], "h int, w int")
    for mode in ("linear", "cosine", "smoothstep", "gaussian"):
        t = G.tiles(size, 5, 3).withColumn("ly", F.explode(F.expr("sequence(0, y1 - y0 - 1)"))).withColumn("lx", F.explode(F.expr("sequence(0, x1 - x0 - 1)")))
        w = G.feather(F.col("ly"), F.expr("y1 - y0"), F.expr("y0 = 0"), F.expr("y1 >= h"), 2, mode, 1.5) * G.feather(F.col("lx"), F.expr("x1 - x0"), F.expr("x0 = 0"), F.expr("x1 >= w"), 2, mode, 1.5)
        px = t.select(F.expr("y0 + ly").alias("y"), F.expr("x0 + lx").alias("x"), w.alias("weight")).withColumn("v", F.expr("y * 100.0 + x").cast("double"))
        rows = G.merge_tiles(px, []).collect()
        assert len(rows) == 13 * 9
        assert all(abs(r.v - (r.y * 100 + r.x)) < 1e-6 for r in rows)


def test_images(spark, tmp_path):
    x = np.random.default_rng(0).random((3, 5, 4, 3))
    f = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "frame_idx long, data array<double>")
    where = f"file://{tmp_path}/out"
    assert images.save_frames(images.encode_frames(f, "shot", 5, 4, 3, start=7), where).count() == 3
    back = images.load_frames(images.scan(spark, where, "shot", start=7, count=2)).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in back] == [7, 8]
    assert np.allclose(np.array(back[0].data), np.floor(x[0].ravel() * 255) / 255)
    saved = images.Saved()
    saved.add(where, "shot")
    assert saved.delete(dry_run=True)["files_deleted"] == 3
    assert saved.delete()["files_deleted"] == 3
    assert saved.patterns == []
    assert spark.read.format("image").load(images_dir(spark, tmp_path, x)).select("image.height").first()[0] == 5


def images_dir(spark, tmp_path, x):
    (tmp_path / "jvm").mkdir()
    (tmp_path / "jvm" / "a.png").write_bytes(images.encode_png(x[0]))
    return f"file://{tmp_path}/jvm"


def test_models_and_registry(spark):
    a = spark.createDataFrame([(1, 0, "p"), (1, 1, "q")], "list_id long, pos int, value string")
    plan = models.sampler_plan(a, a.where("pos = 0"), 2**64 - 1, "increment")
    assert [int(r.seed) for r in plan.orderBy("pos").collect()] == [2**64 - 1, 2**64]
    out = models.encode_texts(a, lambda s: s.map(lambda t: [float(len(t)), zlib.crc32(t.encode()) % 7]))
    assert out.count() == 2 and out.first().emb[0] == 1.0
    assert models.decode_params(64, 32, 8, 8)["overlap"] == 2
    assert registry.apply("text.strip", F.lit(" a ")) is not None
    names = [r.option for r in registry.options(registry.catalogue(spark), "lists").collect()]
    assert names == sorted(names, key=str.lower) and "zip_longest" in names


def test_corrected_streams_frames(spark):
    rng = np.random.default_rng(5)
    data = {(q, t): rng.random(4) for q in (1, 2, None) for t in range(23)}
    df = spark.createDataFrame([(q, t, x.tolist()) for (q, t), x in data.items()], "seq_id long, frame_idx long, data array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = stats.corrected(df, 0.8)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r.seq_id, r.frame_idx): r.data for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in plan and len(got) == len(data)
    for q in (1, 2, None):
        last = []
        for t in range(23):
            x = data[q, t]
            if last:
                ref = np.mean(last[-5:], axis=0)
                x = np.clip(x + 0.8 * ((x - x.mean()) / max(x.std(), 1e-6) * ref.std() + ref.mean() - x), 0, 1)
            last.append(x)
            assert np.allclose(got[q, t], x)


def test_json_items_of_any_text(spark):
    want = {'{"b": 1, "a": null}': ["1", "None"], '["x", 2.5, false, {"k": 1}]': ["x", "2.5", "False", '{"k":1}'], "[]": [], "true": ["True"], "12": ["12"], '"q"': ["q"], "a [b": ["a [b"], "[1,": ["[1,"], "": [""], None: None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.v for r in df.select("t", T.json_items(F.col("t")).alias("v")).collect()} == want


def test_box_texts_like_plain_rounding(spark):
    values = [0.0, 1e-06, 1.2e-05, 9.9e-05, 0.0001, 0.00099, 0.05, 0.5, 0.123456, 0.1, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", G._number_text(F.col("v")).alias("s"))
    assert [(r.v, r.s) for r in df.collect() if r.s != str(r.v)] == []
    texts = {'{"x": 1, "y": 1, "width": 2, "height": 9}': ["0.25,0.25,0.75,1.0"], '[{"x1": 0, "y1": 0, "x2": 4, "y2": 1}]': ["0.0,0.0,1.0,0.25"], "[[[1, 2, 1, 1]], []]": ["0.25,0.5,0.5,0.75"], "[]": [], "": [], None: []}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in df.select("t", G.box_texts(G.parse_boxes(F.col("t")), 4.0, 4.0, 6).alias("v")).collect()} == texts
    assert df.select(G.box_texts(G.parse_boxes(F.col("t")), 4.0, 4.0, 6, 3).alias("v")).where(F.size("v") > 0).count() == 0


def test_conversions_without_spread(spark):
    e = spark.createDataFrame([(1, i, 2.0, float(i)) for i in range(4)] + [(2, i, float(i), 3.0 * i - 1) for i in range(4)], "k int, i int, x double, y double")
    rows = {(r.k, r.method): r for r in L.conversion_errors(e, ["k"]).collect()}
    assert all(rows[1, m].error is None and rows[1, m].grade is None for m in ("linear", "normalise", "quadratic", "range"))
    assert rows[2, "linear"].grade == "excellent" and rows[2, "range"].error < 1e-9
    best = {r.k: r for r in L.best_fit(L.conversion_errors(e, ["k"]), ["k"]).withColumn("verdict", L.feasibility(F.col("error"))).collect()}
    assert best[2].verdict == "excellent" and best[1].error is None and best[1].verdict is None
    assert L.conversion_errors(e.limit(0), ["k"]).count() == 0


def test_stabilised_pictures(spark):
    rng = np.random.default_rng(5)
    grey = rng.random((3, 6, 7, 1))
    one, three = stats.stabilised(grey), stats.stabilised(np.repeat(grey, 3, axis=3))
    assert np.allclose(np.repeat(one, 3, axis=3), three)
    middle = np.full((1, 5, 5, 3), 0.5)
    assert (stats.stabilised(middle) == middle).all()
    dark = stats.stabilised(np.full((1, 5, 5, 3), 0.1))
    assert np.allclose(dark, 0.1 + 0.75 * 0.1 * (0.2 / 0.3 * 0.2 * 0.8))
    df = spark.createDataFrame([(1, 0, grey[0].ravel().tolist())], "seq_id long, frame_idx long, data array<double>")
    assert np.allclose(frames_of(stats.stabilise(df, 6, 7)), one[0].ravel())
    assert stats.stabilise(df.limit(0), 6, 7).count() == 0


def test_colour_names():
    assert G.parse_colours('["red, Navy"]')[0] == [0xFF0000, 0x80]
    with pytest.raises(ValueError):
        G.parse_colours("nocolour")


def test_slots_and_padding(spark):
    items = spark.createDataFrame([("a", 0, 0, 5.0), ("a", 0, 1, 6.0), ("a", 1, 0, None), ("b", 0, 0, 7.0)], "k string, f int, s int, v double")
    got = sorted((r.k, r.f, r.s, str(r.v)) for r in G.fill_slots(items, ["k"], "f", "s", {"v": F.lit(0.0)}).collect())
    assert got == [("a", 0, 0, "5.0"), ("a", 0, 1, "6.0"), ("a", 1, 0, "None"), ("a", 1, 1, "0.0"), ("b", 0, 0, "7.0")]
    sized = spark.createDataFrame([(1, 1, 2, [1.0, 2.0]), (1, 2, 1, [3.0, 4.0])], "k int, h int, w int, data array<double>")
    assert sorted(r.data for r in G.pad_to_largest(sized, ["k"]).collect()) == [[1.0, 2.0, 0.0, 0.0], [3.0, 0.0, 4.0, 0.0]]
