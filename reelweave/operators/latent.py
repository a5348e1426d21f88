"""Latent vectors as rows with one array of numbers; element i belongs to channel i % channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slope and intercept of the affine map between two latent spaces, channels 0 to 15.
CHANNEL_PARAMS = [
    (0.345731, 0.266601), (0.668525, 0.514007), (0.424411, 0.389445), (0.373739, -0.033028),
    (0.822565, 0.159338), (0.552002, -0.529137), (0.374092, 0.064140), (0.484338, -0.763688),
    (0.300309, -0.120046), (0.465372, 0.066264), (0.339786, -0.189196), (0.617863, 0.242260),
    (0.608520, 0.123674), (0.876538, 0.838254), (0.352272, -0.079095), (0.524633, 0.163276),
]
#: Mean and deviation of the first and of the second latent space.
NORMALS = (-0.224886, 1.868329, -0.084378, 0.752230)


def convert_fixed(data: Column, channels: int, inverse: bool = False) -> Column:
    """The fixed affine map of each channel; channels from 16 on use channel 15's."""
    a = F.array(*[F.lit(x) for x, _ in CHANNEL_PARAMS])
    b = F.array(*[F.lit(x) for _, x in CHANNEL_PARAMS])
    ch = lambda i: F.least(i % channels, F.lit(len(CHANNEL_PARAMS) - 1)) + 1
    if inverse:
        return F.transform(data, lambda x, i: (x - F.element_at(b, ch(i))) / F.element_at(a, ch(i)))
    return F.transform(data, lambda x, i: x * F.element_at(a, ch(i)) + F.element_at(b, ch(i)))


def convert_normalised(data: Column, inverse: bool = False) -> Column:
    """Standardised in one space, spread out in the other."""
    m1, s1, m2, s2 = NORMALS if not inverse else (*NORMALS[2:], *NORMALS[:2])
    return F.transform(data, lambda x: (x - m1) / s1 * s2 + m2)


def pairs(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, i, x, y): the elements of two arrays side by side."""
    z = F.posexplode(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y"))).alias("i", "z")
    return rows.select(*keys, z).select(*keys, "i", F.col("z.x").cast("double").alias("x"), F.col("z.y").cast("double").alias("y"))


def learned_params(elements: DataFrame, channels: int) -> DataFrame:
    """(ch, a, b): least-squares line of y on x for each channel; without spread, deviations and means."""
    g = elements.groupBy((F.col("i") % channels).alias("ch"))
    fit = g.agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.coalesce("a", F.try_divide(F.col("sy"), F.col("sx")), F.lit(1.0))
    return fit.select("ch", slope.alias("a"), F.coalesce("b", F.col("my") - slope * F.col("mx")).alias("b"))


def apply_params(elements: DataFrame, params: DataFrame, channels: int) -> DataFrame:
    """x mapped by its channel's line; params has one row for each channel, so it is broadcast."""
    at = elements.withColumn("ch", F.col("i") % channels)
    return at.join(F.broadcast(params), "ch").withColumn("converted", F.col("a") * F.col("x") + F.col("b"))


def compare(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges, moments, differences, line and correlation of x and y for each key, with grades."""
    gap = F.abs(F.col("x") - F.col("y"))
    out = elements.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{name}_{c}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))],
        F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"), F.bool_and(F.col("x") == F.col("y")).alias("equal"),
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("corr"),
    )
    grade = F.when(F.col("max_diff") < 1e-6, "identical").when(F.col("max_diff") < 1e-4, "very close").otherwise("different")
    return out.withColumn("grade", grade)


def quadratic(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c2, c1, c0): least-squares parabola from moment sums, solved by Cramer's rule."""
    s = lambda p, q: F.sum(F.pow(F.col("x"), F.lit(float(p))) * (F.col("y") if q else F.lit(1.0)))
    m = elements.groupBy(*keys).agg(*[s(p, 0).alias(f"s{p}") for p in range(5)], *[s(p, 1).alias(f"t{p}") for p in range(3)])

    def det(c):
        (a, b, d), (e, f, g), (h, i, j) = c
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    rows = [[F.col(f"s{4 - r - c}") for c in range(3)] for r in range(3)]
    right = [F.col(f"t{2 - r}") for r in range(3)]
    whole = det(rows)
    return m.select(*keys, *[F.try_divide(det([[right[r] if c == k else rows[r][c] for c in range(3)] for r in range(3)]), whole).alias(f"c{2 - k}") for k in range(3)])


def channel_correlations(elements: DataFrame, keys: list[str], channels: int) -> DataFrame:
    """(keys, ch, corr, mean_x, mean_y, std_x, std_y): x and y compared channel by channel, over all elements."""
    by = elements.groupBy(*keys, (F.col("i") % channels).alias("ch"))
    return by.agg(F.corr("x", "y").alias("corr"), *[f(c).alias(f"{name}_{c}") for name, f in (("mean", F.avg), ("std", F.stddev_samp)) for c in ("x", "y")])


def mean_correlation(elements: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    """(keys, corr): correlation of the means that x and y have in each cell.

    Cells of channel and place average over time and show the spatial pattern, cells of frame and
    channel the temporal one.
    """
    means = elements.groupBy(*keys, *cells).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return means.groupBy(*keys).agg(F.corr("x", "y").alias("corr"))


def correlation_grade(corr: Column) -> Column:
    """How far a line can carry one latent into the other."""
    return F.when(F.abs(corr) > 0.9, "strong").when(F.abs(corr) > 0.7, "moderate").otherwise("weak")


def conversion_errors(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, method, error, mean_error, grade) of four ways from x to y.

    'linear' and 'quadratic' are least-squares fits, 'normalise' carries mean and deviation over, 'range'
    the least and the largest value.  A key without spread has null errors where a method divides by it.
    """
    moments = elements.groupBy(*keys).agg(
        *[f(c).alias(f"_{name}_{c}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))],
        F.regr_slope("y", "x").alias("_slope"), F.regr_intercept("y", "x").alias("_intercept"),
    )
    fits = moments.join(quadratic(elements, keys), keys)
    x, c = F.col("x"), F.col
    converted = {
        "linear": c("_slope") * x + c("_intercept"),
        "normalise": F.try_divide(x - c("_mean_x"), c("_std_x")) * c("_std_y") + c("_mean_y"),
        "quadratic": (c("c2") * x + c("c1")) * x + c("c0"),
        "range": F.try_divide(x - c("_min_x"), c("_max_x") - c("_min_x")) * (c("_max_y") - c("_min_y")) + c("_min_y"),
    }
    gaps = elements.join(fits, keys).select(*keys, *[F.abs(v - F.col("y")).alias(name) for name, v in converted.items()])
    sums = gaps.groupBy(*keys).agg(*[F.struct(F.lit(name).alias("method"), F.max(name).alias("error"), F.avg(name).alias("mean_error")).alias(name) for name in converted])
    rows = sums.select(*keys, F.inline(F.array(*converted)))
    error = F.col("error")
    return rows.withColumn("grade", F.when(error < 0.001, "excellent").when(error < 0.01, "good").when(error < 0.1, "usable").when(error.isNotNull(), "poor"))


def feasibility(error: Column) -> Column:
    """Verdict on the least error that any method reaches."""
    return F.when(error < 0.01, "excellent").when(error < 0.1, "moderate").when(error < 1.0, "poor").when(error.isNotNull(), "incompatible")


def best_fit(errors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, method, error): the method of least error, the first name on ties; methods without an error come last."""
    least = F.struct(F.col("error").isNull().alias("none"), "error", "method")
    return errors.groupBy(*keys).agg(F.min(least).alias("m")).select(*keys, "m.method", "m.error")


def to_batch(parts: DataFrame, order: list[str]) -> DataFrame:
    """Rows (list_id, part, b, samples, batch_index) of all parts as one batch: b counts through.

    A part without its own batch_index gets the numbers behind those before it.
    """
    w = Window.partitionBy("list_id").orderBy(*order)
    at = F.row_number().over(w) - 1
    return parts.withColumn("batch_index", F.coalesce(F.col("batch_index"), at).cast("long")).withColumn("b", at.cast("long"))


def to_list(batch: DataFrame) -> DataFrame:
    """Each latent of a batch as a list item of its own."""
    return batch.withColumn("pos", F.col("b")).withColumn("b", F.lit(0).cast("long"))


def split_batches(latents: DataFrame) -> DataFrame:
    """(latent_id, item, samples, noise_mask, batch_index): a row for each item of batched latents.

    A single mask serves all items, and the last mask or index those behind it; without any they are null.
    """
    rows = latents.select("latent_id", "noise_mask", "batch_index", F.posexplode("samples").alias("item", "samples"))
    last = lambda c: F.least(F.col("item"), F.size(c) - 1)
    return rows.select("latent_id", "item", "samples", *[F.when(F.size(c) > 0, F.get(F.col(c), last(c))).alias(c) for c in ("noise_mask", "batch_index")])


def merge_outputs(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Items of a key as one batch: indices count through, masks stay where every item has one.

    A key's only item stays as it is.
    """
    w = Window.partitionBy(*keys)
    n, masked = F.count("*").over(w), F.count("noise_mask").over(w)
    at = (F.row_number().over(w.orderBy(*order)) - 1).cast("long")
    return items.withColumns({"batch_index": F.when(n == 1, F.col("batch_index")).otherwise(at), "noise_mask": F.when(masked == n, F.col("noise_mask"))})


def rescale(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value moved to [0, 1] by the least and the largest of its group."""
    m = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spread = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-8))
    return rows.join(m, keys).withColumn(value, (F.col(value) - F.col("_lo")) / spread).drop("_lo", "_hi")


def preview_rgb(elements: DataFrame, factors: DataFrame, channels: int) -> DataFrame:
    """(vec_id, pixel, rgb, level): latents as pixels by a linear map, 0 to 255; factors is (ch, rgb, w)."""
    at = elements.withColumns({"ch": F.col("i") % channels, "pixel": F.floor(F.col("i") / channels)})
    mixed = at.join(F.broadcast(factors), "ch").groupBy("vec_id", "pixel", "rgb").agg(F.sum(F.col("x") * F.col("w")).alias("v"))
    return mixed.select("vec_id", "pixel", "rgb", F.least(F.greatest(F.bround((F.col("v") + 1) * 127.5), F.lit(0.0)), F.lit(255.0)).cast("int").alias("level"))
