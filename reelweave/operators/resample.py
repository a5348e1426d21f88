"""Pictures resampled by tables of weights: each output place is a weighted sum of a few source places.

Rows are resampled first, then columns, so an output value costs two short sums.  The tables depend on the sizes only;
they are literals of the plan, and nothing is shuffled.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelweave.functions.text import bound

_TAPS = "array<array<struct<i:int,w:double>>>"


def _cubic(d: float, a: float = -0.75) -> float:
    d = abs(d)
    return (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0.0


def _sinc(x: float) -> float:
    return math.sin(math.pi * x) / (math.pi * x) if x else 1.0


def taps(n: int, m: int, method: str) -> list[list[tuple[int, float]]]:
    """(source place, weight) for each of m places resampled from n.

    'bicubic' takes four places around each centre, edges repeated; 'lanczos' widens with the scale, so that
    shrinking averages, and is normalised.
    """
    scale, out = n / m, []
    for o in range(m):
        centre = (o + 0.5) * scale
        if method == "bicubic":
            low = math.floor(centre - 0.5)
            out.append([(min(max(low + k, 0), n - 1), _cubic(centre - 0.5 - low - k)) for k in range(-1, 3)])
        elif method == "lanczos":
            wide = max(scale, 1.0)
            places = range(max(int(centre - 3 * wide + 0.5), 0), min(int(centre + 3 * wide + 0.5), n))
            weights = [_sinc(x) * _sinc(x / 3) if abs(x) < 3 else 0.0 for x in ((i - centre + 0.5) / wide for i in places)]
            out.append([(i, w / sum(weights)) for i, w in zip(places, weights, strict=True)])
        else:
            raise ValueError(method)
    return out


def _table(n: int, m: int, method: str) -> Column:
    return F.from_json(F.lit(json.dumps([[{"i": i, "w": w} for i, w in row] for row in taps(n, m, method)])), _TAPS)


def resample(data: Column, h: int, w: int, oh: int, ow: int, method: str, c: int = 1) -> Column:
    """Picture (h, w, c) brought to (oh, ow, c); 'lanczos' rounds to 255 levels before, between and after the passes, as it is defined on bytes."""
    levels = method == "lanczos"
    whole = (lambda v: F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(255)).cast("double")) if levels else (lambda v: v)

    def along(d: Column, table: Column, n: int, at, total: int) -> Column:
        def cell(i):
            return whole(F.aggregate(F.element_at(table, at(i)[0] + 1), F.lit(0.0), lambda s, t: s + t["w"] * F.element_at(d, (at(i)[1](t["i"]) + 1).cast("int"))))

        return F.transform(F.sequence(F.lit(0), F.lit(total - 1)), cell)

    def across(i):
        y, x, k = F.floor(i / (ow * c)), F.floor(i / c) % ow, i % c
        return x.cast("int"), lambda s: (y * w + s) * c + k

    def down(i):
        y, rest = F.floor(i / (ow * c)), i % (ow * c)
        return y.cast("int"), lambda s: s * (ow * c) + rest

    start = F.transform(data, lambda v: F.floor(F.least(F.greatest(v * 255, F.lit(0.0)), F.lit(255.0))).cast("double")) if levels else data
    rows = bound(start, lambda d: along(d, _table(w, ow, method), w, across, h * ow * c))
    out = bound(rows, lambda d: along(d, _table(h, oh, method), h, down, oh * ow * c))
    return F.transform(out, lambda v: v / 255) if levels else out


def scale(data: Column, h: int, w: int, width: int, height: int, method: str, crop: bool = False, c: int = 1) -> tuple[Column, int, int]:
    """(picture, height, width) scaled to a size; 0 for one side keeps the shape, for both the picture.

    With ``crop`` the source is first cut around its middle to the target's shape, to one row or column at least.
    """
    if not width and not height:
        return data, h, w
    width = width or max(1, round(w * height / h))
    height = height or max(1, round(h * width / w))
    if crop:
        x = min(round((w - w * (width / height) / (w / h)) / 2), (w - 1) // 2) if w / h > width / height else 0
        y = min(round((h - h * (w / h) / (width / height)) / 2), (h - 1) // 2) if w / h < width / height else 0
        source, sw = data, w
        row = lambda r: F.slice(source, ((r + y) * sw + x) * c + 1, (sw - 2 * x) * c)
        data = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 2 * y - 1)), row))
        h, w = h - 2 * y, w - 2 * x
    return resample(data, h, w, height, width, method, c), height, width
