"""Resampling: shrinks, kernel reductions, affine and mapped transforms, thumbnails."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..raster import Raster, grid, is_int, saturate
from . import conversion


def _half_up(v: float) -> int:
    return int(math.floor(v + 0.5))


def _box(r: Raster, axis: str, factor: int, ceil: bool) -> Raster:
    """Means of ``factor`` neighbours along one axis; the last pixel stands for what is missing at the edge."""
    size = r.width if axis == "x" else r.height
    out = math.ceil(size / factor) if ceil else _half_up(size / factor)
    other = "y" if axis == "x" else "x"
    # How many times each pixel counts: the last one also for the taps beyond the edge.
    last = out * factor - (size - 1)
    times = F.when(F.col(axis) == size - 1, F.lit(max(1, last))).otherwise(F.lit(1))
    cell = F.expr(f"cast({axis} div {factor} as int)")
    kind = "long" if is_int(r.format) else "double"
    sums = r.df.where(cell < out).groupBy(*r.keys, cell.alias(axis), other).agg(*[F.sum(c.cast(kind) * times).alias(n) for c, n in zip(r.cols, r.names)])
    values = [F.floor((c + factor // 2) / factor) if is_int(r.format) else c / factor for c in r.cols]
    head = {"width": out} if axis == "x" else {"height": out}
    return r.having(sums, **head).with_bands(values)


def shrinkh(r: Raster, factor: int, ceil=False) -> Raster:
    return _box(r, "x", factor, ceil) if factor > 1 else r


def shrinkv(r: Raster, factor: int, ceil=False) -> Raster:
    return _box(r, "y", factor, ceil) if factor > 1 else r


def shrink(r: Raster, hshrink: float, vshrink: float, ceil=False) -> Raster:
    if hshrink == int(hshrink) and vshrink == int(vshrink):
        return shrinkh(shrinkv(r, int(vshrink), ceil), int(hshrink), ceil)
    return reduce_(r, hshrink, vshrink, "linear")


# --- kernels: functions of the distance, and their half widths ---------------------------------------------------

def _cubic(b: float, c: float):
    def f(x):
        x = abs(x)
        if x <= 1:
            return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + (6 - 2 * b)) / 6
        if x <= 2:
            return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6
        return 0.0

    return f


def _sinc(x):
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)


def _lanczos(n):
    return lambda x: _sinc(x) * _sinc(x / n) if abs(x) <= n else 0.0


def _mks2013(x):
    x = abs(x)
    return 17 / 16 - 7 * x * x / 4 if x < 0.5 else (4 * x * x - 11 * x + 7) / 4 if x < 1.5 else -((x - 2.5) ** 2) / 8 if x < 2.5 else 0.0


def _mks2021(x):
    x = abs(x)
    if x < 0.5:
        return 577 / 576 - 239 * x * x / 144
    if x < 1.5:
        return (140 * x * x - 379 * x + 239) / 144
    if x < 2.5:
        return -(24 * x * x - 113 * x + 130) / 144
    if x < 3.5:
        return (4 * x * x - 27 * x + 45) / 144
    return -((2 * x - 9) ** 2) / 1152 if x < 4.5 else 0.0


KERNELS = {"nearest": (lambda x: 1.0 if -0.5 <= x < 0.5 else 0.0, 0.5), "linear": (lambda x: max(0.0, 1 - abs(x)), 1.0), "cubic": (_cubic(0.0, 0.5), 2.0), "mitchell": (_cubic(1 / 3, 1 / 3), 2.0),
           "lanczos2": (_lanczos(2), 2.0), "lanczos3": (_lanczos(3), 3.0), "mks2013": (_mks2013, 2.5), "mks2021": (_mks2021, 4.5)}


def taps(size: int, factor: float, kernel: str) -> tuple[int, list[tuple[int, int, float]]]:
    """(output size, (input, output, weight)): a table of size * kernel rows, made on the driver and broadcast."""
    fn, half = KERNELS[kernel]
    out = _half_up(size / factor)
    offset = (1 + size - out * factor) / 2.0 - 1 if kernel != "nearest" else (size - out * factor) / 2.0
    rows = []
    for o in range(out):
        centre = (o + 0.5) * factor - 0.5 + (offset + 0.5 if kernel != "nearest" else offset)
        lo, hi = math.floor(centre - half * factor), math.ceil(centre + half * factor)
        ws = [(i, fn((i - centre) / factor)) for i in range(lo, hi + 1)]
        if kernel == "nearest":
            ws = [(int(math.floor(centre + 0.5)), 1.0)]
        total = sum(w for _, w in ws)
        held: dict[int, float] = {}
        for i, w in ws:
            i = min(size - 1, max(0, i))
            held[i] = held.get(i, 0.0) + w / total
        rows += [(i, o, w) for i, w in held.items() if w]
    return out, rows


def _reduce(r: Raster, axis: str, factor: float, kernel: str) -> Raster:
    if factor == 1:
        return r
    size, rows = taps(r.width if axis == "x" else r.height, factor, kernel)
    table = F.broadcast(r.df.sparkSession.createDataFrame(rows, "_i int, _o int, _w double"))
    other = "y" if axis == "x" else "x"
    joined = r.df.join(table, F.col(axis) == F.col("_i"))
    sums = joined.groupBy(*r.keys, F.col("_o").alias(axis), other).agg(*[F.sum(c.cast("double") * F.col("_w")).alias(n) for c, n in zip(r.cols, r.names)])
    head = {"width": size} if axis == "x" else {"height": size}
    return r.having(sums, **head).with_bands([saturate(F.floor(c + 0.5), r.format) if is_int(r.format) else c for c in r.cols])


def reduceh(r: Raster, factor: float, kernel="lanczos3") -> Raster:
    return _reduce(r, "x", factor, kernel)


def reducev(r: Raster, factor: float, kernel="lanczos3") -> Raster:
    return _reduce(r, "y", factor, kernel)


def reduce_(r: Raster, hshrink: float, vshrink: float, kernel="lanczos3") -> Raster:
    return reduceh(reducev(r, vshrink, kernel), hshrink, kernel)


# --- mapped transforms -------------------------------------------------------------------------------------------

def _catmull(t: Column) -> list[Column]:
    return [(-t + 2 * t * t - t * t * t) / 2, (2 - 5 * t * t + 3 * t * t * t) / 2, (t + 4 * t * t - 3 * t * t * t) / 2, (-t * t + t * t * t) / 2]


def _bspline(t: Column) -> list[Column]:
    """Quadratic B-spline weights around the nearest pixel, t in -0.5..0.5."""
    return [(0.5 - t) * (0.5 - t) / 2, 0.75 - t * t, (0.5 + t) * (0.5 + t) / 2]


INTERPOLATORS = ("nearest", "bilinear", "bicubic", "vsqbs", "lbb", "nohalo")


def sample(r: Raster, at: DataFrame, interpolate="bilinear", background=0.0, width=None, height=None) -> Raster:
    """Values at real coordinates (u, v) of output pixels (x, y), of each image: ``at`` has the keys of ``r``.

    An output pixel explodes into its taps, joins the input on integer coordinates and adds
    up weights: one equi-join and one aggregate, whatever the transform.  Taps are added from left
    to right and down each column, in whatever order they arrive, so that equal runs round equally.  Coordinates outside
    the input give the background.  lbb and nohalo are bicubic whose result is limited to the
    range of the four nearest pixels, which takes the halo away.
    """
    w, h = r.width, r.height
    limited = interpolate in ("lbb", "nohalo")
    kind = "bicubic" if limited else interpolate
    inside = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") <= w - 1) & (F.col("v") <= h - 1)
    base = at.withColumn("_in", inside)
    if kind in ("nearest", "vsqbs"):
        iu, iv = F.floor(F.col("u") + 0.5), F.floor(F.col("v") + 0.5)
    else:
        iu, iv = F.floor("u"), F.floor("v")
    tu, tv = F.col("u") - iu, F.col("v") - iv
    weights = {"nearest": lambda t: [F.lit(1.0)], "bilinear": lambda t: [1 - t, t], "bicubic": _catmull, "vsqbs": _bspline}[kind]
    first = {"nearest": 0, "bilinear": 0, "bicubic": -1, "vsqbs": -1}[kind]
    wu, wv = weights(tu), weights(tv)
    tap = lambda i, j: F.struct(F.greatest(F.lit(0), F.least(F.lit(w - 1), iu + first + i)).cast("int").alias("tx"), F.greatest(F.lit(0), F.least(F.lit(h - 1), iv + first + j)).cast("int").alias("ty"),
                                (wu[i] * wv[j]).alias("w"), F.lit(i * len(wv) + j).alias("k"), F.lit(first + i in (0, 1) and first + j in (0, 1)).alias("near"))
    rows = base.where("_in").select(*r.at, F.explode(F.array(*[tap(i, j) for i in range(len(wu)) for j in range(len(wv))])).alias("t")).select(*r.at, "t.*")
    pixels = r.df.select(*r.keys, F.col("x").alias("tx"), F.col("y").alias("ty"), *r.names)
    taps = range(len(wu) * len(wv))
    aggs = [F.sum(F.when(F.col("k") == k, F.col(n).cast("double") * F.col("w"))).alias(f"{n}_{k}") for n in r.names for k in taps]
    if limited:
        aggs += [g(F.when(F.col("near"), F.col(n).cast("double"))).alias(f"{p}{n}") for n in r.names for g, p in ((F.min, "lo_"), (F.max, "hi_"))]
    got = rows.join(pixels, [*r.keys, "tx", "ty"]).groupBy(*r.at).agg(*aggs)
    terms = lambda n: [F.col(f"{n}_{k}") for k in taps]
    added = lambda n: F.when(F.coalesce(*terms(n)).isNotNull(), reduce(operator.add, [F.coalesce(t, F.lit(0.0)) for t in terms(n)]))
    got = got.select(*r.at, *[added(n).alias(n) for n in r.names], *[f"{p}{n}" for n in r.names for p in ("lo_", "hi_") if limited])
    if limited:
        got = got.select(*r.at, *[F.greatest(F.col(f"lo_{n}"), F.least(F.col(f"hi_{n}"), F.col(n))).alias(n) for n in r.names])
    out = base.select(*r.at).join(got, r.at, "left")
    values = [F.coalesce(saturate(F.floor(F.col(n) + 0.5), r.format) if is_int(r.format) else F.col(n), F.lit(background)) for n in r.names]
    return r.having(out, width=width or w, height=height or h).with_bands(values)


def affine(r: Raster, matrix: tuple[float, float, float, float], interpolate="bilinear", odx=0.0, ody=0.0, idx=0.0, idy=0.0, oarea=None, background=0.0) -> Raster:
    """out = [[a, b], [c, d]] * (in + id) + od, by the inverse map over the output area."""
    a, b, c, d = matrix
    det = a * d - b * c
    ia, ib, ic, id_ = d / det, -b / det, -c / det, a / det
    if oarea is None:
        corners = [(a * (x + idx) + b * (y + idy) + odx, c * (x + idx) + d * (y + idy) + ody) for x in (0, r.width) for y in (0, r.height)]
        left, top = _half_up(min(p[0] for p in corners)), _half_up(min(p[1] for p in corners))
        oarea = (left, top, _half_up(max(p[0] for p in corners)) - left, _half_up(max(p[1] for p in corners)) - top)
    left, top, width, height = oarea
    gx, gy = F.col("x") + left - odx, F.col("y") + top - ody
    at = grid(r.df.sparkSession, width, height, r).select(*r.at, (gx * ia + gy * ib - idx).cast("double").alias("u"), (gx * ic + gy * id_ - idy).cast("double").alias("v"))
    return sample(r, at, interpolate, background, width, height)


def similarity(r: Raster, scale=1.0, angle=0.0, **o) -> Raster:
    t = math.radians(angle)
    return affine(r, (scale * math.cos(t), scale * -math.sin(t), scale * math.sin(t), scale * math.cos(t)), **o)


def rotate(r: Raster, angle: float, **o) -> Raster:
    return similarity(r, 1.0, angle, **o)


def mapim(r: Raster, index: Raster, interpolate="bilinear", background=0.0) -> Raster:
    """Each output pixel takes the input at the coordinates that the two-band index holds."""
    at = index.df.select(*index.at, F.col("b0").cast("double").alias("u"), F.col("b1").cast("double").alias("v"))
    if r.keys and not index.keys:
        at = grid(r.df.sparkSession, index.width, index.height, r).join(at, ["x", "y"])
    if index.keys and not r.keys:
        r = r.having(grid(r.df.sparkSession, r.width, r.height, index).join(r.df, ["x", "y"]), keys=index.keys)
    return sample(r, at, interpolate, background, index.width, index.height)


def quadratic(r: Raster, coeff: list[tuple[float, float]], interpolate="bilinear") -> Raster:
    """Polynomial warp: coefficients of 1, x, y, xy, x2, y2 for the input's x and y."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    terms = [F.lit(1.0), x, y, x * y, x * x, y * y]
    u = sum([t * c[0] for t, c in zip(terms[1:], coeff[1:])], terms[0] * coeff[0][0]) + x
    v = sum([t * c[1] for t, c in zip(terms[1:], coeff[1:])], terms[0] * coeff[0][1]) + y
    return sample(r, r.df.select(*r.at, u.alias("u"), v.alias("v")), interpolate)


def resize(r: Raster, scale: float, vscale: float | None = None, kernel="lanczos3") -> Raster:
    """Down by kernel reduction, up by zoom where integral and affine otherwise."""
    vscale = vscale or scale
    if scale <= 1 and vscale <= 1:
        return reduce_(r, r.width / max(1, _half_up(r.width * scale)), r.height / max(1, _half_up(r.height * vscale)), kernel)
    if kernel == "nearest" and scale == int(scale) and vscale == int(vscale):
        return conversion.zoom(r, int(scale), int(vscale))
    how = {"nearest": "nearest", "linear": "bilinear"}.get(kernel, "bicubic")
    # Pixel centres stay centres.
    return affine(r, (scale, 0, 0, vscale), how, idx=0.5 - 0.5 / scale, idy=0.5 - 0.5 / vscale, oarea=(0, 0, _half_up(r.width * scale), _half_up(r.height * vscale)))


def thumbnail(r: Raster, width: int, height: int | None = None, size="both", crop="none", linear=False) -> Raster:
    """Fits into the box (or fills it, with a crop)."""
    height = height or width
    fx, fy = r.width / width, r.height / height
    if size == "force":
        return resize(r, 1 / fx, 1 / fy)
    f = min(fx, fy) if crop != "none" else max(fx, fy)
    f = max(1.0, f) if size == "down" else min(1.0, f) if size == "up" else f
    out = resize(r, 1 / f)
    return conversion.smartcrop(out, min(width, out.width), min(height, out.height), crop) if crop != "none" else out
