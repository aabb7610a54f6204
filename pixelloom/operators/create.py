"""Generators: rasters from coordinates alone, split over tasks by ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..raster import Raster, grid, saturate


def _x() -> Column:
    return F.col("x").cast("double")


def _y() -> Column:
    return F.col("y").cast("double")


def _make(spark, width, height, values, fmt, interpretation="multiband") -> Raster:
    return Raster(grid(spark, width, height), width, height, 0, fmt, interpretation).with_bands(values, fmt, interpretation=interpretation)


def _unit(spark, width, height, value: Column, uchar: bool, lo=-1.0, hi=1.0) -> Raster:
    """A float image, or 0..255 of its range."""
    if uchar:
        return _make(spark, width, height, [saturate(F.floor((value - lo) * 255.0 / (hi - lo)), "uchar")], "uchar")
    return _make(spark, width, height, [value], "float")


def black(spark: SparkSession, width: int, height: int, bands=1) -> Raster:
    return _make(spark, width, height, [F.lit(0)] * bands, "uchar")


def xyz(spark, width, height, csize=1, dsize=1, esize=1) -> Raster:
    """Coordinates as bands; further dimensions stack downwards."""
    total = height * csize * dsize * esize
    cols, rest = [F.col("x"), F.col("y") % height], F.floor(F.col("y") / height)
    for size in (csize, dsize, esize):
        if size > 1:
            cols.append(rest % size)
            rest = F.floor(rest / size)
    return _make(spark, width, total, cols, "uint")


def grey(spark, width, height, uchar=False) -> Raster:
    v = _x() / max(1, width - 1)
    return _unit(spark, width, height, v, uchar, 0.0, 1.0)


def zone(spark, width, height, uchar=False) -> Raster:
    dx, dy = _x() - width // 2, _y() - height // 2
    return _unit(spark, width, height, F.cos(F.lit(math.pi / width) * (dx * dx + dy * dy)), uchar)


def sines(spark, width, height, hfreq=0.5, vfreq=0.5, uchar=False) -> Raster:
    theta = math.pi / 2 if hfreq == 0 else math.atan(vfreq / hfreq)
    c = math.sqrt(hfreq * hfreq + vfreq * vfreq) * math.pi * 2 / width
    return _unit(spark, width, height, F.cos(c * (_x() * math.cos(theta) - _y() * math.sin(theta))), uchar)


def eye(spark, width, height, factor=0.5, uchar=False) -> Raster:
    my = float(max(1, height - 1)) ** 2
    c = factor * math.pi / (2 * max(1, width - 1))
    return _unit(spark, width, height, _y() * _y() * F.cos(c * _x() * _x()) / my, uchar)


def identity(spark, bands=1, ushort=False, size=65536) -> DataFrame:
    n = size if ushort else 256
    return spark.range(n).select(F.col("id").cast("int").alias("bin"), *[F.col("id").alias(f"b{k}") for k in range(bands)])


def gaussnoise(spark, width, height, mean=128.0, sigma=30.0, seed=0) -> Raster:
    return _make(spark, width, height, [F.randn(seed) * sigma + mean], "float")


# --- frequency masks: functions of the distance from the (optical) centre ----------------------------------------

def _mask(spark, width, height, value, uchar=False, optical=False, reject=False, nodc=False) -> Raster:
    """``value(dx, dy)`` gets distances in half widths, dc at the origin, or in the middle with ``optical``."""
    hx, hy = width // 2, height // 2
    x = F.col("x") if not optical else (F.col("x") + hx) % width
    y = F.col("y") if not optical else (F.col("y") + hy) % height
    x, y = F.when(x >= hx, x - width).otherwise(x), F.when(y >= hy, y - height).otherwise(y)
    v = value(x / F.lit(float(hx)), y / F.lit(float(hy)))
    v = 1.0 - v if reject else v
    if not nodc:
        v = F.when((x == 0) & (y == 0), F.lit(1.0)).otherwise(v)
    return _unit(spark, width, height, v, uchar, 0.0, 1.0)


def _d2(dx, dy):
    return dx * dx + dy * dy


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def mask_ideal(spark, w, h, fc, **o) -> Raster:
    return _mask(spark, w, h, lambda x, y: _flag(_d2(x, y) > fc * fc), **o)


def mask_ideal_ring(spark, w, h, fc, ringwidth, **o) -> Raster:
    lo, hi = max(0.0, fc - ringwidth / 2), fc + ringwidth / 2
    return _mask(spark, w, h, lambda x, y: _flag((_d2(x, y) > lo * lo) & (_d2(x, y) < hi * hi)), **o)


def mask_ideal_band(spark, w, h, fcx, fcy, radius, **o) -> Raster:
    r2 = radius * radius
    return _mask(spark, w, h, lambda x, y: _flag((_d2(x - fcx, y - fcy) < r2) | (_d2(x + fcx, y + fcy) < r2)), **o)


def mask_butterworth(spark, w, h, order, fc, ac, **o) -> Raster:
    c = 1 / ac - 1

    def v(x, y):
        d = _d2(x, y)
        return F.when(d == 0, F.lit(0.0)).otherwise(1 / (1 + c * F.pow(fc * fc / F.when(d == 0, F.lit(1.0)).otherwise(d), F.lit(float(order)))))

    return _mask(spark, w, h, v, **o)


def mask_butterworth_ring(spark, w, h, order, fc, ac, ringwidth, **o) -> Raster:
    c, df2 = 1 / ac - 1, (ringwidth / 2) ** 2
    return _mask(spark, w, h, lambda x, y: 1 / (1 + c * F.pow((F.sqrt(_d2(x, y)) - fc) * (F.sqrt(_d2(x, y)) - fc) / df2, F.lit(float(order)))), **o)


def mask_butterworth_band(spark, w, h, order, fcx, fcy, radius, ac, **o) -> Raster:
    c, r2 = 1 / ac - 1, radius * radius
    lobe = lambda d: 1 / (1 + c * F.pow(d / r2, F.lit(float(order))))
    at = 1 + 1 / (1 + c * (4 * (fcx * fcx + fcy * fcy) / r2) ** order)
    return _mask(spark, w, h, lambda x, y: (lobe(_d2(x - fcx, y - fcy)) + lobe(_d2(x + fcx, y + fcy))) / at, **o)


def mask_gaussian(spark, w, h, fc, ac, **o) -> Raster:
    return _mask(spark, w, h, lambda x, y: 1 - F.exp(F.lit(math.log(ac) / (fc * fc)) * _d2(x, y)), **o)


def mask_gaussian_ring(spark, w, h, fc, ac, ringwidth, **o) -> Raster:
    k = math.log(ac) / (ringwidth / 2) ** 2
    return _mask(spark, w, h, lambda x, y: F.exp(k * (F.sqrt(_d2(x, y)) - fc) * (F.sqrt(_d2(x, y)) - fc)), **o)


def mask_gaussian_band(spark, w, h, fcx, fcy, radius, ac, **o) -> Raster:
    k = math.log(ac) / (radius * radius)
    at = 1 + math.exp(k * 4 * (fcx * fcx + fcy * fcy))
    return _mask(spark, w, h, lambda x, y: (F.exp(k * _d2(x - fcx, y - fcy)) + F.exp(k * _d2(x + fcx, y + fcy))) / at, **o)


def mask_fractal(spark, w, h, dimension, **o) -> Raster:
    def v(x, y):
        d = _d2(x * (w // 2), y * (h // 2))
        return F.when(d == 0, F.lit(0.0)).otherwise(F.pow(F.when(d == 0, F.lit(1.0)).otherwise(d), F.lit((dimension - 4) / 2)))

    return _mask(spark, w, h, v, **o)


# --- small matrices ----------------------------------------------------------------------------------------------

def gaussmat(sigma: float, min_ampl: float, separable=False, integer=True) -> tuple[list[list[float]], float]:
    """(mask, scale)."""
    from .convolution import gaussline

    line, total = gaussline(sigma, min_ampl, integer)
    if separable:
        return [line], total
    n = len(line) // 2
    two = [[math.exp(-((x * x + y * y) / (2 * sigma * sigma))) for x in range(-n, n + 1)] for y in range(-n, n + 1)]
    two = [[float(round(20 * v)) if integer else v for v in row] for row in two]
    return two, sum(map(sum, two))


def logmat(sigma: float, min_ampl: float, separable=False, integer=True) -> tuple[list[list[float]], float]:
    s2 = sigma * sigma
    f = lambda d: 0.5 * (2 - d / s2) * math.exp(-d / (2 * s2))
    n, last = 0, 0.0
    for n in range(5000):
        v = f(float(n * n))
        if v - last >= 0 and abs(v) < min_ampl and n:
            break
        last = v
    two = [[f(float(x * x + y * y)) for x in range(-n, n + 1)] for y in ([0] if separable else range(-n, n + 1))]
    two = [[float(round(20 * v)) if integer else v for v in row] for row in two]
    return two, sum(map(sum, two))


def matrix(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(x, y, float(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], "x int, y int, v double")


def buildlut(points: DataFrame) -> DataFrame:
    """(bin, b0): piecewise linear through points (p, q), one row for each integer between them."""
    w = Window.orderBy("p")
    seg = points.select("p", "q", F.lead("p").over(w).alias("p1"), F.lead("q").over(w).alias("q1"))
    end = F.when(F.col("p1").isNull(), F.col("p")).otherwise(F.col("p1") - 1)
    rows = seg.select("*", F.explode(F.sequence(F.col("p").cast("int"), end.cast("int"))).alias("bin"))
    v = F.when(F.col("p1").isNull(), F.col("q")).otherwise(F.col("q") + (F.col("bin") - F.col("p")) * (F.col("q1") - F.col("q")) / (F.col("p1") - F.col("p")))
    return rows.select("bin", v.cast("double").alias("b0"))


def invertlut(spark, measures: list[tuple[float, float]], size=256) -> DataFrame:
    """(bin, b0): the inverse of a measured response (input, output), both in 0..1; ends are extrapolated to 0 and 1."""
    pts = sorted((y, x) for x, y in measures)
    pts = [(0.0, 0.0), *pts, (1.0, 1.0)]
    k = F.col("id") / F.lit(float(size - 1))
    out = F.lit(1.0)
    for (y0, x0), (y1, x1) in reversed(list(zip(pts, pts[1:]))):
        step = F.lit(x0) if y1 == y0 else x0 + (k - y0) * ((x1 - x0) / (y1 - y0))
        out = F.when(k <= y1, step).otherwise(out)
    return spark.range(size).select(F.col("id").cast("int").alias("bin"), out.alias("b0"))


def tonelut(spark, in_max=32767, out_max=32767, Lb=0.0, Lw=100.0, Ps=0.2, Pm=0.5, Ph=0.8, S=0.0, M=0.0, H=0.0) -> DataFrame:
    """A tone curve: black and white points, and smooth bumps of shadows, mid-tones and highlights."""
    ls, lm, lh = Lb + Ps * (Lw - Lb), Lb + Pm * (Lw - Lb), Lb + Ph * (Lw - Lb)
    x = 100.0 * F.col("id") / in_max

    def bump(a, b, c):
        t = lambda lo, hi: (x - lo) / (hi - lo)
        cubic = lambda v: 3 * v * v - 2 * v * v * v
        return F.when(x < a, F.lit(0.0)).when(x < b, cubic(t(a, b))).when(x < c, 1.0 - cubic(t(b, c))).otherwise(F.lit(0.0))

    y = x + S * bump(Lb, ls, lm) + M * bump(ls, lm, lh) + H * bump(lm, lh, Lw)
    v = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(out_max)), out_max / 100.0 * y)))
    return spark.range(in_max + 1).select(F.col("id").cast("int").alias("bin"), v.cast("long").alias("b0"))


def sdf(spark, width, height, shape="circle", a=(0.0, 0.0), b=(0.0, 0.0), r=50.0, corners=(0, 0, 0, 0)) -> Raster:
    """Signed distance of a circle, box, rounded box or line."""
    if shape == "circle":
        v = F.hypot(_x() - a[0], _y() - a[1]) - r
    elif shape == "line":
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy or 1.0
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((_x() - a[0]) * dx + (_y() - a[1]) * dy) / n))
        v = F.hypot(_x() - a[0] - t * dx, _y() - a[1] - t * dy)
    else:
        cx, cy, hx, hy = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, (b[0] - a[0]) / 2, (b[1] - a[1]) / 2
        rad = F.lit(0.0)
        if shape == "rounded_box":
            right, low = _x() > cx, _y() > cy
            rad = F.when(right & low, float(corners[0])).when(right, float(corners[1])).when(low, float(corners[2])).otherwise(float(corners[3]))
        qx, qy = F.abs(_x() - cx) - hx + rad, F.abs(_y() - cy) - hy + rad
        v = F.hypot(F.greatest(qx, F.lit(0.0)), F.greatest(qy, F.lit(0.0))) + F.least(F.greatest(qx, qy), F.lit(0.0)) - rad
    return _make(spark, width, height, [v], "float")


def _cell_random(cx: Column, cy: Column, seed: int, k: int) -> Column:
    """A repeatable number in 0..1 for each cell."""
    return F.pmod(F.xxhash64(cx.cast("long"), cy.cast("long"), F.lit(seed), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)


def worley(spark, width, height, cell_size=256, seed=0) -> Raster:
    """Distance to the nearest of one feature point a cell, over the 3 x 3 cells around."""
    cx, cy = F.floor(_x() / cell_size), F.floor(_y() / cell_size)
    best = [F.hypot((cx + i + _cell_random(cx + i, cy + j, seed, 0)) * cell_size - _x(), (cy + j + _cell_random(cx + i, cy + j, seed, 1)) * cell_size - _y()) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return _make(spark, width, height, [F.least(*best)], "float")


def perlin(spark, width, height, cell_size=256, seed=0, uchar=False) -> Raster:
    """Gradient noise: corner gradients by hash, blended with a quintic."""
    gx, gy = F.floor(_x() / cell_size), F.floor(_y() / cell_size)
    fx, fy = _x() / cell_size - gx, _y() / cell_size - gy

    def corner(i, j):
        angle = _cell_random(gx + i, gy + j, seed, 2) * 2 * math.pi
        return F.cos(angle) * (fx - i) + F.sin(angle) * (fy - j)

    s = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    lerp = lambda a, b, t: a + t * (b - a)
    return _unit(spark, width, height, lerp(lerp(corner(0, 0), corner(1, 0), s(fx)), lerp(corner(0, 1), corner(1, 1), s(fx)), s(fy)), uchar)


# A 3 x 5 dot font for digits and capitals, one row of three bits a digit (octal), top to bottom.
GLYPHS = {"0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71111", "8": "75757", "9": "75717",
          "A": "25755", "B": "65656", "C": "34443", "D": "65556", "E": "74647", "F": "74644", "G": "34553", "H": "55755", "I": "72227", "J": "11152", "K": "55655", "L": "44447", "M": "57755",
          "N": "67555", "O": "25552", "P": "65644", "Q": "25573", "R": "65655", "S": "34216", "T": "72222", "U": "55557", "V": "55552", "W": "55775", "X": "55255", "Y": "55222", "Z": "71247", " ": "00000", "-": "00700", ".": "00002"}


def text(spark, string: str, size=1) -> Raster:
    """Rendered text in a dot font: 255 on 0."""
    lines = string.upper().split("\n")
    points = [(4 * i + 2 - k, 6 * j + y) for j, line in enumerate(lines) for i, ch in enumerate(line) for y, d in enumerate(GLYPHS.get(ch, GLYPHS["."])) for k in range(3) if int(d) >> k & 1]
    width, height = 4 * max(1, max(map(len, lines))) * size, 6 * len(lines) * size
    ink = spark.createDataFrame(points or [(-1, -1)], "cx int, cy int")
    cells = grid(spark, width, height).select("x", "y", F.expr(f"cast(x div {size} as int)").alias("cx"), F.expr(f"cast(y div {size} as int)").alias("cy"))
    df = cells.join(F.broadcast(ink.withColumn("on", F.lit(255))), ["cx", "cy"], "left").select("x", "y", F.coalesce("on", F.lit(0)).cast("short").alias("b0"))
    return Raster(df, width, height, 1, "uchar")
