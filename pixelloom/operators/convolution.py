"""Convolution, correlation and edges, over two window passes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, functions as F

from ..raster import Raster, is_int, promoted, saturate
from .window2d import window2d


def _sum(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values) if values else F.lit(0)


def _cdiv(a: Column, n: int) -> Column:
    """Integer quotient truncated towards zero."""
    return F.when(a >= 0, F.floor(a / n)).otherwise(-F.floor(-a / n)) if n > 0 else _cdiv(-a, -n)


def conv(r: Raster, mask: list[list[float]], scale=1.0, offset=0.0, precision="float") -> Raster:
    """precision integer: int64 sums, (sum + scale / 2) / scale + offset, clipped to the format; float: double sums."""
    h, w = len(mask), len(mask[0])
    exact = precision == "integer" and is_int(r.format)
    kind = "long" if exact else "double"
    m = [[int(round(v)) if exact else float(v) for v in line] for line in mask]

    def row(_, k, taps):
        return [_sum([F.lit(c) * t.cast(kind) for c, t in zip(m[k], taps) if c != 0] or [F.lit(0).cast(kind)])]

    df, sums = window2d(r, w, h, row, lambda _, rows: [_sum([x[0] for x in rows])])
    if exact:
        s = int(round(scale))
        values = [saturate(_cdiv(v + s // 2, s) + int(round(offset)), r.format) for v in sums]
        return r.having(df).with_bands(values)
    return r.having(df).with_bands([v / float(scale) + float(offset) for v in sums], promoted("math", r.format))


def convi(r: Raster, mask, scale=1.0, offset=0.0) -> Raster:
    return conv(r, mask, scale, offset, "integer")


def convf(r: Raster, mask, scale=1.0, offset=0.0) -> Raster:
    return conv(r, mask, scale, offset, "float")


def conva(r: Raster, mask, scale=1.0, offset=0.0, layers=5) -> Raster:
    """Approximate convolution: the mask is quantised to ``layers`` levels, then summed exactly."""
    top = max(abs(v) for line in mask for v in line) or 1.0
    step = top / layers
    return conv(r, [[round(v / step) * step for v in line] for line in mask], scale, offset, "float")


def convsep(r: Raster, line: list[float], scale=1.0, offset=0.0, precision="float") -> Raster:
    """A one-line mask along x, then along y without the offset; each pass rounds and clips."""
    one = conv(r, [line], scale, offset, precision)
    return conv(one, [[v] for v in line], scale, 0.0, precision)


def convasep(r: Raster, line, scale=1.0, offset=0.0, layers=5) -> Raster:
    top = max(map(abs, line)) or 1.0
    return convsep(r, [round(v * layers / top) * top / layers for v in line], scale, offset)


def gaussline(sigma: float, min_ampl: float, integer=True) -> tuple[list[float], float]:
    """(coefficients, scale) of a truncated Gaussian line."""
    at = []
    for x in range(5000):
        v = math.exp(-(x * x) / (2 * sigma * sigma))
        if v < min_ampl:
            break
        at.append(float(round(20 * v)) if integer else v)
    line = at[:0:-1] + at
    return line, sum(line)


def gaussblur(r: Raster, sigma: float, min_ampl=0.2, precision="integer") -> Raster:
    if sigma < 0.2:
        return r
    line, scale = gaussline(sigma, min_ampl, precision != "float")
    return convsep(r, line, scale, 0.0, precision)


def _abs_sum(gx, gy, r):
    if r.format == "uchar":
        return F.least(F.lit(255), 2 * (F.abs(gx) + F.abs(gy)))
    return F.sqrt(gx * gx + gy * gy)


def _edge(r: Raster, side: float, middle: float) -> Raster:
    """Both gradients in one pair of window passes; uchar: 2 (|gx| + |gy|) of halved gradients, clipped."""
    gx = [[1, 0, -1], [middle / side, 0, -middle / side], [1, 0, -1]]
    gx = [[side * v for v in line] for line in gx]
    gy = [list(c) for c in zip(*gx)]

    def row(_, k, t):
        return [_sum([F.lit(float(c)) * v.cast("double") for c, v in zip(m[k], t) if c] or [F.lit(0.0)]) for m in (gx, gy)]

    def total(_, rows):
        a, b = _sum([x[0] for x in rows]), _sum([x[1] for x in rows])
        if r.format == "uchar":
            # Gradients are halved, rounded up and limited to -128..127 as 8-bit results would be.
            a, b = (F.greatest(F.lit(-128), F.least(F.lit(127), _cdiv(v + 1, 2))) for v in (a, b))
        return [_abs_sum(a, b, r)]

    df, values = window2d(r, 3, 3, row, total)
    return r.having(df).with_bands(values, "uchar" if r.format == "uchar" else promoted("math", r.format))


def sobel(r: Raster) -> Raster:
    return _edge(r, 1, 2)


def scharr(r: Raster) -> Raster:
    return _edge(r, 3, 10)


def prewitt(r: Raster) -> Raster:
    return _edge(r, 1, 1)


def rotated45(mask: list[list[float]], steps=1) -> list[list[float]]:
    """A small odd square turned by 45 degrees, ring by ring."""
    n = len(mask)
    out = [list(line) for line in mask]
    for d in range(1, n // 2 + 1):
        c = n // 2
        ring = [(c - d, c - d + k) for k in range(2 * d)] + [(c - d + k, c + d) for k in range(2 * d)] + [(c + d, c + d - k) for k in range(2 * d)] + [(c + d - k, c - d) for k in range(2 * d)]
        for k, (y, x) in enumerate(ring):
            ny, nx = ring[(k + steps * d) % len(ring)]
            out[ny][nx] = mask[y][x]
    return out


def compass(r: Raster, mask, times=2, angle=90, how="max", scale=1.0, offset=0.0, precision="float") -> Raster:
    """The mask turned ``times`` times by the angle; absolute responses are combined by max, min or sum."""
    masks = [mask]
    for _ in range(times - 1):
        masks.append(rotated45(masks[-1], angle // 45))

    def row(_, k, t):
        return [_sum([F.lit(float(c)) * v.cast("double") for c, v in zip(m[k], t) if c] or [F.lit(0.0)]) for m in masks]

    def total(_, rows):
        got = [F.abs(_sum([x[j] for x in rows]) / float(scale) + float(offset)) for j in range(len(masks))]
        return [got[0] if len(got) == 1 else {"max": F.greatest, "min": F.least, "sum": lambda *v: _sum(list(v))}[how](*got)]

    df, values = window2d(r, len(mask[0]), len(mask), row, total)
    return r.having(df).with_bands(values, promoted("math", r.format))


def fastcor(r: Raster, ref: list[list[float]]) -> Raster:
    """Sum of squared differences from the reference at each position."""
    df, values = window2d(r, len(ref[0]), len(ref), lambda _, k, t: [_sum([(F.lit(int(c)) - v.cast("long")) * (F.lit(int(c)) - v.cast("long")) for c, v in zip(ref[k], t)])], lambda _, rows: [_sum([x[0] for x in rows])])
    return r.having(df).with_bands(values, "uint")


def spcor(r: Raster, ref: list[list[float]]) -> Raster:
    """Normalised cross-correlation with the reference; zero where either has no spread."""
    flat = [float(v) for line in ref for v in line]
    n, mean = len(flat), sum(flat) / len(flat)
    spread = sum((v - mean) ** 2 for v in flat)

    def row(_, k, t):
        d = [v.cast("double") for v in t]
        return [_sum(d), _sum([v * v for v in d]), _sum([F.lit(c - mean) * v for c, v in zip(ref[k], d)])]

    def total(_, rows):
        s, q, dot = (_sum([x[j] for x in rows]) for j in range(3))
        below = F.sqrt(F.greatest(F.lit(0.0), q - s * s / n) * spread)
        return [F.when(below == 0, F.lit(0.0)).otherwise(dot / below)]

    df, values = window2d(r, len(ref[0]), len(ref), row, total)
    return r.having(df).with_bands(values, "float")


def canny(r: Raster, sigma=1.4) -> Raster:
    """Blur, 2 x 2 gradient, and thinning across the gradient's direction (no hysteresis)."""
    blurred = gaussblur(r.cast("float"), sigma, precision="float")
    df, values = window2d(blurred, 3, 3, lambda _, k, t: [t[1].cast("double"), t[2].cast("double")],
                          lambda _, rows: [(rows[1][1] - rows[1][0] + rows[2][1] - rows[2][0]) / 2, (rows[2][0] - rows[1][0] + rows[2][1] - rows[1][1]) / 2])
    polar = []
    for k in range(r.bands):
        gx, gy = values[2 * k], values[2 * k + 1]
        polar += [F.hypot(gx, gy), F.pmod(F.floor(F.degrees(F.atan2(gy, gx)) / 45 + 0.5), F.lit(4))]
    edges = blurred.having(df).with_bands(polar, "double")
    at = {0: ((1, 0), (1, 2)), 1: ((0, 0), (2, 2)), 2: ((0, 1), (2, 1)), 3: ((0, 2), (2, 0))}

    def total(b, rows):
        if b % 2:
            return []
        g, theta = rows[1][1], F.col(f"b{b + 1}")
        keep = F.lit(False)
        for d, ((y1, x1), (y2, x2)) in at.items():
            keep = keep | ((theta == d) & (g >= rows[y1][x1]) & (g >= rows[y2][x2]))
        return [F.when(keep, g).otherwise(F.lit(0.0))]

    df, values = window2d(edges, 3, 3, lambda _, k, t: t, total)
    return r.having(df).with_bands(values, "float")


def sharpen_curve(d: Column, x1=2.0, y2=10.0, y3=20.0, m1=0.0, m2=3.0) -> Column:
    """Piecewise gain of a difference: m1 within x1, m2 beyond, at most y2 brighter and y3 darker."""
    size = F.abs(d)
    gain = F.when(size < x1, size * m1).otherwise(x1 * m1 + (size - x1) * m2)
    return F.when(d >= 0, F.least(gain, F.lit(y2))).otherwise(-F.least(gain, F.lit(y3)))


def sharpen(r: Raster, sigma=0.5, **curve) -> Raster:
    """Unsharp masking of lightness (band 0 of a Lab image)."""
    light = r.with_bands([r.cols[0]], "double")
    line, scale = gaussline(sigma, 0.1, False)
    soft = convsep(light, line, scale)
    both = r.df.join(soft.df.select(*r.at, F.col("b0").alias("soft")), r.at)
    c = r.cols
    return r.having(both).with_bands([F.greatest(F.lit(0.0), F.least(F.lit(100.0), c[0] + sharpen_curve(c[0] - F.col("soft"), **curve))), *c[1:]], r.format)
