"""Mosaics and small matrices."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..raster import Raster, is_int, saturate
from . import resample


def merge(ref: Raster, sec: Raster, direction: str, dx: int, dy: int, mblend=10) -> Raster:
    """Joins two overlapping images; the overlap (at most ``mblend`` wide, in its middle) is blended by a raised cosine.

    The second image's origin is at (-dx, -dy) of the first.
    """
    ox, oy = -dx, -dy
    left, top = min(0, ox), min(0, oy)
    width, height = max(ref.width, ox + sec.width) - left, max(ref.height, oy + sec.height) - top
    if ref.keys != sec.keys:
        raise ValueError("both images, or both stacks of the same keys")
    a = ref.df.select(*ref.keys, (F.col("x") - left).alias("x"), (F.col("y") - top).alias("y"), *[F.col(c).alias(f"p{c[1:]}") for c in ref.names])
    b = sec.df.select(*sec.keys, (F.col("x") + ox - left).alias("x"), (F.col("y") + oy - top).alias("y"), *[F.col(c).alias(f"q{c[1:]}") for c in sec.names])
    df = a.join(b, ref.at, "full")
    axis, lo, hi = ("x", ox - left, ref.width - left) if direction == "horizontal" else ("y", oy - top, ref.height - top)
    span = min(mblend, hi - lo) if mblend >= 0 else hi - lo
    start = lo + (hi - lo - span) // 2
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(axis) - start + 0.5) / float(max(1, span))))
    w = 0.5 - 0.5 * F.cos(t * math.pi)
    values = []
    for k in range(ref.bands):
        p, q = F.col(f"p{k}").cast("double"), F.col(f"q{k}").cast("double")
        v = F.when(q.isNull(), p).when(p.isNull(), q).otherwise(p * (1 - w) + q * w)
        values.append(saturate(F.floor(v + 0.5), ref.format) if is_int(ref.format) else v)
    out = ref.having(df, width=width, height=height).with_bands(values)
    from .conversion import _fill

    return _fill(out, width, height, 0)


def correlate(ref: Raster, sec: Raster, xref: int, yref: int, xsec: int, ysec: int, hwindow=5, harea=15) -> DataFrame:
    """Best displacement of a window around the tie point of ref within an area of sec: (dx, dy, cor).

    Every displacement is a group of an equi-join of two bounded windows.
    """
    w = ref.df.where((F.abs(F.col("x") - xref) <= hwindow) & (F.abs(F.col("y") - yref) <= hwindow)).select((F.col("x") - xref).alias("i"), (F.col("y") - yref).alias("j"), F.col("b0").cast("double").alias("p"))
    s = sec.df.where((F.abs(F.col("x") - xsec) <= hwindow + harea) & (F.abs(F.col("y") - ysec) <= hwindow + harea)).select((F.col("x") - xsec).alias("sx"), (F.col("y") - ysec).alias("sy"), F.col("b0").cast("double").alias("q"))
    moves = w.select("*", F.explode(F.sequence(F.lit(-harea), F.lit(harea))).alias("dx")).select("*", F.explode(F.sequence(F.lit(-harea), F.lit(harea))).alias("dy"))
    moves = moves.select((F.col("i") + F.col("dx")).alias("sx"), (F.col("j") + F.col("dy")).alias("sy"), "dx", "dy", "p")
    cor = moves.join(s, ["sx", "sy"]).groupBy("dx", "dy").agg(F.corr("p", "q").alias("cor"), F.count(F.lit(1)).alias("n"))
    full = (2 * hwindow + 1) ** 2
    return cor.where(F.col("n") == full).orderBy(F.desc_nulls_last("cor"), "dy", "dx").limit(1).select("dx", "dy", "cor")


def mosaic(ref: Raster, sec: Raster, direction: str, xref, yref, xsec, ysec, hwindow=5, harea=15, mblend=10) -> Raster:
    """Refines the one given tie point by correlation on band 0, then merges; without a full window the point is taken as given."""
    if ref.keys or sec.keys:
        raise ValueError("the images of a stack may move each by its own distance: mosaic one pair at a time, or merge")
    best = correlate(ref, sec, xref, yref, xsec, ysec, hwindow, harea).first()
    dx, dy = (best["dx"], best["dy"]) if best else (0, 0)
    return merge(ref, sec, direction, xsec + dx - xref, ysec + dy - yref, mblend)


def solve_similarity(r1, r2, s1, s2):
    """(a, b, dx, dy) with ref = [[a, -b], [b, a]] * sec + (dx, dy), from two tie points."""
    m = np.array([[s1[0], -s1[1], 1, 0], [s1[1], s1[0], 0, 1], [s2[0], -s2[1], 1, 0], [s2[1], s2[0], 0, 1]], float)
    return tuple(np.linalg.solve(m, np.array([*r1, *r2], float)))


def match(ref: Raster, sec: Raster, r1, s1, r2, s2, interpolate="bilinear") -> Raster:
    """Resamples the second image so that both tie points meet, over the first's area."""
    a, b, dx, dy = solve_similarity(r1, r2, s1, s2)
    return resample.affine(sec, (a, -b, b, a), interpolate, odx=dx, ody=dy, oarea=(0, 0, ref.width, ref.height))


def mosaic1(ref: Raster, sec: Raster, direction: str, r1, s1, r2, s2, mblend=10) -> Raster:
    """Rotate and scale by two tie points, then merge."""
    a, b, dx, dy = solve_similarity(r1, r2, s1, s2)
    turned = resample.affine(sec, (a, -b, b, a), "bilinear", odx=dx, ody=dy)
    corners = [(a * x - b * y + dx, b * x + a * y + dy) for x in (0, sec.width) for y in (0, sec.height)]
    left, top = math.floor(min(p[0] for p in corners) + 0.5), math.floor(min(p[1] for p in corners) + 0.5)
    return merge(ref, turned, direction, -left, -top, mblend)


def globalbalance(images: list[Raster], places: list[tuple[int, int]], gamma=1.6) -> list[Raster]:
    """Gains that make overlaps agree: the means of all overlaps by one self-join, a small least-squares fit on the driver, a linear step for each image."""
    if any(r.keys for r in images):
        raise ValueError("the images are single: a stack has no places")
    n, rows, rhs = len(images), [], []
    placed = None
    for k, (r, (left, top)) in enumerate(zip(images, places)):
        one = r.df.select(F.lit(k).alias("i"), (F.col("x") + left).alias("x"), (F.col("y") + top).alias("y"), F.pow(F.col("b0") / 255.0, F.lit(gamma)).alias("p"))
        placed = one if placed is None else placed.unionByName(one)
    pairs = placed.join(placed.select(F.col("i").alias("j"), "x", "y", F.col("p").alias("q")), ["x", "y"]).where("i < j")
    for got in pairs.groupBy("i", "j").agg(F.avg("p").alias("p"), F.avg("q").alias("q")).orderBy("i", "j").collect():
        line = [0.0] * n
        line[got["i"]], line[got["j"]] = got["p"], -got["q"]
        rows.append(line)
        rhs.append(0.0)
    rows.append([1.0] + [0.0] * (n - 1))
    rhs.append(1.0)
    gains = np.linalg.lstsq(np.array(rows), np.array(rhs), rcond=None)[0]
    return [r.point(lambda c, g=float(g): c.cast("double") * (max(g, 0.0) ** (1 / gamma)), "float") for r, g in zip(images, gains)]


def remosaic(history: list[dict], sources: dict[str, Raster], old: str, new: str) -> Raster:
    """Replays merge steps ({ref, sec, direction, dx, dy}) with renamed sources."""
    held = dict(sources)
    out = None
    for k, h in enumerate(history):
        name = lambda s: s if s.startswith("#") else s.replace(old, new)
        out = merge(held[name(h["ref"])], held[name(h["sec"])], h["direction"], h["dx"], h["dy"])
        held[f"#{k}"] = out
    return out


def matrixmultiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, v) matrices: an equi-join on the inner index and a sum."""
    left, right = a.select("y", F.col("x").alias("k"), F.col("v").alias("p")), b.select("x", F.col("y").alias("k"), F.col("v").alias("q"))
    return left.join(right, "k").groupBy("x", "y").agg(F.sum(F.col("p") * F.col("q")).alias("v"))


def matrixinvert(m: DataFrame) -> DataFrame:
    """Of a small matrix, on the driver."""
    rows = m.collect()
    n = max(r["x"] for r in rows) + 1
    a = np.zeros((n, n))
    for r in rows:
        a[r["y"], r["x"]] = r["v"]
    inv = np.linalg.inv(a)
    return m.sparkSession.createDataFrame([(x, y, float(inv[y, x])) for y in range(n) for x in range(n)], "x int, y int, v double")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("y").alias("x"), F.col("x").alias("y"), "v")


def matcat(ms: list[DataFrame]) -> DataFrame:
    """Stacks matrices downwards."""
    out, at = None, F.lit(0)
    for m in ms:
        one = m.select("x", (F.col("y") + at).alias("y"), "v")
        out = one if out is None else out.unionByName(one)
        at = F.lit(int(out.agg(F.max("y")).first()[0]) + 1)
    return out
