"""Morphology, rank filters, lines, regions and nearest fill."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from ..raster import Raster, is_int
from .window2d import window2d

LABELS = 1 << 16
BLOCK_PIXELS = 1 << 22
FILL_PIXELS = 1 << 16


def morph(r: Raster, mask: list[list[int]], operation: str) -> Raster:
    """Erode (all match) or dilate (any matches) with a mask of 0, 255 and 128 for either."""
    erode = operation == "erode"

    def row(_, k, t):
        hits = [(v != 0) if m == 255 else (v == 0) for m, v in zip(mask[k], t) if m != 128]
        return [reduce(lambda a, b: (a & b) if erode else (a | b), hits) if hits else F.lit(erode)]

    def total(_, rows):
        hits = [x[0] for x in rows]
        return [F.when(reduce(lambda a, b: (a & b) if erode else (a | b), hits), 255).otherwise(0)]

    df, values = window2d(r, len(mask[0]), len(mask), row, total)
    return r.having(df).with_bands(values, "uchar")


def rank(r: Raster, width: int, height: int, index: int) -> Raster:
    """The index-th smallest value of each window; least and greatest need no sort."""
    last = width * height - 1
    if index in (0, last) and last:
        fn = (lambda v: F.least(*v) if len(v) > 1 else v[0]) if index == 0 else (lambda v: F.greatest(*v) if len(v) > 1 else v[0])
        df, values = window2d(r, width, height, lambda _, k, t: [fn(t)], lambda _, rows: [fn([x[0] for x in rows])])
        return r.having(df).with_bands(values)
    df, values = window2d(r, width, height, lambda _, k, t: [F.array(*t)], lambda _, rows: [F.element_at(F.array_sort(F.concat(*[x[0] for x in rows])), index + 1)])
    return r.having(df).with_bands(values)


def median(r: Raster, size=3) -> Raster:
    return rank(r, size, size, size * size // 2)


def countlines(r: Raster, direction: str):
    """Mean number of black-to-white transitions along the direction's lines, of each image."""
    part, order, n = ("x", "y", r.width) if direction == "horizontal" else ("y", "x", r.height)
    before = F.lag("b0").over(Window.partitionBy(*r.keys, part).orderBy(order))
    steps = r.df.select(*r.keys, ((F.col("b0") >= 128) & (before < 128)).alias("up"))
    return steps.groupBy(*r.keys).agg((F.sum(F.when(F.col("up"), 1).otherwise(0)) / F.lit(float(n))).alias("nolines"))


def block_labels(x, y, v, width: int):
    """Labels of the 4-connected regions of equal values among these pixels: the least scan position of each.

    Touching pixels are links; labels fall to the least over links and by pointer jumping, all pixels at once.
    """
    at = y.astype(np.int64) * width + x
    order = np.argsort(at, kind="stable")
    at, v = at[order], v[order]
    label = np.arange(len(at))
    pairs = []
    for step in (1, width):
        there = np.searchsorted(at, at + step)
        there = np.minimum(there, len(at) - 1)
        ok = (at[there] == at + step) & (v[there] == v)
        if step == 1:
            ok &= at % width != width - 1
        pairs.append((np.flatnonzero(ok), there[ok]))
    a, b = (np.concatenate(p) for p in zip(*pairs))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        # The roots of both ends fall to the lower root, then every pixel follows its root.
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    out = np.empty(len(at), np.int64)
    out[order] = at[label]
    return out


def regions(r: Raster, block_pixels=BLOCK_PIXELS) -> Raster:
    """4-connected regions of equal pixels; a region's label is the scan position of its first pixel.

    Blocks of whole rows of an image, of bounded size, are labelled each in one vectorised pass.  Only where an image has
    several blocks do the labels that touch across their edges become links, and labels fall to the least over these
    by star contraction, whose rounds grow with the logarithm of the number of blocks.
    """
    from ..plans.contraction import smallest_reachable

    rows = max(1, block_pixels // r.width)
    keys = list(r.keys)
    cut = r.df.select(*r.at, "b0", F.expr(f"y div {rows}").alias("block"))
    schema = ", ".join([*[f"{k} {r.df.schema[k].dataType.simpleString()}" for k in keys], "x int, y int, v double, label long"])
    width = r.width

    def run(part):
        part["label"] = block_labels(part["x"].to_numpy(), part["y"].to_numpy(), part["v"].to_numpy(), width)
        return part[[*keys, "x", "y", "v", "label"]]

    found = cut.select(*keys, "block", "x", "y", F.col("b0").cast("double").alias("v")).groupBy(*keys, "block").applyInPandas(run, schema)
    if rows < r.height:
        edge = F.col("y") % rows
        upper = found.where(edge == rows - 1).select(*keys, "x", (F.col("y") + 1).alias("y"), "v", F.col("label").alias("l"))
        touch = found.where((edge == 0) & (F.col("y") > 0)).join(upper, [*keys, "x", "y", "v"]).select(*keys, "l", "label").distinct()
        name = (lambda c: F.xxhash64(*keys, c)) if keys else (lambda c: F.col(c))
        held = touch.select(*keys, F.explode(F.array("l", "label")).alias("label")).distinct().select(*keys, "label", name("label").alias("u"))
        roots = smallest_reachable(touch.select(name("l").alias("a"), name("label").alias("b")))
        named = held.join(roots, "u", "left").select(*keys, "label", F.coalesce("v", "u").alias("root"))
        least = named.groupBy(*keys, "root").agg(F.min("label").alias("least"))
        named = named.join(least, [*keys, "root"]).select(*keys, "label", "least")
        found = found.join(named, [*keys, "label"], "left").withColumn("label", F.coalesce("least", "label"))
    return Raster(found.select(*keys, "x", "y", F.col("label").alias("b0")), r.width, r.height, 1, "uint", keys=r.keys)


def labelregions(r: Raster) -> Raster:
    """Regions of each image numbered 0, 1, .. in scan order of their first pixels."""
    found = regions(r)
    keys = list(r.keys)
    # Numbers come from counts of label ranges and a rank within each range: no task holds all labels.
    labels = found.df.select(*keys, "b0").distinct().withColumn("part", F.expr(f"b0 div {LABELS}"))
    before = labels.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("k"))
    before = before.select(*keys, "part", (F.sum("k").over(Window.partitionBy(*keys).orderBy("part")) - F.col("k")).alias("base"))
    order = labels.join(before, [*keys, "part"]).select(*keys, "b0", (F.col("base") + F.row_number().over(Window.partitionBy(*keys, "part").orderBy("b0")) - 1).alias("n"))
    return found.having(found.df.join(order, [*keys, "b0"]).select(*keys, "x", "y", F.col("n").cast("long").alias("b0")))


def nearest_columns(away, sy):
    """For each place of each line the column s with the least (x - s)^2 + away[line, s], then the least (sy, s): (squares, columns).

    The best columns of a line never fall from left to right, whichever is taken of equals, so that the best of a place lies
    between those of the places beside it that are settled: halving strides look at O(W log W) columns of a line.
    """
    h, w = away.shape
    best, square = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
    stride = 1 << w.bit_length()
    while stride := stride >> 1:
        x = np.arange(stride - 1, w, 2 * stride)
        if not len(x):
            continue
        low = np.where(x >= stride, best[:, np.maximum(x - stride, 0)], 0).reshape(-1)
        high = np.where(x + stride < w, best[:, np.minimum(x + stride, w - 1)], w - 1).reshape(-1)
        count = high - low + 1
        start = np.cumsum(count) - count
        s = np.arange(count.sum()) - np.repeat(start - low, count)
        line = np.repeat(np.repeat(np.arange(h), len(x)), count)
        d = (np.repeat(np.tile(x, h), count) - s) ** 2 + away[line, s]
        least = np.minimum.reduceat(d, start)
        tied = np.where(d == np.repeat(least, count), sy[line, s] * w + s, np.iinfo(np.int64).max)
        best[:, x] = (np.minimum.reduceat(tied, start) % w).reshape(h, -1)
        square[:, x] = least.reshape(h, -1)
    return square, best


def block_nearest(x, y, v, edges, width: int):
    """(values, squared distances) of these pixels' nearest non-zero pixels; None without any.

    ``edges``: (x, ay, av, by, bv), the nearest non-zero pixel of each column above and below the block, y under 0 where there is none.
    """
    top, h = int(y.min()), int(y.max() - y.min()) + 1
    ex, ay, av, by, bv = edges
    rows = np.full((h + 2, width), -1, np.int64)  # y of non-zero pixels, between the edges' rows
    values = np.zeros((h + 2, width), v.dtype)
    rows[0, ex], values[0, ex], rows[-1, ex], values[-1, ex] = ay, av, by, bv
    seed = v != 0
    at = (y[seed] - top + 1, x[seed])
    rows[at], values[at] = y[seed], v[seed]
    if (rows < 0).all():
        return None
    k = np.arange(h + 2)[:, None]
    up = np.maximum.accumulate(np.where(rows >= 0, k, -1))[1:-1]
    down = np.minimum.accumulate(np.where(rows >= 0, k, h + 2)[::-1])[::-1][1:-1]
    cols, line = np.arange(width), np.arange(top, top + h)[:, None]
    over, under = rows[np.maximum(up, 0), cols], rows[np.minimum(down, h + 1), cols]
    upper = (up >= 0) & ((down > h + 1) | (line - over <= under - line))
    none = (up < 0) & (down > h + 1)
    sy = np.where(none, 0, np.where(upper, over, under))
    away = np.where(none, 1 << 60, (line - sy) ** 2)
    square, best = nearest_columns(away, sy)
    y = y - top
    s = best[y, x]
    return values[np.where(upper, up, down)[y, s], s], square[y, x]


def fill_nearest(r: Raster, block_pixels=FILL_PIXELS):
    """Zeros take the nearest non-zero pixel of their image: (keys, x, y, b0, distance); ties go to the smaller (y, x).

    A distance transform in blocks of whole rows.  What a block has to know of the others is the nearest non-zero pixel of
    each column above and below it, from the first and last ones of all blocks.  In a block, each column's nearest
    pixels come from running extremes, and each line's best columns from halving strides.
    Where pixels are missing, so are their rows; an image of zeros has none.
    """
    keys, width = list(r.keys), r.width
    rows = max(1, block_pixels // width)
    kind = "long" if is_int(r.format) else "double"
    cut = r.df.select(*r.at, F.col("b0").cast(kind).alias("v"), F.expr(f"y div {rows}").alias("block"))
    seed = F.struct("y", "v")
    ends = cut.where("v <> 0").groupBy(*keys, "block", "x").agg(F.min(seed).alias("first"), F.max(seed).alias("last"))
    places = cut.select(*keys, "block").distinct().select(*keys, "block", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    column = Window.partitionBy(*keys, "x")
    # Both frames begin without bound: one that ends without bound is worked out anew for each row.
    above, below = (column.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("block"), F.desc("block")))
    edges = places.join(ends, [*keys, "block", "x"], "left").select(*keys, "block", "x", F.last("last", True).over(above).alias("a"), F.last("first", True).over(below).alias("b"))
    edges = edges.where("a is not null or b is not null").select(*[F.col(k).alias(f"_{k}") for k in (*keys, "block")], "x", *[F.coalesce(f"{s}.{c}", F.lit(none)).alias(f"{s}{c}") for s in "ab" for c, none in (("y", -1), ("v", 0))])

    def run(pixels: pa.Table, edge: pa.Table) -> pa.Table:
        x, y, v = (pixels[c].fill_null(0).to_numpy() for c in ("x", "y", "v"))
        got = block_nearest(x.astype(np.int64), y.astype(np.int64), v, [edge[c].to_numpy() for c in ("x", "ay", "av", "by", "bv")], width)
        if got is None:
            pixels, got = pixels.slice(0, 0), (v[:0], np.zeros(0))
        return pa.table([*[pixels[c] for c in (*keys, "x", "y")], pa.array(got[0]), pa.array(np.sqrt(got[1].astype(np.float64)))], names=[*keys, "x", "y", "b0", "distance"])

    schema = ", ".join([*[f"{k} {r.df.schema[k].dataType.simpleString()}" for k in keys], "x int, y int", f"b0 {kind}", "distance double"])
    return cut.groupBy(*keys, "block").cogroup(edges.groupBy(*[f"_{k}" for k in (*keys, "block")])).applyInArrow(run, schema)
