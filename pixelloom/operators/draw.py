"""Drawing: pure functions that repaint pixels by a predicate or by joined points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..raster import Raster, is_int, saturate


def _ink(r: Raster, ink) -> list[Column]:
    values = list(ink) if isinstance(ink, (list, tuple)) else [ink]
    values = values * r.bands if len(values) == 1 else values
    return [saturate(F.lit(v), r.format) for v in values]


def paint(r: Raster, where: Column, ink) -> Raster:
    return r.with_bands([F.when(where, i).otherwise(c) for c, i in zip(r.cols, _ink(r, ink))])


def _points(r: Raster, points: list[tuple[int, int]], ink) -> Raster:
    """A generated point set, bounded by the shape's outline, as a broadcast join."""
    inside = sorted({(x, y) for x, y in points if 0 <= x < r.width and 0 <= y < r.height})
    marks = r.df.sparkSession.createDataFrame(inside or [(-1, -1)], "x int, y int").withColumn("_on", F.lit(True))
    df = r.df.join(F.broadcast(marks), ["x", "y"], "left")
    return paint(r.having(df), F.col("_on").isNotNull(), ink)


def draw_rect(r: Raster, ink, left: int, top: int, width: int, height: int, fill=False) -> Raster:
    inside = (F.col("x") >= left) & (F.col("x") < left + width) & (F.col("y") >= top) & (F.col("y") < top + height)
    rim = (F.col("x") == left) | (F.col("x") == left + width - 1) | (F.col("y") == top) | (F.col("y") == top + height - 1)
    return paint(r, inside if fill else inside & rim, ink)


def draw_point(r: Raster, ink, x: int, y: int) -> Raster:
    return draw_rect(r, ink, x, y, 1, 1, True)


def line_points(x1, y1, x2, y2):
    """A one-pixel line: along the longer axis, the nearest pixel across (halves towards the end)."""
    n = max(abs(x2 - x1), abs(y2 - y1))
    if not n:
        return [(x1, y1)]
    half = lambda d, k: (2 * abs(d) * k + n) // (2 * n) * (1 if d >= 0 else -1)
    return [(x1 + half(x2 - x1, k), y1 + half(y2 - y1, k)) for k in range(n + 1)]


def draw_line(r: Raster, ink, x1, y1, x2, y2) -> Raster:
    return _points(r, line_points(x1, y1, x2, y2), ink)


def circle_spans(radius: int) -> dict[int, int]:
    """Half width of a filled midpoint circle at each vertical offset."""
    out: dict[int, int] = {}
    x, y, d = 0, radius, 3 - 2 * radius
    while x <= y:
        for a, b in ((x, y), (y, x)):
            for dy in (b, -b):
                out[dy] = max(out.get(dy, 0), a)
        if d < 0:
            d += 4 * x + 6
        else:
            d += 4 * (x - y) + 10
            y -= 1
        x += 1
    return out


def draw_circle(r: Raster, ink, cx: int, cy: int, radius: int, fill=False) -> Raster:
    if fill:
        spans = circle_spans(radius)
        table = F.create_map(*[F.lit(v) for kv in spans.items() for v in kv])
        half = F.element_at(table, F.col("y") - cy)
        return paint(r, (F.abs(F.col("y") - cy) <= radius) & (F.abs(F.col("x") - cx) <= F.coalesce(half, F.lit(-1))), ink)
    pts, x, y, d = [], 0, radius, 3 - 2 * radius
    while x <= y:
        pts += [(cx + sx * a, cy + sy * b) for a, b in ((x, y), (y, x)) for sx in (1, -1) for sy in (1, -1)]
        if d < 0:
            d += 4 * x + 6
        else:
            d += 4 * (x - y) + 10
            y -= 1
        x += 1
    return _points(r, pts, ink)


def draw_image(r: Raster, sub: Raster, x: int, y: int, mode="set") -> Raster:
    over = sub.df.select(*sub.keys, (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), *[F.col(c).alias(f"o{c[1:]}") for c in sub.names])
    df = r.df.join(over, sub.at, "left")
    take = lambda k: F.col(f"o{k if sub.bands > 1 else 0}")
    if mode == "add":
        values = [saturate(c.cast("long" if is_int(r.format) else "double") + F.coalesce(take(k), F.lit(0)), r.format) for k, c in enumerate(r.cols)]
    else:
        values = [F.coalesce(saturate(take(k), r.format), c) for k, c in enumerate(r.cols)]
    return r.having(df).with_bands(values)


def draw_mask(r: Raster, ink, mask: Raster, x: int, y: int) -> Raster:
    over = mask.df.select(*mask.keys, (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), F.col("b0").alias("m"))
    df = r.df.join(over, mask.at, "left").withColumn("m", F.coalesce("m", F.lit(0)).cast("long"))
    mixed = [(i.cast("long") * F.col("m") + c.cast("long") * (255 - F.col("m"))) / 255 if is_int(r.format) else (i * F.col("m") + c * (255 - F.col("m"))) / 255 for c, i in zip(r.cols, _ink(r, ink))]
    return r.having(df).with_bands([F.floor(v) if is_int(r.format) else v for v in mixed])


def draw_flood(r: Raster, ink, x: int, y: int) -> Raster:
    """Paints the 4-connected region of equal pixels around the seed, in each image."""
    from .morphology import regions

    found = regions(r.with_bands([r.cols[0]]))
    # One row for each image: all images of a stack have the seed at the same place.
    seed = found.df.where((F.col("x") == x) & (F.col("y") == y)).select(*r.keys, F.col("b0").alias("_label"), F.lit(True).alias("_seed"))
    labels = found.df.select(*r.at, F.col("b0").alias("_label"))
    df = r.df.join(labels, r.at).join(seed if r.keys else F.broadcast(seed), [*r.keys, "_label"], "left")
    return paint(r.having(df), F.col("_seed").isNotNull(), ink)


def draw_smudge(r: Raster, left, top, width, height) -> Raster:
    """Softens a rectangle: (16 p + sum of 3 x 3) / 25, from the pixels as they were."""
    from functools import reduce

    from .window2d import window2d

    s = lambda v: reduce(lambda a, b: a + b, v)
    df, sums = window2d(r, 3, 3, lambda _, k, t: [s([v.cast("long") for v in t])], lambda _, rows: [s([q[0] for q in rows])])
    inside = (F.col("x") >= left) & (F.col("x") < left + width) & (F.col("y") >= top) & (F.col("y") < top + height)
    return r.having(df).with_bands([F.when(inside, F.floor((16 * c + v) / 25)).otherwise(c) for c, v in zip(r.cols, sums)])
