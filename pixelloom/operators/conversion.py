"""Band, geometry, alpha and join operators: projections, filters, unions and coordinate arithmetic."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, functions as F

from ..functions import blend
from ..raster import BITS, RANGE, Raster, combine, grid, is_int, promoted, saturate, zip_join

MAX_ALPHA = {"rgb16": 65535, "grey16": 65535, "scrgb": 1}


def max_alpha(r: Raster) -> float:
    return MAX_ALPHA.get(r.interpretation, 255)


# --- bands -------------------------------------------------------------------------------------------------------

def extract_band(r: Raster, band: int, n=1) -> Raster:
    """Column pruning: the other bands are never read."""
    return r.with_bands(r.cols[band : band + n])


def bandjoin(rasters: list[Raster]) -> Raster:
    df, width, height = zip_join(rasters)
    from ..raster import common_format

    fmt = reduce(common_format, [r.format for r in rasters])
    return rasters[0].having(df, width=width, height=height).with_bands([F.col(f"i{n}_{c}") for n, r in enumerate(rasters) for c in r.names], fmt)


def bandjoin_const(r: Raster, values) -> Raster:
    return r.with_bands([*r.cols, *[saturate(F.lit(v), r.format) for v in values]])


def addalpha(r: Raster) -> Raster:
    return bandjoin_const(r, [max_alpha(r)])


def bandmean(r: Raster) -> Raster:
    """Mean of the bands; integers are rounded half away from zero."""
    total = sum([c.cast("long" if is_int(r.format) else "double") for c in r.cols[1:]], r.cols[0].cast("long" if is_int(r.format) else "double"))
    n = r.bands
    if is_int(r.format):
        half = F.lit(n // 2)
        return r.with_bands([F.when(total > 0, F.floor((total + half) / n)).otherwise(-F.floor((half - total) / n))])
    return r.with_bands([total / n])


def bandbool(r: Raster, operation: str) -> Raster:
    fn = {"and": Column.bitwiseAND, "or": Column.bitwiseOR, "eor": Column.bitwiseXOR}[operation]
    cast = [c.cast("long") if is_int(r.format) else saturate(c, "int").cast("long") for c in r.cols]
    return r.with_bands([reduce(fn, cast)], promoted("boolean", r.format))


def bandrank(rasters: list[Raster], index=-1) -> Raster:
    """The index-th smallest of n images at each pixel; the median by default."""
    index = len(rasters) // 2 if index < 0 else index
    return combine(rasters, lambda v: F.least(*v) if index == 0 and len(v) > 1 else F.greatest(*v) if index == len(v) - 1 and len(v) > 1 else F.element_at(F.sort_array(F.array(*v)), index + 1))


def bandfold(r: Raster, factor=0) -> Raster:
    """x into bands: neighbouring pixels become the bands of one."""
    factor = factor or r.width
    cell = F.col("x") % factor
    values = [F.max(F.when(cell == k, c)).alias(f"b{k * r.bands + j}") for k in range(factor) for j, c in enumerate(r.cols)]
    df = r.df.groupBy(*r.keys, F.expr(f"cast(x div {factor} as int)").alias("x"), "y").agg(*values)
    return r.having(df, width=r.width // factor, bands=factor * r.bands)


def bandunfold(r: Raster, factor=0) -> Raster:
    """Bands into x."""
    factor = factor or r.bands
    n = r.bands // factor
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"b{k * n + j}").alias(f"b{j}") for j in range(n)]) for k in range(factor)]))
    df = r.df.select(*r.at, rows.alias("p")).select(*r.keys, (F.col("x") * factor + F.col("p.k")).cast("int").alias("x"), "y", *[F.col(f"p.b{j}").alias(f"b{j}") for j in range(n)])
    return r.having(df, width=r.width * factor, bands=n)


def recomb(r: Raster, matrix: list[list[float]]) -> Raster:
    rows = [reduce(lambda a, b: a + b, [F.lit(float(m)) * c.cast("double") for m, c in zip(row, r.cols)]) for row in matrix]
    return r.with_bands(rows, promoted("math", r.format))


def msb(r: Raster, band=-1) -> Raster:
    """The most significant byte; signed values are offset by 128."""
    shift = BITS[r.format] - 8
    cols = r.cols if band < 0 else [r.cols[band]]
    off = 128 if RANGE[r.format][0] < 0 else 0
    return r.with_bands([F.shiftright(c.cast("long"), shift) + off for c in cols], "uchar")


def byteswap(r: Raster) -> Raster:
    n = BITS[r.format] // 8
    lo, hi = RANGE[r.format]

    def swap(c):
        v = c.cast("long")
        out = reduce(Column.bitwiseOR, [F.shiftleft(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255)), 8 * (n - 1 - k)) for k in range(n)])
        return F.when(out > hi, out - (1 << BITS[r.format])).otherwise(out) if lo < 0 else out

    return r.point(swap)


def cast(r: Raster, fmt: str, shift=False) -> Raster:
    """Saturating, truncating cast; ``shift`` moves bits between integer formats instead."""
    if shift and is_int(r.format) and is_int(fmt):
        up = BITS[fmt] - BITS[r.format]
        if up > 0:
            low = lambda c: (F.lit((1 << up) - 1) * c.cast("long").bitwiseAND(F.lit(1)))  # noqa: E731  the lowest bit fills up
            return r.point(lambda c: saturate(F.shiftleft(c.cast("long"), up) + low(c), fmt), fmt)
        return r.point(lambda c: saturate(F.shiftright(c.cast("long"), -up), fmt), fmt)
    if not is_int(r.format) and r.format not in ("float", "double"):
        return r.point(lambda c: saturate(c["re"], fmt), fmt)
    return r.cast(fmt)


def copy(r: Raster, **header) -> Raster:
    return r.having(r.df, **header)


# --- geometry ----------------------------------------------------------------------------------------------------

def extract_area(r: Raster, left: int, top: int, width: int, height: int) -> Raster:
    """A range filter, which reaches the scan where coordinates are stored."""
    inside = r.having(r.df.where((F.col("x") >= left) & (F.col("x") < left + width) & (F.col("y") >= top) & (F.col("y") < top + height)))
    return inside.moved(F.col("x") - left, F.col("y") - top, width=width, height=height)


crop = extract_area


def flip(r: Raster, direction: str) -> Raster:
    return r.moved(r.width - 1 - F.col("x"), F.col("y")) if direction == "horizontal" else r.moved(F.col("x"), r.height - 1 - F.col("y"))


def rot(r: Raster, angle: str) -> Raster:
    w, h = r.width, r.height
    if angle == "d90":
        return r.moved(h - 1 - F.col("y"), F.col("x"), width=h, height=w)
    if angle == "d180":
        return r.moved(w - 1 - F.col("x"), h - 1 - F.col("y"))
    if angle == "d270":
        return r.moved(F.col("y"), w - 1 - F.col("x"), width=h, height=w)
    return r


def autorot(r: Raster, orientation: int) -> Raster:
    """By the EXIF orientation 1..8."""
    turn = {1: "d0", 2: "d0", 3: "d180", 4: "d180", 5: "d90", 6: "d90", 7: "d270", 8: "d270"}[orientation]
    out = rot(r, turn)
    return flip(out, "horizontal") if orientation in (2, 4, 5, 7) else out


def rot45(r: Raster, steps=1) -> Raster:
    """Turns an odd square by 45 degrees: each ring moves along itself by its half side for each step."""
    c = r.width // 2
    u, v = F.col("x") - c, F.col("y") - c
    ring = F.greatest(F.abs(u), F.abs(v))
    # Place on the ring, clockwise from its top left corner: 0..8*ring-1.
    place = F.when((v == -ring) & (u < ring), u + ring).when((u == ring) & (v < ring), 2 * ring + v + ring).when((v == ring) & (u > -ring), 4 * ring + ring - u).otherwise(6 * ring + ring - v)
    q = F.when(ring == 0, F.lit(0)).otherwise((place + steps * ring) % F.greatest(8 * ring, F.lit(1)))
    side = F.floor(q / F.greatest(2 * ring, F.lit(1)))
    k = q - side * 2 * ring
    nx = F.when(side == 0, -ring + k).when(side == 1, ring).when(side == 2, ring - k).otherwise(-ring)
    ny = F.when(side == 0, -ring).when(side == 1, -ring + k).when(side == 2, ring).otherwise(ring - k)
    return r.moved(F.when(ring == 0, F.col("x")).otherwise(nx + c), F.when(ring == 0, F.col("y")).otherwise(ny + c))


def wrap(r: Raster, x=None, y=None) -> Raster:
    """Toroidal shift; by default the middle comes to the origin."""
    dx, dy = r.width // 2 if x is None else x, r.height // 2 if y is None else y
    return r.moved(F.pmod(F.col("x") + dx, F.lit(r.width)), F.pmod(F.col("y") + dy, F.lit(r.height)))


def transpose3d(r: Raster, page_height: int) -> Raster:
    pages = r.height // page_height
    page, row = F.expr(f"y div {page_height}"), F.col("y") % page_height
    return r.moved(F.col("x"), row * pages + page)


def subsample(r: Raster, xfac: int, yfac: int) -> Raster:
    w, h = r.width // xfac, r.height // yfac
    kept = r.having(r.df.where((F.col("x") % xfac == 0) & (F.col("y") % yfac == 0) & (F.col("x") < w * xfac) & (F.col("y") < h * yfac)))
    return kept.moved(F.expr(f"x div {xfac}"), F.expr(f"y div {yfac}"), width=w, height=h)


def _multiplied(r: Raster, across: int, down: int, x: Column, y: Column, **header) -> Raster:
    """Each pixel ``across * down`` times: generated in its own row, no join."""
    rows = r.df.select(*r.at, *r.names, F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_j"))
    return r.having(rows.select(*r.keys, x.cast("int").alias("x"), y.cast("int").alias("y"), *r.names), **header)


def zoom(r: Raster, xfac: int, yfac: int) -> Raster:
    return _multiplied(r, xfac, yfac, F.col("x") * xfac + F.col("_i"), F.col("y") * yfac + F.col("_j"), width=r.width * xfac, height=r.height * yfac)


def replicate(r: Raster, across: int, down: int) -> Raster:
    return _multiplied(r, across, down, F.col("x") + F.col("_i") * r.width, F.col("y") + F.col("_j") * r.height, width=r.width * across, height=r.height * down)


def grid_(r: Raster, tile_height: int, across: int, down: int) -> Raster:
    """A tall strip of tiles into a grid."""
    t = F.expr(f"y div {tile_height}")
    return r.moved(F.col("x") + (t % across) * r.width, F.col("y") % tile_height + F.floor(t / across) * tile_height, width=r.width * across, height=tile_height * down)


def _fill(r: Raster, width: int, height: int, background) -> Raster:
    """Pixels that are missing from the canvas get the background; canvases without gaps skip this."""
    values = list(background) if isinstance(background, (list, tuple)) else [background]
    values = values * r.bands if len(values) == 1 else values
    canvas = grid(r.df.sparkSession, width, height, r)
    out = canvas.join(r.df, r.at, "left")
    return r.having(out.select(*r.at, *[F.coalesce(c, saturate(F.lit(v), r.format)).alias(n) for c, n, v in zip(r.cols, r.names, values)]), width=width, height=height)


def embed(r: Raster, x: int, y: int, width: int, height: int, extend="black", background=0) -> Raster:
    """On a canvas; copy, repeat and mirror generate the copies of each pixel in its own row.

    ``extend``: black, copy, repeat, mirror, white, background.
    """
    if extend in ("black", "white", "background"):
        fill = 0 if extend == "black" else (RANGE[r.format][1] if is_int(r.format) else 255) if extend == "white" else background
        moved = r.having(r.df.where((F.col("x") + x >= 0) & (F.col("x") + x < width) & (F.col("y") + y >= 0) & (F.col("y") + y < height))).moved(F.col("x") + x, F.col("y") + y)
        return _fill(moved, width, height, fill)

    def places(c: Column, size: int, offset: int, total: int) -> Column:
        """All coordinates of the canvas that show coordinate c."""
        at = c + offset
        if extend == "copy":
            low = F.when(c == 0, F.sequence(F.lit(0), F.greatest(F.lit(0), at - 1))).otherwise(F.array().cast("array<int>"))
            low = F.when((c == 0) & (at > 0), low).otherwise(F.array().cast("array<int>"))
            high = F.when((c == size - 1) & (at < total - 1), F.sequence(at + 1, F.greatest(at + 1, F.lit(total - 1)))).otherwise(F.array().cast("array<int>"))
            return F.concat(low, F.array(at.cast("int")), high)
        period = size if extend == "repeat" else 2 * size

        def every(start: Column) -> Column:
            first = F.pmod(start, F.lit(period)).cast("int")
            return F.when(first < total, F.sequence(first, F.greatest(first, F.lit(total - 1)), F.lit(period))).otherwise(F.array().cast("array<int>"))

        return every(at) if extend == "repeat" else F.concat(every(at), every(2 * size - 1 - c + offset))

    rows = r.df.select(*r.keys, F.explode(places(F.col("x"), r.width, x, width)).alias("_x"), "y", *r.names).select(*r.keys, F.col("_x").alias("x"), F.explode(places(F.col("y"), r.height, y, height)).alias("_y"), *r.names)
    rows = rows.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("_y") >= 0) & (F.col("_y") < height))
    return r.having(rows.select(*r.keys, "x", F.col("_y").alias("y"), *r.names), width=width, height=height)


def gravity(r: Raster, direction: str, width: int, height: int, extend="black", background=0) -> Raster:
    x = 0 if "west" in direction else width - r.width if "east" in direction else (width - r.width) // 2
    y = 0 if "north" in direction else height - r.height if "south" in direction else (height - r.height) // 2
    return embed(r, x, y, width, height, extend, background)


def insert(main: Raster, sub: Raster, x: int, y: int, expand=False, background=0) -> Raster:
    """Pastes: the main image without the covered rectangle (a filter), and the moved sub image."""
    from ..raster import common_format

    fmt = common_format(main.format, sub.format)
    main, sub = main.cast(fmt), sub.cast(fmt)
    dx, dy, width, height = 0, 0, main.width, main.height
    if expand:
        dx, dy = max(0, -x), max(0, -y)
        width, height = max(main.width, x + sub.width) + dx, max(main.height, y + sub.height) + dy
    covered = (F.col("x") >= x) & (F.col("x") < x + sub.width) & (F.col("y") >= y) & (F.col("y") < y + sub.height)
    kept = main.having(main.df.where(~covered)).moved(F.col("x") + dx, F.col("y") + dy)
    put = sub.moved(F.col("x") + x + dx, F.col("y") + y + dy)
    put = put.df.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    out = main.having(kept.df.unionByName(put), width=width, height=height)
    return _fill(out, width, height, background) if expand else out


def join(left: Raster, right: Raster, direction: str, expand=False, shim=0, background=0, align="low") -> Raster:
    side = (left.height, right.height) if direction == "horizontal" else (left.width, right.width)
    off = {"low": 0, "centre": (side[0] - side[1]) // 2, "high": side[0] - side[1]}[align]
    x, y = (left.width + shim, off) if direction == "horizontal" else (off, left.height + shim)
    out = insert(left, right, x, y, True, background)
    if expand:
        return out
    least = min(side)
    top = max(0, -off) + max(0, off)
    if direction == "horizontal":
        return extract_area(out, 0, top, out.width, least)
    return extract_area(out, top, 0, least, out.height)


def arrayjoin(rasters: list[Raster], across=None, shim=0, background=0, halign="low", valign="low", hspacing=None, vspacing=None) -> Raster:
    across = across or len(rasters)
    w, h = hspacing or max(r.width for r in rasters), vspacing or max(r.height for r in rasters)
    down = -(-len(rasters) // across)
    where = lambda a, size, own: {"low": 0, "centre": (size - own) // 2, "high": size - own}[a]
    parts = None
    for k, r in enumerate(rasters):
        one = r.moved(F.col("x") + (k % across) * (w + shim) + where(halign, w, r.width), F.col("y") + (k // across) * (h + shim) + where(valign, h, r.height)).df
        parts = one if parts is None else parts.unionByName(one)
    width, height = across * (w + shim) - shim, down * (h + shim) - shim
    return _fill(rasters[0].having(parts), width, height, background)


# --- choice ------------------------------------------------------------------------------------------------------

def ifthenelse(cond: Raster, then: Raster, other: Raster, blend_=False) -> Raster:
    from ..raster import common_format

    fmt = common_format(then.format, other.format)
    df, w, h = zip_join([cond, then, other])
    bands = max(then.bands, other.bands, cond.bands)
    pick = lambda n, r, k: F.col(f"i{n}_b{k if r.bands > 1 else 0}")
    values = []
    for k in range(bands):
        c, a, b = pick(0, cond, k), saturate(pick(1, then, k), fmt), saturate(pick(2, other, k), fmt)
        if blend_:
            v = c.cast("long")
            values.append(F.floor((v * a + (255 - v) * b + 128) / 255) if is_int(fmt) else (v * a + (255 - v) * b) / 255)
        else:
            values.append(F.when(c != 0, a).otherwise(b))
    return then.having(df, width=w, height=h, keys=next((r.keys for r in (cond, then, other) if r.keys), ())).with_bands(values, fmt)


def switch(tests: list[Raster]) -> Raster:
    """Number of the first non-zero test, or the count of tests."""
    df, w, h = zip_join(tests)
    out = F.lit(len(tests))
    for k in reversed(range(len(tests))):
        out = F.when(F.col(f"i{k}_b0") != 0, F.lit(k)).otherwise(out)
    return tests[0].having(df, width=w, height=h).with_bands([out], "uchar")


# --- alpha and range ---------------------------------------------------------------------------------------------

def flatten(r: Raster, background=0, max_alpha_=255.0) -> Raster:
    """Over a background, without the last band."""
    bg = list(background) if isinstance(background, (list, tuple)) else [background] * (r.bands - 1)
    *colour, alpha = r.cols
    v = [(c.cast("double") * alpha + F.lit(float(b)) * (F.lit(max_alpha_) - alpha)) / max_alpha_ for c, b in zip(colour, bg)]
    return r.with_bands([F.floor(x) if is_int(r.format) else x for x in v])


def premultiply(r: Raster, max_alpha_=255.0) -> Raster:
    *colour, alpha = r.cols
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(max_alpha_), alpha.cast("double")))
    return r.with_bands([*[c.cast("double") * clipped / max_alpha_ for c in colour], alpha], promoted("math", r.format))


def unpremultiply(r: Raster, max_alpha_=255.0) -> Raster:
    *colour, alpha = r.cols
    a = alpha.cast("double")
    return r.with_bands([*[F.when(a == 0, F.lit(0.0)).otherwise(c.cast("double") * max_alpha_ / a) for c in colour], F.greatest(F.lit(0.0), F.least(F.lit(max_alpha_), a))], promoted("math", r.format))


def gamma(r: Raster, exponent=2.4) -> Raster:
    """v ** (1 / exponent), so scaled that the format's largest value stays."""
    top = float(RANGE[r.format][1]) if is_int(r.format) else 1.0
    norm = top ** (1 / exponent) / top
    v = lambda c: F.pow(c.cast("double"), F.lit(1 / exponent)) / norm
    return r.point(lambda c: saturate(F.floor(v(c) + 0.5), r.format) if r.format in ("uchar", "ushort") else v(c), r.format if r.format in ("uchar", "ushort") else "float")


def scale(r: Raster, log=False, exp=0.25) -> Raster:
    """Stretch to 0..255 by the extremes of each image."""
    lo, hi = F.min(F.least(*r.cols, r.cols[0])).cast("double").alias("_lo"), F.max(F.greatest(*r.cols, r.cols[0])).cast("double").alias("_hi")
    ends = r.df.groupBy(*r.keys).agg(lo, hi)
    # One row for a single image is broadcast; one for each image of a stack is joined by key.
    df = r.df.join(ends, list(r.keys)) if r.keys else r.df.join(F.broadcast(ends))
    lo, hi = F.col("_lo"), F.col("_hi")

    def value(c):
        if log:
            f = 255.0 / F.log10(1.0 + F.pow(hi, F.lit(exp)))
            return f * F.log10(1.0 + F.pow(c.cast("double"), F.lit(exp)))
        return (c.cast("double") - lo) * (255.0 / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo))

    return r.having(df).with_bands([F.when(hi == lo, F.lit(0)).otherwise(saturate(F.floor(value(c) + 0.5), "uchar")) for c in r.cols], "uchar")


def falsecolour(r: Raster) -> Raster:
    """Mono to three bands along a hot-body ramp (black, blue, red, yellow, white)."""
    v = r.cols[0].cast("double")
    ramp = lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v - a) * 255.0 / (b - a)))
    return r.with_bands([F.floor(ramp(64, 160)), F.floor(ramp(128, 224)), F.floor(F.when(v < 96, ramp(0, 64)).when(v < 192, 255.0 - ramp(96, 160)).otherwise(ramp(192, 255)))], "uchar", interpretation="srgb")


def composite2(base: Raster, overlay: Raster, mode: str, x=0, y=0, premultiplied=False) -> Raster:
    """Blends an overlay with alpha over a base with alpha; bands are scaled to 0..1."""
    moved = overlay.moved(F.col("x") + x, F.col("y") + y)
    right = moved.df.select(*base.at, *[F.col(c).alias(f"o{c[1:]}") for c in moved.names])
    df = base.df.join(right, base.at, "left")
    n, top = base.bands - 1, float(max_alpha(base))
    unit = lambda c: F.coalesce(c.cast("double"), F.lit(0.0)) / top
    a, b = [unit(F.col(f"o{k}")) for k in range(n)], [unit(c) for c in base.cols[:n]]
    aa, ab = unit(F.col(f"o{n}")), unit(base.cols[n])
    if not premultiplied:
        a, b = [v * aa for v in a], [v * ab for v in b]
    out, alpha = blend.mix(mode, a, aa, b, ab)
    if not premultiplied:
        out = [F.when(alpha == 0, F.lit(0.0)).otherwise(v / alpha) for v in out]
    final = [v * top for v in [*out, alpha]]
    if is_int(base.format):
        return base.having(df).with_bands([saturate(F.floor(v + 0.5), base.format) for v in final])
    return base.having(df).with_bands(final, "float")


def composite(images: list[Raster], modes: list[str], xs=None, ys=None) -> Raster:
    out = images[0]
    for k, (r, mode) in enumerate(zip(images[1:], modes)):
        out = composite2(out, r, mode, xs[k] if xs else 0, ys[k] if ys else 0)
    return out


INTERESTING = ("none", "low", "centre", "entropy", "attention", "specific", "high", "all")
#: Side of the square in which attention looks for the place, and its skin colour (fixed values).
ATTENTION, SKIN = 32, (0.78, 0.57, 0.44)


def _entropy(counts: np.ndarray) -> float:
    """Entropy in bits of a histogram."""
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def entropy_place(image: np.ndarray, width: int, height: int) -> tuple[int, int]:
    """(left, top) after slices of less entropy have been taken off the sides, in about eight steps."""
    h, w, _ = image.shape
    flat = np.clip(image, 0, 255).astype(np.uint8) if image.max(initial=0) <= 255 else np.clip(image, 0, 65535).astype(np.uint16)
    score = lambda part: _entropy(np.bincount(part.reshape(-1)))
    left = top = 0
    most = max(-(-(w - width) // 8), -(-(h - height) // 8))
    while w > width or h > height:
        across, down = min(w - width, most), min(h - height, most)
        if across > 0:
            a, b = flat[top : top + h, left : left + across], flat[top : top + h, left + w - across : left + w]
            w -= across
            left += across if score(a) < score(b) else 0
        if down > 0:
            a, b = flat[top : top + down, left : left + w], flat[top + h - down : top + h, left : left + w]
            h -= down
            top += down if score(a) < score(b) else 0
    return left, top


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The pixel dy below and dx right of each; beyond the edges the nearest."""
    ys, xs = np.clip(np.arange(a.shape[0]) + dy, 0, a.shape[0] - 1), np.clip(np.arange(a.shape[1]) + dx, 0, a.shape[1] - 1)
    return a[np.ix_(ys, xs)]


def _blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(np.ceil(sigma * np.sqrt(-2 * np.log(0.2)))))
    weight = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    weight /= weight.sum()
    a = sum(w * _shifted(a, k, 0) for k, w in zip(range(-reach, reach + 1), weight))
    return sum(w * _shifted(a, 0, k) for k, w in zip(range(-reach, reach + 1), weight))


def attention_place(image: np.ndarray, width: int, height: int) -> tuple[int, int]:
    """(left, top) of the crop around the place of most edge, skin colour and saturation in a shrunk image."""
    h, w, bands = image.shape
    cut = lambda size: (np.arange(ATTENTION + 1) * size / ATTENTION).round().astype(int)
    ys, xs = cut(h), cut(w)
    held = np.pad(image.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0), (0, 0)))
    y0, y1 = np.minimum(ys[:-1], h - 1), np.maximum(ys[1:], np.minimum(ys[:-1], h - 1) + 1)
    x0, x1 = np.minimum(xs[:-1], w - 1), np.maximum(xs[1:], np.minimum(xs[:-1], w - 1) + 1)
    area = ((y1 - y0)[:, None] * (x1 - x0)[None, :])[:, :, None]
    small = (held[np.ix_(y1, x1)] - held[np.ix_(y0, x1)] - held[np.ix_(y1, x0)] + held[np.ix_(y0, x0)]) / area
    rgb = small[:, :, :3] if bands >= 3 else np.repeat(small[:, :, :1], 3, 2)
    v = np.clip(rgb / 255, 0, 1)
    light = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    # Linear light of sRGB to XYZ under D65, and its white.
    xyz = light @ np.array([[0.4124, 0.2126, 0.0193], [0.3576, 0.7152, 0.1192], [0.1805, 0.0722, 0.9505]]) * 100
    luminance = xyz[:, :, 1]
    edge = np.abs(5 * (4 * luminance - sum(_shifted(luminance, *d) for d in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    bright = luminance > 5
    unit = xyz / np.maximum(np.sqrt((xyz**2).sum(2, keepdims=True)), 1e-12)
    skin = np.where(bright, 100 - 100 * np.sqrt(((unit - np.array(SKIN)) ** 2).sum(2)), 0)
    f = lambda t: np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    saturation = np.where(bright, 500 * (f(xyz[:, :, 0] / 95.047) - f(luminance / 100)), 0)
    sigma = max(np.hypot(width * ATTENTION / w, height * ATTENTION / h) / 10, 1.0)
    total = _blurred(edge + skin + saturation, sigma)
    y, x = divmod(int(total.argmax()), ATTENTION)
    place = lambda at, size, own: int(np.clip(int(at * size / ATTENTION) - own // 2, 0, size - own))
    return place(x, w, width), place(y, h, height)


def smartcrop(r: Raster, width: int, height: int, interesting="centre", at=(0, 0)) -> Raster:
    """Crop by interest, each image of a stack by its own; ``at`` is the middle of a specific crop.

    entropy and attention look at a whole image in one task, which gives one row; the crop itself is a join and a filter.
    """
    if interesting not in INTERESTING:
        raise ValueError(f"interesting is one of {', '.join(INTERESTING)}")
    if interesting in ("none", "low"):
        return extract_area(r, 0, 0, width, height)
    if interesting == "high":
        return extract_area(r, r.width - width, r.height - height, width, height)
    if interesting == "all":
        return r
    if interesting == "centre":
        return extract_area(r, (r.width - width) // 2, (r.height - height) // 2, width, height)
    if interesting == "specific":
        inside = lambda p, own, size: max(0, min(size - own, p - own // 2))
        return extract_area(r, inside(at[0], width, r.width), inside(at[1], height, r.height), width, height)
    place = entropy_place if interesting == "entropy" else attention_place
    # Transparent areas do not count: bands with alpha are multiplied by it.
    seen = premultiply(r) if r.bands in (2, 4) else r
    keys, w, h, names = list(r.keys), r.width, r.height, r.names[: r.bands - (r.bands in (2, 4))]

    def find(part):
        image = np.zeros((h, w, len(names)))
        y, x = part["y"].to_numpy(), part["x"].to_numpy()
        for k, name in enumerate(names):
            image[y, x, k] = part[name].to_numpy()
        left, top = place(image, width, height)
        return part.head(1)[keys].assign(_x=left, _y=top)

    pixels = seen.df.select(*seen.at, *[F.col(n).cast("double").alias(n) for n in names])
    schema = ", ".join([*[f"{k} {r.df.schema[k].dataType.simpleString()}" for k in keys], "_x int, _y int"])
    box = (pixels.groupBy(*keys) if keys else pixels.withColumn("_one", F.lit(1)).groupBy("_one")).applyInPandas(find, schema)
    df = (r.df.join(box, keys) if keys else r.df.join(F.broadcast(box))).where((F.col("x") >= F.col("_x")) & (F.col("x") < F.col("_x") + width) & (F.col("y") >= F.col("_y")) & (F.col("y") < F.col("_y") + height))
    return r.having(df).moved(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"), width=width, height=height)


# --- caches ------------------------------------------------------------------------------------------------------

def cache(r: Raster) -> Raster:
    """Keeps computed pixels in memory and on disk; also stands for tile and line caches."""
    return r.having(r.df.persist())


def sequential(r: Raster) -> Raster:
    """Rows in order within each partition, for sinks that stream."""
    return r.having(r.df.sortWithinPartitions("y", "x"))

