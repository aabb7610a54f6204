"""Arithmetic, relational, boolean and complex point operators, statistics and Hough transforms."""

from __future__ import annotations

import math as _math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..raster import BITS, RANGE, Raster, combine, is_complex, is_int, promoted, saturate, zip_join


def _wide(c: Column, fmt: str) -> Column:
    return c.cast("long") if is_int(fmt) else c.cast("double")


def _const(r: Raster, values) -> list:
    """One constant for each band; a single constant serves all bands, and several make bands of one."""
    values = list(values) if isinstance(values, (list, tuple)) else [values]
    return values * max(r.bands, 1) if len(values) == 1 else values


def _banded(r: Raster, n: int) -> list[Column]:
    return r.cols if r.bands == n else r.cols * n


def _pair(left: Raster, right, fn, table: str) -> Raster:
    if not isinstance(right, Raster):
        values = _const(left, right)
        fmt = promoted(table, left.format)
        return left.with_bands([fn(c, F.lit(v), fmt) for c, v in zip(_banded(left, len(values)), values)], fmt)
    fmt = None

    def both(args):
        return fn(args[0], args[1], fmt)

    from ..raster import common_format

    fmt = promoted(table, common_format(left.format, right.format))
    return combine([left, right], both, table)


def _re(c):
    return c["re"].cast("double")


def _im(c):
    return c["im"].cast("double")


def _z(re, im):
    return F.struct(re.alias("re"), im.alias("im"))


def add(left: Raster, right) -> Raster:
    """Sum, one size wider than the inputs."""
    return _pair(left, right, lambda a, b, f: _z(_re(a) + _re(b), _im(a) + _im(b)) if is_complex(f) else _wide(a, f) + _wide(b, f), "add")


def subtract(left: Raster, right) -> Raster:
    return _pair(left, right, lambda a, b, f: _z(_re(a) - _re(b), _im(a) - _im(b)) if is_complex(f) else _wide(a, f) - _wide(b, f), "subtract")


def multiply(left: Raster, right) -> Raster:
    return _pair(left, right, lambda a, b, f: _z(_re(a) * _re(b) - _im(a) * _im(b), _re(a) * _im(b) + _im(a) * _re(b)) if is_complex(f) else _wide(a, f) * _wide(b, f), "add")


def divide(left: Raster, right) -> Raster:
    """Quotient as a float; division by zero gives zero."""

    def fn(a, b, f):
        if is_complex(f):
            d = _re(b) * _re(b) + _im(b) * _im(b)
            return F.when(d == 0, _z(F.lit(0.0), F.lit(0.0))).otherwise(_z((_re(a) * _re(b) + _im(a) * _im(b)) / d, (_im(a) * _re(b) - _re(a) * _im(b)) / d))
        return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))

    return _pair(left, right, fn, "divide")


def remainder(left: Raster, right) -> Raster:
    """Integers: truncated remainder, -1 for a zero divisor; floats: a - b * floor(a / b)."""

    def fn(a, b, f):
        if is_int(f):
            return F.when(b == 0, F.lit(RANGE[f][1] if RANGE[f][0] == 0 else -1)).otherwise(a.cast("long") % b.cast("long"))  # all bits set
        return F.when(b == 0, F.lit(-1.0)).otherwise(a - b * F.floor(a / b))

    return _pair(left, right, fn, "same")


def maxpair(left: Raster, right) -> Raster:
    return _pair(left, right, lambda a, b, f: F.greatest(a, b), "same")


def minpair(left: Raster, right) -> Raster:
    return _pair(left, right, lambda a, b, f: F.least(a, b), "same")


def sum_(rasters: list[Raster]) -> Raster:
    """N-ary sum: one shuffle over the union, whatever the number of images."""
    fmt = rasters[0].format
    from ..raster import common_format

    for r in rasters[1:]:
        fmt = common_format(fmt, r.format)
    out, bands = promoted("sum", fmt), max(r.bands for r in rasters)
    parts = None
    for r in rasters:
        one = r.df.select(*r.at, *[_wide(c, r.format).alias(f"b{k}") for k, c in enumerate(_banded(r, bands))])
        parts = one if parts is None else parts.unionByName(one)
    df = parts.groupBy(*rasters[0].at).agg(*[F.sum(f"b{k}").alias(f"b{k}") for k in range(bands)])
    base = rasters[0].having(df, bands=bands, width=max(r.width for r in rasters), height=max(r.height for r in rasters))
    return base.with_bands(base.cols, out)


RELATIONS = {"equal": lambda a, b: a == b, "noteq": lambda a, b: a != b, "less": lambda a, b: a < b, "lesseq": lambda a, b: a <= b, "more": lambda a, b: a > b, "moreeq": lambda a, b: a >= b}


def relational(left: Raster, right, relation: str) -> Raster:
    """255 where the relation holds, else 0; complex values compare by modulus; a NaN equals nothing."""
    op = RELATIONS[relation]

    def fn(a, b, f):
        holds = op(a, b)
        if relation in ("equal", "noteq") and not is_int(left.format) and not is_complex(left.format):
            nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
            holds = F.when(nan, F.lit(relation == "noteq")).otherwise(holds)
        return F.when(holds, F.lit(255)).otherwise(F.lit(0))

    return _pair(left, right, fn, "relational")


def boolean(left: Raster, right, operation: str) -> Raster:
    """Bitwise and, or, eor, lshift, rshift; floats are truncated to 32-bit integers first."""

    def fn(a, b, f):
        lo, hi = RANGE[f]
        a, b = (saturate(v, "int").cast("long") if not is_int(left.format) else v.cast("long") for v in (a, b))
        if operation in ("lshift", "rshift"):
            shift = b.cast("int")
            v = F.call_function("shiftleft", a, shift) if operation == "lshift" else F.call_function("shiftright", a, shift)
        else:
            v = {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "eor": a.bitwiseXOR(b)}[operation]
        # Back into the format's width, two's complement where it is signed.
        v = v.bitwiseAND(F.lit((1 << BITS[f]) - 1))
        return F.when(v > hi, v - (1 << BITS[f])).otherwise(v) if lo < 0 else v

    return _pair(left, right, fn, "boolean")


def _deg(c):
    return F.degrees(c)


def _within(fn):
    """An arc function of values from -1 to 1.  Outside, Java's own is a NaN whose sign the processor sets; this one has none."""
    return lambda v: F.when((F.abs(v) > 1) & ~F.isnan(v), F.lit(float("nan"))).otherwise(fn(v))


# Functions of one value in degrees where angles are concerned; logarithms of zero are zero.
MATH = {
    "sin": lambda v: F.sin(F.radians(v)), "cos": lambda v: F.cos(F.radians(v)), "tan": lambda v: F.tan(F.radians(v)),
    "asin": lambda v: _deg(_within(F.asin)(v)), "acos": lambda v: _deg(_within(F.acos)(v)), "atan": lambda v: _deg(F.atan(v)),
    "log": lambda v: F.when(v == 0, F.lit(0.0)).otherwise(F.log(v)), "log10": lambda v: F.when(v == 0, F.lit(0.0)).otherwise(F.log10(v)),
    "exp": F.exp, "exp10": lambda v: F.pow(F.lit(10.0), v), "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
}


def math(r: Raster, function: str) -> Raster:
    fmt = promoted("math", r.format)
    return r.point(lambda c: MATH[function](c.cast("double")), fmt)


def _pow(a, b):
    return F.when(a == 0, F.lit(0.0)).when(b == -1, 1 / F.when(a == 0, F.lit(1.0)).otherwise(a)).when(b == 0.5, F.sqrt(a)).otherwise(F.pow(a, b))


def _atan2(a, b):
    d = F.degrees(F.atan2(a, b))
    return F.when(d < 0, d + 360).otherwise(d)


MATH2 = {"pow": _pow, "wop": lambda a, b: _pow(b, a), "atan2": _atan2}


def math2(left: Raster, right, function: str) -> Raster:
    return _pair(left, right, lambda a, b, f: MATH2[function](a.cast("double"), b.cast("double")), "math")


def round_(r: Raster, how: str) -> Raster:
    """rint (half to even), ceil, floor; integers pass unchanged."""
    if is_int(r.format):
        return r
    fn = {"rint": F.rint, "ceil": F.ceil, "floor": F.floor}[how]
    return r.point(lambda c: fn(c.cast("double")))


def abs_(r: Raster) -> Raster:
    fmt = promoted("abs", r.format)
    return r.point(lambda c: F.hypot(_re(c), _im(c)) if is_complex(r.format) else F.abs(c), fmt)


def sign(r: Raster) -> Raster:
    if is_complex(r.format):
        m = lambda c: F.hypot(_re(c), _im(c))
        return r.point(lambda c: F.when(m(c) == 0, _z(F.lit(0.0), F.lit(0.0))).otherwise(_z(_re(c) / m(c), _im(c) / m(c))))
    return r.point(lambda c: F.signum(c.cast("double")), "char")


def invert(r: Raster) -> Raster:
    if is_complex(r.format):
        return r.point(lambda c: _z(-_re(c), _im(c)))
    top = RANGE.get(r.format, (0, 0))
    return r.point(lambda c: F.lit(top[1]) - c if r.format in ("uchar", "ushort", "uint") else saturate(-c.cast("long" if is_int(r.format) else "double"), r.format))


def linear(r: Raster, a, b, uchar=False) -> Raster:
    """a * v + b as a float, or clipped and truncated to uchar."""
    n = max(r.bands, len(a) if isinstance(a, (list, tuple)) else 1, len(b) if isinstance(b, (list, tuple)) else 1)
    grow = lambda v: (list(v) if isinstance(v, (list, tuple)) else [v]) * (n if not isinstance(v, (list, tuple)) or len(v) == 1 else 1)
    values = [F.lit(float(x)) * c.cast("double") + F.lit(float(y)) for x, c, y in zip(grow(a), _banded(r, n), grow(b))]
    if uchar:
        return r.with_bands([F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v))) for v in values], "uchar")
    return r.with_bands(values, promoted("math", r.format))


def clamp(r: Raster, lo=0.0, hi=1.0) -> Raster:
    return r.point(lambda c: F.greatest(F.lit(lo), F.least(F.lit(hi), c.cast("double"))))


def complexform(left: Raster, right: Raster) -> Raster:
    return combine([left, right], lambda v: _z(v[0].cast("double"), v[1].cast("double")), "complex")


def complexget(r: Raster, part: str) -> Raster:
    return r.point(lambda c: c["re" if part == "real" else "im"], promoted("abs", r.format))


def complex_(r: Raster, how: str) -> Raster:
    """polar: (modulus, degrees in [0, 360)); rect: its inverse; conj."""

    def fn(c):
        re, im = (_re(c), _im(c)) if is_complex(r.format) else (c.cast("double"), F.lit(0.0))
        if how == "polar":
            return _z(F.hypot(re, im), _atan2(im, re))
        if how == "rect":
            return _z(re * F.cos(F.radians(im)), re * F.sin(F.radians(im)))
        return _z(re, -im)

    return r.point(fn, promoted("complex", r.format))


def cross_phase(left: Raster, right: Raster) -> Raster:
    """a * conj(b) over its modulus; zero where either is zero."""

    def fn(v):
        a, b = v
        re, im = _re(a) * _re(b) + _im(a) * _im(b), _im(a) * _re(b) - _re(a) * _im(b)
        m = F.hypot(re, im)
        return F.when(m == 0, _z(F.lit(0.0), F.lit(0.0))).otherwise(_z(re / m, im / m))

    return combine([left, right], fn, "complex")


# --- statistics: partial aggregates on every task, one small final row ------------------------------------------

def long_form(r: Raster) -> DataFrame:
    """(keys, x, y, band, v)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), c.cast("double").alias("v")) for k, c in enumerate(r.cols)]))
    return r.df.select(*r.at, pairs.alias("p")).select(*r.at, "p.band", "p.v")


def _all(r: Raster):
    """Sums over the bands of a row first: one aggregate a row, no explosion."""
    vs = [c.cast("double") for c in r.cols]
    total = sum(vs[1:], vs[0])
    squares = sum([v * v for v in vs[1:]], vs[0] * vs[0])
    return F.sum(total), F.sum(squares), F.count(F.lit(1)) * r.bands


def avg(r: Raster) -> DataFrame:
    s, _, n = _all(r)
    return r.df.groupBy(*r.keys).agg((s / n).alias("avg"))


def deviate(r: Raster) -> DataFrame:
    s, q, n = _all(r)
    return r.df.groupBy(*r.keys).agg(F.sqrt(F.abs(q - s * s / n) / (n - 1)).alias("deviate"))


def extremes(r: Raster, largest: bool, size=1) -> DataFrame:
    """The size largest (smallest) values of each image with their places; ties by y, then x.  Top-k, not a sort."""
    v = F.col("v").desc() if largest else F.col("v").asc()
    if r.keys:
        w = Window.partitionBy(*r.keys).orderBy(v, "y", "x", "band")
        return long_form(r).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).select(*r.keys, "x", "y", "band", "v")
    return long_form(r).orderBy(v, "y", "x", "band").limit(size).select("x", "y", "band", "v")


def stats(r: Raster) -> DataFrame:
    """A row for each band and one (band -1) for all: min, max, sum, sum2, avg, sd, and the places of min and max."""
    v = F.col("v")
    n, s, q = F.count(F.lit(1)), F.sum("v"), F.sum(v * v)
    lo, hi = F.min(F.struct("v", "y", "x")), F.min(F.struct((-v).alias("v"), "y", "x"))
    keys = [F.col(k) for k in r.keys]
    out = long_form(r).groupingSets([[*keys, F.col("band")], keys], *keys, F.col("band")).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), s.alias("sum"), q.alias("sum2"), (s / n).alias("avg"), F.sqrt(F.abs(q - s * s / n) / (n - 1)).alias("sd"),
        lo["x"].alias("xmin"), lo["y"].alias("ymin"), hi["x"].alias("xmax"), hi["y"].alias("ymax"))
    return out.withColumn("band", F.coalesce("band", F.lit(-1)))


def getpoint(r: Raster, x: int, y: int) -> DataFrame:
    return r.df.where((F.col("x") == x) & (F.col("y") == y)).select(*r.keys, *r.names)


def hist_find(r: Raster, band=-1) -> DataFrame:
    """(keys, band, bin, n): counts of each value of each image, zero-filled over the format's bins."""
    one = long_form(r) if band < 0 else long_form(r).where(F.col("band") == band)
    counts = one.groupBy(*r.keys, "band", F.greatest(F.lit(0), F.least(F.lit(255 if r.format == "uchar" else 65535), F.col("v"))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*r.keys).agg(F.max("bin").alias("top"))
    size = top.select(*r.keys, F.explode(F.sequence(F.lit(0), F.lit(255) if r.format == "uchar" else F.col("top"))).alias("bin"))
    bands = F.array(*[F.lit(k) for k in (range(r.bands) if band < 0 else [band])])
    dense = size.select(*r.keys, "bin", F.explode(bands).alias("band"))
    return dense.join(counts, [*r.keys, "band", "bin"], "left").select(*r.keys, "band", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def hist_find_indexed(r: Raster, index: Raster, how="sum") -> DataFrame:
    """(keys, bin, b0..): values combined by the index image's value."""
    df, _, _ = zip_join([r, index])
    fn = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    return df.groupBy(*(r.keys or index.keys), F.col("i1_b0").cast("int").alias("bin")).agg(*[fn(F.col(f"i0_{c}").cast("double")).alias(c) for c in r.names])


def hist_find_ndim(r: Raster, bins=10) -> DataFrame:
    """Counts in a grid of bins**bands cells of each image, occupied cells only."""
    step = ((255 if r.format == "uchar" else 65535) + 1) / bins
    cells = [F.floor(c / step).cast("int").alias(f"c{k}") for k, c in enumerate(r.cols[:3])]
    return r.df.groupBy(*r.keys, *cells).agg(F.count(F.lit(1)).alias("n"))


def _lines(df: DataFrame, keys, aggs) -> DataFrame:
    """Aggregates of each column and of each row of each image, in one pass."""
    keys = [F.col(k) for k in keys]
    return df.groupingSets([[*keys, F.col("x")], [*keys, F.col("y")]], *keys, F.col("x"), F.col("y")).agg(*aggs)


def project(r: Raster, how="sum") -> DataFrame:
    """Column and row sums (or max, min) in one pass: (keys, axis, pos, b0..)."""
    fn = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    out = _lines(r.df, r.keys, [fn(c.cast("double")).alias(n) for c, n in zip(r.cols, r.names)])
    return out.select(*r.keys, F.when(F.col("x").isNotNull(), "column").otherwise("row").alias("axis"), F.coalesce("x", "y").alias("pos"), *r.names)


def profile(r: Raster) -> DataFrame:
    """First non-zero row of each column and column of each row; the size where there is none."""
    hits = [F.min(F.when(c != 0, F.col("_y"))).alias(f"y{k}") for k, c in enumerate(r.cols)] + [F.min(F.when(c != 0, F.col("_x"))).alias(f"x{k}") for k, c in enumerate(r.cols)]
    got = _lines(r.df.withColumns({"_x": F.col("x"), "_y": F.col("y")}), r.keys, hits)
    column = F.col("x").isNotNull()
    return got.select(*r.keys, F.when(column, "column").otherwise("row").alias("axis"), F.coalesce("x", "y").alias("pos"),
                      *[F.when(column, F.coalesce(f"y{k}", F.lit(r.height))).otherwise(F.coalesce(f"x{k}", F.lit(r.width))).alias(f"b{k}") for k in range(r.bands)])


def find_trim(r: Raster, threshold=10.0, background=None) -> DataFrame:
    """Bounding box, in each image, of what differs from the background, after a median of 3 x 3."""
    from .morphology import rank

    bg = list(background) if background else [0.0] * r.bands
    m = rank(r, 3, 3, 4)
    differs = None
    for c, b in zip(m.cols, bg * (r.bands if len(bg) == 1 else 1)):
        one = F.abs(c.cast("double") - F.lit(float(b))) > threshold
        differs = one if differs is None else differs | one
    at = lambda c: F.when(differs, F.col(c))
    box = m.df.groupBy(*r.keys).agg(F.min(at("x")).alias("left"), F.min(at("y")).alias("top"), F.max(at("x")).alias("r"), F.max(at("y")).alias("b"))
    return box.select(*r.keys, F.coalesce("left", F.lit(r.width)).alias("left"), F.coalesce("top", F.lit(r.height)).alias("top"),
                      F.coalesce(F.col("r") - F.col("left") + 1, F.lit(0)).alias("width"), F.coalesce(F.col("b") - F.col("top") + 1, F.lit(0)).alias("height"))


def measure(r: Raster, across: int, down: int, left=0, top=0, width=None, height=None) -> DataFrame:
    """Mean of the central half of each patch of a chart: (h, v, b0..)."""
    w, h = (width or r.width) / across, (height or r.height) / down
    i, j = F.floor((F.col("x") - left) / w), F.floor((F.col("y") - top) / h)
    dx, dy = F.col("x") - left - i * w, F.col("y") - top - j * h
    inside = (i >= 0) & (i < across) & (j >= 0) & (j < down) & (dx >= w / 4) & (dx < w * 3 / 4) & (dy >= h / 4) & (dy < h * 3 / 4)
    return r.df.where(inside).groupBy(*r.keys, i.cast("int").alias("h"), j.cast("int").alias("v")).agg(*[F.avg(c.cast("double")).alias(n) for c, n in zip(r.cols, r.names)])


def hough_line(r: Raster, width=256, height=256) -> DataFrame:
    """(x: angle, y: distance, n) votes of the non-zero pixels, for cells with votes.

    Each pixel's votes are generated in its own row and counted by partial aggregates.
    """
    diagonal = F.lit(_math.hypot(r.width, r.height))
    points = r.df.where(F.col("b0") != 0).select(*r.keys, (F.col("x") / diagonal).alias("u"), (F.col("y") / diagonal).alias("v"))
    votes = points.select(*r.keys, "u", "v", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    angle = F.col("x") * F.lit(_math.pi / width)
    rho = F.col("u") * F.cos(angle) + F.col("v") * F.sin(angle)
    cell = F.floor((rho + 1) * (height / 2.0)).cast("int")
    return votes.select(*r.keys, "x", cell.alias("y")).where((F.col("y") >= 0) & (F.col("y") < height)).groupBy(*r.keys, "x", "y").agg(F.count(F.lit(1)).alias("n"))


def circle_offsets(radius: int) -> list[tuple[int, int]]:
    """Points of a one-pixel circle: in each octant the integer nearest to the circle."""
    out = set()
    for x in range(int(radius / _math.sqrt(2)) + 1):
        y = int(_math.sqrt(radius * radius - x * x) + 0.5)
        out |= {(sx * a, sy * b) for a, b in ((x, y), (y, x)) for sx in (1, -1) for sy in (1, -1)}
    return sorted(out)


def hough_circle(r: Raster, scale=1, min_radius=10, max_radius=20) -> DataFrame:
    """(x, y, radius, n): votes for circle centres."""
    offsets = [(dx, dy, k) for k in range(min_radius // scale, max_radius // scale + 1) for dx, dy in circle_offsets(k)]
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(k * scale).alias("radius")) for a, b, k in offsets]))
    votes = r.df.where(F.col("b0") != 0).select(*r.keys, (F.col("x") / scale).cast("int").alias("cx"), (F.col("y") / scale).cast("int").alias("cy"), around.alias("o"))
    at = votes.select(*r.keys, (F.col("cx") + F.col("o.dx")).alias("x"), (F.col("cy") + F.col("o.dy")).alias("y"), F.col("o.radius").alias("radius"))
    return at.where(f"x >= 0 and y >= 0 and x < {r.width // scale} and y < {r.height // scale}").groupBy(*r.keys, "x", "y", "radius").agg(F.count(F.lit(1)).alias("n"))


# --- texture and regression helpers of the older surface ---------------------------------------------------------

def cooccurrence(r: Raster, dx=1, dy=0) -> DataFrame:
    """(a, b, n): how often value b stands at (dx, dy) from value a."""
    other = r.df.select(*r.keys, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("b0").alias("b"))
    return r.df.select(*r.at, F.col("b0").alias("a")).join(other, r.at).groupBy(*r.keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def texture(r: Raster, dx=1, dy=0) -> DataFrame:
    """Angular second moment, contrast and entropy of the co-occurrence matrix."""
    m = cooccurrence(r, dx, dy).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*r.keys)))
    return m.groupBy(*r.keys).agg(F.sum(F.col("p") * F.col("p")).alias("asm"), F.sum(F.col("p") * F.pow(F.col("a") - F.col("b"), 2)).alias("contrast"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def differences(r: Raster, dx=1, dy=0) -> DataFrame:
    """Grey-level difference statistics: (d, n)."""
    return cooccurrence(r, dx, dy).groupBy(*r.keys, F.abs(F.col("a") - F.col("b")).alias("d")).agg(F.sum("n").alias("n"))


def linreg(rasters: list[Raster], xs: list[float]) -> DataFrame:
    """Pixelwise linear regression over images at positions xs: (x, y, intercept, slope)."""
    parts = None
    for r, t in zip(rasters, xs):
        one = r.df.select(*r.at, F.col("b0").cast("double").alias("v"), F.lit(float(t)).alias("t"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(*rasters[0].at).agg(F.regr_intercept("v", "t").alias("intercept"), F.regr_slope("v", "t").alias("slope"))


def zerox(r: Raster, sign_=1) -> Raster:
    """255 where the value crosses zero to the right in the direction of the sign."""
    nxt = F.lead("b0").over(Window.partitionBy(*r.keys, "y").orderBy("x"))
    cond = (F.col("b0") >= 0) & (nxt < 0) if sign_ < 0 else (F.col("b0") < 0) & (nxt >= 0)
    return r.having(r.df.select(*r.at, F.when(cond, 255).otherwise(0).cast("short").alias("b0")), bands=1, format="uchar")

