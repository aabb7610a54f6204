"""The data model: a raster is a pixel relation with a typed header.

``df`` holds one row for each pixel, ``keys`` (which image of a stack), ``x``, ``y`` and one
column ``b0..bN`` for each band.  Operators take and return rasters and only build plans; a
stack of images passes through every operator as one relation, keyed by ``keys``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

# Storage of each band format, and its range where it is an integer.
STORAGE = {"uchar": "short", "char": "byte", "ushort": "int", "short": "short", "uint": "long", "int": "int", "float": "float", "double": "double",
           "complex": "struct<re:float,im:float>", "dpcomplex": "struct<re:double,im:double>"}
RANGE = {"uchar": (0, 255), "char": (-128, 127), "ushort": (0, 65535), "short": (-32768, 32767), "uint": (0, 4294967295), "int": (-2147483648, 2147483647)}
BITS = {"uchar": 8, "char": 8, "ushort": 16, "short": 16, "uint": 32, "int": 32}
FORMATS = ("uchar", "char", "ushort", "short", "uint", "int", "float", "complex", "double", "dpcomplex")

# Common format of two integer formats, in the order of FORMATS.
_COMMON = {
    "uchar": ("uchar", "short", "ushort", "short", "uint", "int"), "char": ("short", "char", "int", "short", "int", "int"),
    "ushort": ("ushort", "int", "ushort", "int", "uint", "int"), "short": ("short", "short", "int", "short", "int", "int"),
    "uint": ("uint", "int", "uint", "int", "uint", "int"), "int": ("int", "int", "int", "int", "int", "int"),
}
# Output format of an operator by its common input format, in the order of FORMATS.
PROMOTE = {
    "add": "ushort short uint int uint int float complex double dpcomplex",
    "subtract": "short short int int int int float complex double dpcomplex",
    "divide": "float float float float float float float complex double dpcomplex",
    "math": "float float float float float float float complex double dpcomplex",
    "sum": "uint int uint int uint int float complex double dpcomplex",
    "relational": "uchar uchar uchar uchar uchar uchar uchar uchar uchar uchar",
    "boolean": "uchar char ushort short uint int int int int int",
    "abs": "uchar char ushort short uint int float float double double",
    "sign": "char char char char char char char complex char dpcomplex",
    "same": "uchar char ushort short uint int float complex double dpcomplex",
    "complex": "complex complex complex complex complex complex complex complex dpcomplex dpcomplex",
    "hist_cum": "uint int uint int uint int float float double double",
    "project": "uint int uint int uint int double double double double",
}


def promoted(table: str, fmt: str) -> str:
    return PROMOTE[table].split()[FORMATS.index(fmt)]


def is_int(fmt: str) -> bool:
    return fmt in RANGE


def is_complex(fmt: str) -> bool:
    return fmt in ("complex", "dpcomplex")


def common_format(a: str, b: str) -> str:
    if is_int(a) and is_int(b):
        return _COMMON[a][FORMATS.index(b)]
    double = "double" in (a, b) or "dpcomplex" in (a, b)
    if is_complex(a) or is_complex(b):
        return "dpcomplex" if double else "complex"
    return "double" if double else "float"


def saturate(value: Column, fmt: str) -> Column:
    """Clip to the format's range and truncate; the clip comes first, as casts raise on overflow."""
    if not is_int(fmt):
        return value.cast(STORAGE[fmt])
    lo, hi = RANGE[fmt]
    # greatest and least pass over nulls, which must stay: a missing pixel is no extreme value.
    return F.when(value.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), value)).cast(STORAGE[fmt]))


def store(value: Column, fmt: str) -> Column:
    """Into storage, where the value is known to fit."""
    return value.cast(STORAGE[fmt])


@dataclass(frozen=True)
class Raster:
    df: DataFrame
    width: int
    height: int
    bands: int = 1
    format: str = "uchar"
    interpretation: str = "multiband"
    keys: tuple = ()
    meta: tuple = ()

    @property
    def at(self) -> list[str]:
        return [*self.keys, "x", "y"]

    @property
    def names(self) -> list[str]:
        return [f"b{k}" for k in range(self.bands)]

    @property
    def cols(self) -> list[Column]:
        return [F.col(c) for c in self.names]

    def having(self, df: DataFrame, **header) -> Raster:
        return replace(self, df=df, **header)

    def with_bands(self, values: list[Column], fmt: str | None = None, **header) -> Raster:
        """Replaces the bands: a narrow projection."""
        fmt = fmt or self.format
        out = [v.cast(STORAGE[fmt]).alias(f"b{k}") for k, v in enumerate(values)]
        return self.having(self.df.select(*self.at, *out), bands=len(values), format=fmt, **header)

    def point(self, fn, fmt: str | None = None, **header) -> Raster:
        return self.with_bands([fn(c) for c in self.cols], fmt, **header)

    def moved(self, x: Column, y: Column, **header) -> Raster:
        """New coordinates for the same pixels."""
        out = self.df.select(*self.keys, x.cast("int").alias("x"), y.cast("int").alias("y"), *self.names)
        return self.having(out, **header)

    def cast(self, fmt: str) -> Raster:
        return self if fmt == self.format else self.point(lambda c: saturate(c, fmt), fmt)

    def image(self, key="img") -> DataFrame:
        return self.df

    def __add__(self, o):
        return _ops().add(self, o)

    def __sub__(self, o):
        return _ops().subtract(self, o)

    def __mul__(self, o):
        return _ops().multiply(self, o)

    def __truediv__(self, o):
        return _ops().divide(self, o)

    def __mod__(self, o):
        return _ops().remainder(self, o)

    def __lt__(self, o):
        return _ops().relational(self, o, "less")

    def __le__(self, o):
        return _ops().relational(self, o, "lesseq")

    def __gt__(self, o):
        return _ops().relational(self, o, "more")

    def __ge__(self, o):
        return _ops().relational(self, o, "moreeq")

    def __and__(self, o):
        return _ops().boolean(self, o, "and")

    def __or__(self, o):
        return _ops().boolean(self, o, "or")

    def __xor__(self, o):
        return _ops().boolean(self, o, "eor")

    def __lshift__(self, o):
        return _ops().boolean(self, o, "lshift")

    def __rshift__(self, o):
        return _ops().boolean(self, o, "rshift")


def _ops():
    from .operators import arithmetic

    return arithmetic


def from_table(df: DataFrame, x: Column, y: Column, bands: list[Column], width: int, height: int, fmt="uchar", interpretation="multiband", keys=()) -> Raster:
    out = [b.cast(STORAGE[fmt]).alias(f"b{k}") for k, b in enumerate(bands)]
    return Raster(df.select(*keys, x.cast("int").alias("x"), y.cast("int").alias("y"), *out), width, height, len(bands), fmt, interpretation, tuple(keys))


def zero(fmt: str) -> Column:
    return F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")).cast(STORAGE[fmt]) if is_complex(fmt) else F.lit(0).cast(STORAGE[fmt])


def zip_join(rasters: list[Raster], pad=True) -> tuple[DataFrame, int, int]:
    """One row for each pixel of the largest size with columns ``i{n}_b{k}``; missing pixels are zero.

    Equal sizes need only an inner equi-join on the coordinates.  An image without keys meets every image of a stack.
    """
    stacks = [r for r in rasters if r.keys]
    if stacks and not rasters[0].keys:
        order = [rasters.index(stacks[0]), *[n for n, r in enumerate(rasters) if r is not stacks[0]]]
    else:
        order = list(range(len(rasters)))
    width, height = max(r.width for r in rasters), max(r.height for r in rasters)
    same = all((r.width, r.height) == (width, height) for r in rasters)
    out, at = None, rasters[order[0]].at
    for n in order:
        r = rasters[n]
        if not same and r.keys != rasters[order[0]].keys:
            raise ValueError("an image without keys meets a stack of another size: embed it first")
        one = r.df.select(*r.at, *[F.col(c).alias(f"i{n}_{c}") for c in r.names])
        out = one if out is None else out.join(one, r.at if same else at, "inner" if same else "full")
    if not same and pad:
        zeros = [F.coalesce(f"i{n}_{c}", zero(r.format)).alias(f"i{n}_{c}") for n, r in enumerate(rasters) for c in r.names]
        out = out.select(*at, *zeros)
    return out, width, height


def combine(rasters: list[Raster], fn, table="same", decoded=True, **header) -> Raster:
    """An n-ary pixel operator: formats alike, one band replicated to n, sizes zero-padded, then ``fn(values)`` for each band."""
    fmt = rasters[0].format
    for r in rasters[1:]:
        fmt = common_format(fmt, r.format)
    bands = max(r.bands for r in rasters)
    out = promoted(table, fmt)
    df, width, height = zip_join(rasters)
    values = []
    for k in range(bands):
        args = [F.col(f"i{n}_b{k if r.bands > 1 else 0}") for n, r in enumerate(rasters)]
        values.append(fn([saturate(a, fmt) if not is_complex(fmt) else a for a in args]))
    base = replace(rasters[0], df=df, width=width, height=height, keys=next((r.keys for r in rasters if r.keys), ()))
    return base.with_bands(values, out, **header)


def grid(spark, width: int, height: int, like: Raster | None = None) -> DataFrame:
    """All coordinates of a raster, split over tasks by rows; with ``like`` those of each image of its stack, keys first."""
    if like is not None and like.keys:
        rows = like.df.select(*like.keys).distinct().select(*like.keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
        return rows.select(*like.keys, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), "y")
    w = F.lit(width).cast("long")
    return spark.range(width * height).select((F.col("id") % w).cast("int").alias("x"), F.expr(f"cast(id div {width} as int)").alias("y"))
