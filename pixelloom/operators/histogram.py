"""Histograms and lookup tables: relations (bin, b0..bN), small by construction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..raster import Raster, is_int, saturate, zip_join
from . import arithmetic
from .window2d import window2d


def wide(counts: DataFrame, bands: int) -> DataFrame:
    """(keys, band, bin, n) into (keys, bin, b0..bN)."""
    return counts.groupBy(*[c for c in counts.columns if c not in ("band", "bin", "n")], "bin").agg(*[F.sum(F.when(F.col("band") == k, F.col("n"))).alias(f"b{k}") for k in range(bands)])


def _bands(lut: DataFrame) -> list[str]:
    return [c for c in lut.columns if c.startswith("b") and c[1:].isdigit()]


def _keys(lut: DataFrame) -> list[str]:
    """What tells the tables of a stack apart."""
    return [c for c in lut.columns if c != "bin" and not (c.startswith("b") and c[1:].isdigit())]


def table_of(lut) -> DataFrame:
    """A lookup table (keys, bin, b0..) from a raster of one line or one column; tables pass."""
    if not isinstance(lut, Raster):
        return lut
    if min(lut.width, lut.height) != 1:
        raise ValueError("a lookup table is one line or one column")
    return lut.df.select(*lut.keys, F.col("x" if lut.height == 1 else "y").alias("bin"), *lut.names)


def hist_cum(hist) -> DataFrame:
    """Running sums over the bins; a table has as many rows as values, so one window serves."""
    hist = table_of(hist)
    w = Window.partitionBy(*_keys(hist)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select(*_keys(hist), "bin", *[F.sum(c).over(w).alias(c) for c in _bands(hist)])


def hist_norm(hist) -> DataFrame:
    """Scales each band so that its largest value becomes the last bin; truncated."""
    hist = table_of(hist)
    w = Window.partitionBy(*_keys(hist))
    last = F.count(F.lit(1)).over(w) - 1
    # The factor is found first, then applied, as a linear step would.
    return hist.select(*_keys(hist), "bin", *[F.floor((F.col(c).cast("double") * (last / F.max(c).over(w))).cast("float")).cast("long").alias(c) for c in _bands(hist)])


def hist_equal(r: Raster, band=-1) -> Raster:
    h = wide(arithmetic.hist_find(r, band), r.bands)
    return maplut(r, hist_norm(hist_cum(h)), "uchar")


def hist_entropy(hist) -> DataFrame:
    hist = table_of(hist)
    keys = _keys(hist)
    total = F.sum("b0").over(Window.partitionBy(*keys))
    p = hist.select(*keys, (F.col("b0") / total).alias("p"))
    return p.groupBy(*keys).agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("entropy"))


def hist_ismonotonic(hist) -> DataFrame:
    hist = table_of(hist)
    keys = _keys(hist)
    step = F.col("b0") - F.lag("b0").over(Window.partitionBy(*keys).orderBy("bin"))
    return hist.select(*keys, step.alias("d")).groupBy(*keys).agg(F.coalesce(F.min("d") >= 0, F.lit(True)).alias("monotonic"))


def hist_match(cum, ref) -> DataFrame:
    """For each bin the first reference bin that reaches its cumulative value: an as-of join over bounded tables.  The reference
    is one table for all, or one for each image."""
    cum, ref = table_of(cum), table_of(ref)
    keys = _keys(ref)
    pairs = ref.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", F.col("b0").alias("r")))).alias("_ref"))
    first = F.get(F.filter("_ref", lambda s: s["r"] >= F.col("b0")), F.lit(0))["bin"]
    joined = cum.join(pairs, keys) if keys else cum.join(F.broadcast(pairs))
    return joined.select(*_keys(cum), "bin", F.coalesce(first, F.lit(255)).cast("long").alias("b0"))


def hist_plot(hist) -> DataFrame:
    """Bars: (keys, x, y, v), 255 where the bar reaches y."""
    hist = table_of(hist)
    keys = _keys(hist)
    top = F.max("b0").over(Window.partitionBy(*keys))
    bars = hist.select(*keys, F.col("bin").alias("x"), "b0", top.cast("long").alias("top"))
    rows = bars.select(*keys, "x", "b0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") - 1)).alias("y"))
    return rows.select(*keys, "x", F.col("y").cast("int").alias("y"), F.when(F.col("b0") > F.col("y"), 255).otherwise(0).alias("v"))


def maplut(r: Raster, lut, fmt="double", size=None) -> Raster:
    """Looks each pixel up in the table, a relation or a raster of one line: a hash join for each band.  One table for all
    images is bounded by its format and broadcast; tables of a stack are joined by key, whatever their number.

    Values beyond the table take its last entry.
    """
    lut = table_of(lut)
    names, keys = _bands(lut), _keys(lut)
    n = size or (256 if r.format == "uchar" else 65536)
    df = r.df
    bands = max(r.bands, len(names))
    values = []
    for k in range(bands):
        src, ent = f"b{k if r.bands > 1 else 0}", names[k if len(names) > 1 else 0]
        one = lut.select(*keys, F.col("bin").cast("int").alias(f"_i{k}"), F.col(ent).alias(f"_v{k}"))
        index = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(src).cast("int")))
        df = df.withColumn(f"_i{k}", index).join(one if keys else F.broadcast(one), [*keys, f"_i{k}"], "left")
        values.append(F.col(f"_v{k}"))
    return r.having(df).with_bands(values, fmt)


def case(index: Raster, cases: list[Raster]) -> Raster:
    """The image whose number the index holds; larger indexes take the last."""
    df, w, h = zip_join([index, *cases])
    n = len(cases)
    values = []
    for k in range(max(c.bands for c in cases)):
        arr = F.array(*[F.col(f"i{j + 1}_b{k if c.bands > 1 else 0}") for j, c in enumerate(cases)])
        values.append(F.element_at(arr, F.least(F.col("i0_b0").cast("int"), F.lit(n - 1)) + 1))
    return cases[0].having(df, width=w, height=h, keys=next((r.keys for r in [index, *cases] if r.keys), ())).with_bands(values)


def percent(r: Raster, p: float) -> DataFrame:
    """The smallest value at or below which p percent of each image's pixels are, exactly."""
    h = hist_norm(hist_cum(wide(arithmetic.hist_find(r, 0), 1)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*r.keys))
    return h.select(*r.keys, "bin", "b0", size.alias("n")).groupBy(*r.keys).agg(F.min(F.when(F.col("b0") > F.col("n") * (p / 100.0), F.col("bin"))).alias("threshold"))


def percent_lum(r: Raster, p: float, top=125.0, bins=10000) -> DataFrame:
    """Percentile of luminance over fixed bins, interpolated to the bin's upper edge."""
    cell = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("b0").cast("double") * bins / top)))
    h = r.df.groupBy(*r.keys, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*r.keys)
    run = h.select(*r.keys, "bin", F.sum("n").over(w.orderBy("bin")).alias("c"), F.sum("n").over(w).alias("t"))
    return run.where(F.col("c") >= F.col("t") * (p / 100.0)).groupBy(*r.keys).agg(((F.min("bin") + 1) * top / bins).alias("threshold"))


def hist_local(r: Raster, width: int, height: int, max_slope=0) -> Raster:
    """Local equalisation: the share of the window's values that do not exceed the centre, times 255.

    ``max_slope`` limits how much any one value may count.
    """
    n = width * height

    def row(_, k, t):
        return [F.array(*t)]

    def total(b, rows):
        values, centre = F.concat(*[x[0] for x in rows]), F.col(f"b{b}")
        if not max_slope:
            return [F.floor(255 * F.size(F.filter(values, lambda v: v <= centre)) / float(n))]
        limit = max_slope * n / 256.0
        distinct = F.array_distinct(F.filter(values, lambda v: v <= centre))
        below = F.aggregate(distinct, F.lit(0.0), lambda a, d: a + F.least(F.lit(limit), F.size(F.filter(values, lambda v: v == d)).cast("double")))
        spare = F.aggregate(F.array_distinct(values), F.lit(0.0), lambda a, d: a + F.greatest(F.lit(0.0), F.size(F.filter(values, lambda v: v == d)) - limit))
        return [F.floor(F.least(F.lit(255.0), 255 * (below + spare * (centre + 1) / 256.0) / float(n)))]

    df, values = window2d(r, width, height, row, total)
    return r.having(df).with_bands(values)


def stdif(r: Raster, width: int, height: int, a=0.5, m0=128.0, b=0.5, s0=50.0) -> Raster:
    """Statistical differencing: moves local mean and spread towards m0 and s0."""
    n = float(width * height)

    def row(_, k, t):
        v = [x.cast("double") for x in t]
        return [reduce(lambda p, q: p + q, v), reduce(lambda p, q: p + q, [x * x for x in v])]

    def total(k, rows):
        s, q = (reduce(lambda p, w: p + w, [x[j] for x in rows]) for j in range(2))
        mean = s / n
        sd = F.sqrt(F.greatest(F.lit(0.0), q / n - mean * mean))
        value = a * m0 + (1 - a) * mean + (F.col(f"b{k}").cast("double") - mean) * (b * s0 / (s0 + b * sd))
        return [saturate(F.floor(value + 0.5), r.format) if is_int(r.format) else value]

    df, values = window2d(r, width, height, row, total)
    return r.having(df).with_bands(values)
