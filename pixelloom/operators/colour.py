"""Colour operators on rasters; a route of steps becomes one projection."""

from __future__ import annotations

from collections import deque

from pyspark.sql import functions as F

from ..functions import colour as C, icc
from ..raster import Raster, saturate, zip_join


def _step(r: Raster, fn, n: int, fmt: str, interpretation: str) -> Raster:
    """Transforms the first n bands; further bands are carried."""
    c = [v.cast("double") if fmt != "labq" else v for v in r.cols[:n]]
    out = fn(c)
    values = [saturate(v, fmt) for v in out] + r.cols[n:]
    return r.with_bands(values, fmt, interpretation=interpretation)


# name: (function, input bands, output format, from, to)
STEPS = {
    "XYZ2Lab": (C.xyz_lab, 3, "float", "xyz", "lab"), "Lab2XYZ": (C.lab_xyz, 3, "float", "lab", "xyz"),
    "Lab2LCh": (C.lab_lch, 3, "float", "lab", "lch"), "LCh2Lab": (C.lch_lab, 3, "float", "lch", "lab"),
    "LCh2CMC": (C.lch_cmc, 3, "float", "lch", "cmc"), "XYZ2Yxy": (C.xyz_yxy, 3, "float", "xyz", "yxy"),
    "Yxy2XYZ": (C.yxy_xyz, 3, "float", "yxy", "xyz"), "scRGB2XYZ": (C.scrgb_xyz, 3, "float", "scrgb", "xyz"),
    "XYZ2scRGB": (C.xyz_scrgb, 3, "float", "xyz", "scrgb"), "sRGB2scRGB": (C.srgb_scrgb, 3, "float", "srgb", "scrgb"),
    "scRGB2sRGB": (C.scrgb_srgb, 3, "uchar", "scrgb", "srgb"), "scRGB2BW": (C.scrgb_bw, 3, "uchar", "scrgb", "b_w"),
    "sRGB2HSV": (C.srgb_hsv, 3, "uchar", "srgb", "hsv"), "HSV2sRGB": (C.hsv_srgb, 3, "uchar", "hsv", "srgb"),
    "XYZ2Oklab": (C.xyz_oklab, 3, "float", "xyz", "oklab"), "Oklab2XYZ": (C.oklab_xyz, 3, "float", "oklab", "xyz"),
    "Oklab2Oklch": (C.lab_lch, 3, "float", "oklab", "oklch"), "Oklch2Oklab": (C.lch_lab, 3, "float", "oklch", "oklab"),
    "XYZ2CMYK": (C.xyz_cmyk, 3, "uchar", "xyz", "cmyk"), "CMYK2XYZ": (C.cmyk_xyz, 4, "float", "cmyk", "xyz"),
    "Lab2LabS": (C.lab_labs, 3, "short", "lab", "labs"), "LabS2Lab": (C.labs_lab, 3, "float", "labs", "lab"),
    "Lab2LabQ": (C.lab_labq, 3, "uchar", "lab", "labq"), "LabQ2Lab": (C.labq_lab, 4, "float", "labq", "lab"),
    "rad2float": (C.rad_float, 4, "float", "rad", "scrgb"), "float2rad": (C.float_rad, 3, "uchar", "scrgb", "rad"),
}


def step(r: Raster, name: str) -> Raster:
    fn, n, fmt, _, to = STEPS[name]
    return _step(r, fn, n, fmt, to)


def route(source: str, target: str) -> list[str]:
    """The shortest chain of steps between two spaces."""
    queue, seen = deque([(source, [])]), {source}
    while queue:
        at, path = queue.popleft()
        if at == target:
            return path
        for name, (_, _, _, a, b) in STEPS.items():
            if a == at and b not in seen:
                seen.add(b)
                queue.append((b, [*path, name]))
    raise ValueError(f"no route from {source} to {target}")


def colourspace(r: Raster, space: str, source: str | None = None) -> Raster:
    for name in route(source or r.interpretation, space):
        r = step(r, name)
    return r


def _difference(left: Raster, right: Raster, fn) -> Raster:
    df, w, h = zip_join([left, right])
    p, q = ([F.col(f"i{n}_b{k}").cast("double") for k in range(3)] for n in range(2))
    return left.having(df, width=w, height=h).with_bands([fn(p, q)], "float", interpretation="b_w")


def dE76(left, right):
    return _difference(left, right, C.de76)


def dE00(left, right):
    return _difference(left, right, C.de00)


def dECMC(left, right):
    return _difference(left, right, C.de_cmc)


def cmc2lch(r: Raster) -> Raster:
    """Inverse of the uniform space, by tables over lightness and chroma and a fixed-point search over hue."""
    spark = r.df.sparkSession
    inv_l = spark.range(1001).select((F.col("id") / 10.0).alias("v"))
    ls = inv_l.select("v", C.cmc_l(F.col("v")).alias("u")).agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("_l"))
    cs = spark.range(2001).select((F.col("id") / 10.0).alias("v")).select("v", C.cmc_c(F.col("v")).alias("u")).agg(F.array_sort(F.collect_list(F.struct("u", "v"))).alias("_c"))
    df = r.df.join(F.broadcast(ls)).join(F.broadcast(cs))
    near = lambda table, c: F.array_min(F.transform(F.col(table), lambda s: F.struct(F.abs(s["u"] - c).alias("d"), s["v"].alias("v"))))["v"]
    df = df.select(*r.at, "b2", near("_l", F.col("b0").cast("double")).alias("L"), near("_c", F.col("b1").cast("double")).alias("C"))
    h = F.col("b2").cast("double")
    for _ in range(6):
        h = F.col("b2").cast("double") - (C.cmc_h(F.col("C"), h) - h)
        df = df.withColumn("_h", F.pmod(h, F.lit(360.0)))
        df = df.select(*[c for c in df.columns if c != "_g"], F.col("_h").alias("_g")).drop("_h")
        h = F.col("_g")
    return r.having(df).with_bands([F.col("L"), F.col("C"), F.col("_g")], "float", interpretation="lch")


# Transfer functions by name, as (decode to linear light).
def _pq(v):
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 4096 * 128, 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
    p = F.pow(v, F.lit(1 / m2))
    return F.pow(F.greatest(p - c1, F.lit(0.0)) / (c2 - c3 * p), F.lit(1 / m1)) * (10000.0 / 203.0)


def _hlg(v):
    a, b, c = 0.17883277, 0.28466892, 0.55991073
    return F.when(v <= 0.5, v * v / 3).otherwise((F.exp((v - c) / a) + b) / 12)


def _bt709(v):
    return F.when(v < 0.081, v / 4.5).otherwise(F.pow((v + 0.099) / 1.099, F.lit(1 / 0.45)))


TRANSFER = {"bt709": _bt709, "bt601": _bt709, "bt2020_10bit": _bt709, "bt2020_12bit": _bt709, "linear": lambda v: v, "srgb": lambda v: C.srgb_decode(v, 1.0), "pq": _pq, "hlg": _hlg,
            "bt470m": lambda v: F.pow(v, F.lit(2.2)), "bt470bg": lambda v: F.pow(v, F.lit(2.8)), "smpte428": lambda v: F.pow(v, F.lit(2.6)) * (52.37 / 48.0)}
BT2020_709 = ((1.6605, -0.5876, -0.0728), (-0.1246, 1.1329, -0.0083), (-0.0182, -0.1006, 1.1187))
P3_709 = ((1.2249, -0.2247, 0.0), (-0.0420, 1.0419, 0.0), (-0.0197, -0.0786, 1.0979))


PRIMARIES = {"bt709": None, "bt2020": BT2020_709, "smpte432": P3_709, "smpte431": P3_709}


def cicp2scrgb(r: Raster, primaries="bt709", transfer="srgb", top=255.0) -> Raster:
    if primaries not in PRIMARIES or transfer not in TRANSFER:
        raise ValueError(f"no primaries {primaries} or transfer {transfer}")
    light = [TRANSFER[transfer](c.cast("double") / top) for c in r.cols[:3]]
    m = PRIMARIES[primaries]
    return r.with_bands([*(C.dot(m, light) if m else light), *r.cols[3:]], "float", interpretation="scrgb")


def scrgb2cicp(r: Raster, transfer="srgb", top=255.0) -> Raster:
    if transfer not in ("linear", "bt709", "bt601", "srgb"):
        raise ValueError(f"no encoding for transfer {transfer}")

    def encode(f):
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))
        if transfer == "linear":
            return f
        if transfer in ("bt709", "bt601"):
            return F.when(f < 0.018, 4.5 * f).otherwise(1.099 * F.pow(f, F.lit(0.45)) - 0.099)
        return F.when(f <= 0.0031308, f * 12.92).otherwise(1.055 * F.pow(f, F.lit(1 / 2.4)) - 0.055)

    return r.with_bands([F.floor(encode(c.cast("double")) * top + 0.5) for c in r.cols[:3]], "uchar", interpretation="srgb")


def uhdr2scrgb(r: Raster, gain: Raster, boost=4.0) -> Raster:
    """Base image decoded and multiplied by boost ** gain; the gain map is enlarged to the base's size."""
    g = gain.df.select(*gain.keys, F.col("x").alias("gx"), F.col("y").alias("gy"), (F.col("b0").cast("double") / 255.0).alias("g"))
    places = {"gx": F.expr(f"cast(x * {gain.width}L div {r.width} as int)"), "gy": F.expr(f"cast(y * {gain.height}L div {r.height} as int)")}
    df = r.df.withColumns(places).join(g, [*gain.keys, "gx", "gy"])
    return r.having(df).with_bands([C.srgb_decode(c) * F.pow(F.lit(boost), F.col("g")) for c in r.cols[:3]], "float", interpretation="scrgb")


def icc_import(r: Raster, profile: bytes | None = None, pcs="lab", top=255.0) -> Raster:
    """Device values to the connection space (Lab or XYZ under D50)."""
    profile = profile or icc.profile_load("srgb")
    fn = icc.device_lab if pcs == "lab" else icc.device_xyz
    return r.with_bands([*fn(r.cols[:3], profile, top), *r.cols[3:]], "float", interpretation=pcs)


def icc_export(r: Raster, profile: bytes | None = None, depth=8) -> Raster:
    """Connection-space values to device values."""
    profile = profile or icc.profile_load("srgb")
    top, fmt = (255.0, "uchar") if depth == 8 else (65535.0, "ushort")
    c = [v.cast("double") for v in r.cols[:3]]
    out = icc.lab_device(c, profile, top) if r.interpretation == "lab" else icc.xyz_device(c, profile, top)
    return r.with_bands([*out, *r.cols[3:]], fmt, interpretation="srgb" if depth == 8 else "rgb16")


def icc_transform(r: Raster, output: bytes, source: bytes | None = None, depth=8) -> Raster:
    return icc_export(icc_import(r, source, "xyz"), output, depth)
