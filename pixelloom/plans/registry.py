"""All operators by name, with the convenience forms of families: ``call("add", a, b)``."""

from __future__ import annotations

import inspect
from functools import partial

from ..functions import icc
from ..operators import arithmetic as A, colour as K, conversion as V, convolution as N, create as G, draw as D, freqfilt as Q, histogram as H, morphology as M, mosaicing as S, resample as R
from ..sources import codecs, files


def _unary(fn, arg):
    return lambda r, *a, **k: fn(r, *a, arg, **k)


def operations() -> dict:
    ops = {}
    for module, names in (
        (A, "add subtract multiply divide remainder maxpair minpair relational boolean math math2 invert linear clamp complexform complexget cross_phase avg deviate extremes stats getpoint hist_find hist_find_indexed hist_find_ndim project profile find_trim measure hough_line hough_circle sign cooccurrence texture differences linreg zerox"),
        (V, "extract_band bandjoin bandjoin_const addalpha bandmean bandbool bandrank bandfold bandunfold recomb msb byteswap cast copy extract_area crop flip rot autorot rot45 wrap transpose3d subsample zoom replicate embed gravity insert join arrayjoin ifthenelse switch flatten premultiply unpremultiply gamma scale falsecolour composite composite2 smartcrop cache sequential"),
        (K, "colourspace dE76 dE00 dECMC icc_import icc_export icc_transform"),
        (N, "conv convi convf conva convsep convasep gaussblur sobel scharr prewitt compass fastcor spcor canny sharpen"),
        (G, "black xyz grey zone sines eye identity gaussnoise mask_ideal mask_ideal_ring mask_ideal_band mask_butterworth mask_butterworth_ring mask_butterworth_band mask_gaussian mask_gaussian_ring mask_gaussian_band mask_fractal gaussmat logmat buildlut invertlut tonelut sdf worley perlin text"),
        (D, "draw_rect draw_point draw_line draw_circle draw_image draw_mask draw_flood draw_smudge"),
        (H, "hist_cum hist_norm hist_equal hist_entropy hist_ismonotonic hist_match hist_plot maplut case percent percent_lum hist_local stdif"),
        (M, "morph rank median countlines labelregions fill_nearest"),
        (R, "shrink shrinkh shrinkv reduceh reducev affine similarity rotate mapim quadratic resize thumbnail"),
        (Q, "fwfft invfft freqmult phasecor spectrum fractsurf"),
        (S, "merge mosaic mosaic1 match globalbalance remosaic matrixmultiply matrixinvert"),
    ):
        ops.update({n: getattr(module, n) for n in names.split()})
    ops |= {"abs": A.abs_, "sum": A.sum_, "round": A.round_, "complex": A.complex_, "complex2": A.cross_phase, "grid": V.grid_, "reduce": R.reduce_, "tilecache": V.cache, "linecache": V.cache,
            "max": partial(A.extremes, largest=True), "min": partial(A.extremes, largest=False), "CMC2LCh": K.cmc2lch, "CICP2scRGB": K.cicp2scrgb, "scRGB2CICP": K.scrgb2cicp, "uhdr2scRGB": K.uhdr2scrgb,
            "profile_load": icc.profile_load, "thumbnail_image": R.thumbnail, "system": files.system, "dzsave": files.dzsave,
            "LabQ2sRGB": lambda r: K.colourspace(r, "srgb", "labq"), "LabQ2LabS": lambda r: K.colourspace(r, "labs", "labq"), "LabS2LabQ": lambda r: K.colourspace(r, "labq", "labs")}
    for name in K.STEPS:
        ops[name] = partial(K.step, name=name)
    for name in A.MATH:
        ops[name] = partial(A.math, function=name)
    for name in A.MATH2:
        ops[name] = partial(A.math2, function=name)
    for name in A.RELATIONS:
        ops[name] = partial(A.relational, relation=name)
        ops[f"{name}_const"] = partial(A.relational, relation=name)
    for name in ("and", "or", "eor", "lshift", "rshift"):
        ops[f"{name}image" if name in ("and", "or", "eor") else name] = partial(A.boolean, operation=name)
    for name in ("rint", "ceil", "floor"):
        ops[name] = partial(A.round_, how=name)
    for name in ("polar", "rect", "conj"):
        ops[name] = partial(A.complex_, how=name)
    for name in ("real", "imag"):
        ops[name] = partial(A.complexget, part=name)
    for name in ("uchar", "char", "ushort", "short", "uint", "int", "float", "double"):
        ops[f"cast_{name}"] = partial(V.cast, fmt=name)
    for name in ("and", "or", "eor"):
        ops[f"band{name}"] = partial(V.bandbool, operation=name)
    for name in ("d90", "d180", "d270"):
        ops["rot" + name[1:]] = partial(V.rot, angle=name)
    for name in ("erode", "dilate"):
        ops[name] = partial(M.morph, operation=name)
    for name in R.INTERPOLATORS:
        ops[name] = partial(R.sample, interpolate=name)
    for name in codecs.CODECS:
        ops[f"{name}load"] = partial(files.load, loader=name)
        ops[f"{name}load_buffer"] = codecs.CODECS[name][1]
        ops[f"{name}save"] = partial(files.save, codec=name)
        ops[f"{name}save_buffer"] = codecs.CODECS[name][2]
    ops |= {"thumbnail_buffer": lambda spark, width, buffer, **k: R.thumbnail(from_buffer(spark, buffer), width, **k), "thumbnail_source": lambda spark, width, path, **k: files.thumbnail(spark, path, width, **k)}
    return ops


def from_buffer(spark, data: bytes, loader: str | None = None, **options):
    """A raster from encoded bytes held by the driver (small images)."""
    import pandas as pd

    from ..raster import STORAGE, Raster
    from pyspark.sql import functions as F

    a = codecs.CODECS[loader or codecs.find_load(data)][1](data, **options)
    table = files.pixel_table(a, a.shape[2]).to_pandas()
    fmt = codecs.format_of(a)
    df = spark.createDataFrame(pd.DataFrame(table)).select("x", "y", *[F.col(f"b{k}").cast(STORAGE[fmt]).alias(f"b{k}") for k in range(a.shape[2])])
    return Raster(df, a.shape[1], a.shape[0], a.shape[2], fmt, "srgb" if a.shape[2] >= 3 else "b_w")


def call(name: str, *args, **options):
    return operations()[name](*args, **options)


def describe(name: str) -> str:
    """Name, parameters and first line of an operation's description."""
    fn = operations()[name]
    doc = (inspect.getdoc(getattr(fn, "func", fn)) or "").split("\n")[0]
    return f"{name}{inspect.signature(fn)}: {doc}"
