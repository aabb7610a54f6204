"""Frequency domain: whole-image transforms, one image (and band) a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..raster import Raster, zip_join


def _grids(pdf: pd.DataFrame, width: int, height: int, col: str) -> np.ndarray:
    out = np.zeros((height, width), np.complex128)
    values = pdf[col]
    if len(values) and isinstance(values.iloc[0], (dict, tuple)):
        z = np.array([complex(v["re"], v["im"]) if isinstance(v, dict) else complex(*v) for v in values])
    else:
        z = values.to_numpy(float)
    out[pdf["y"], pdf["x"]] = z
    return out


def _run(r: Raster, cols, fn, real: bool, bands: int):
    """``fn(list of grids)`` gives the output grids; images of a stack are separate groups."""
    w, h, keys = r.width, r.height, list(r.keys)
    kind = "double" if real else "struct<re:double,im:double>"
    schema = ", ".join([*(f"{k} {r.df.schema[k].dataType.simpleString()}" for k in keys), "x int", "y int", *(f"b{k} {kind}" for k in range(bands))])

    def one(pdf):
        grids = fn([_grids(pdf, w, h, c) for c in cols])
        ys, xs = np.mgrid[0:h, 0:w]
        out = {k: pdf[k].iloc[0] for k in keys} | {"x": xs.ravel().astype(np.int32), "y": ys.ravel().astype(np.int32)}
        for k, g in enumerate(grids):
            out[f"b{k}"] = g.real.ravel() if real else [{"re": z.real, "im": z.imag} for z in g.ravel()]
        return pd.DataFrame(out)

    group = r.df.groupBy(*keys) if keys else r.df.withColumn("_image", F.lit(1)).groupBy("_image")
    return r.having(group.applyInPandas(one, schema), bands=bands, format="double" if real else "dpcomplex", interpretation="b_w" if real else "fourier")


def fwfft(r: Raster) -> Raster:
    """Two-dimensional transform of each band, divided by the number of pixels."""
    n = r.width * r.height
    return _run(r, r.names, lambda g: [np.fft.fft2(x) / n for x in g], False, r.bands)


def invfft(r: Raster, real=False) -> Raster:
    n = r.width * r.height
    return _run(r, r.names, lambda g: [np.fft.ifft2(x) * n for x in g], real, r.bands)


def freqmult(r: Raster, mask: Raster) -> Raster:
    """Filters by a mask in the frequency domain."""
    df, _, _ = zip_join([r, mask])
    both = r.having(df)
    return _run(both, [f"i0_{c}" for c in r.names] + ["i1_b0"], lambda g: [np.fft.ifft2(np.fft.fft2(x) * g[-1].real) for x in g[:-1]], True, r.bands)


def phasecor(left: Raster, right: Raster) -> Raster:
    """Phase correlation surface."""

    def fn(g):
        a, b = np.fft.fft2(g[0]), np.fft.fft2(g[1])
        z = a * np.conj(b)
        m = np.abs(z)
        return [np.fft.ifft2(np.where(m > 1e-12, z / np.where(m > 1e-12, m, 1), 0))]

    df, _, _ = zip_join([left, right])
    return _run(left.having(df), ["i0_b0", "i1_b0"], fn, True, 1)


def spectrum(r: Raster) -> Raster:
    """Displayable power spectrum: modulus, log scale, origin in the middle."""

    w, h = r.width, r.height

    def fn(g):
        m = np.abs(np.fft.fft2(g[0])) / (w * h)
        s = np.log10(1 + m**0.25)
        return [np.roll(np.floor(s * (255.0 / (s.max() or 1.0)) + 0.5), (h // 2, w // 2), (0, 1)).astype(complex)]

    out = _run(r, ["b0"], fn, True, 1)
    return out.cast("uchar")


def fractsurf(spark, width, height, dimension, seed=0) -> Raster:
    from .create import gaussnoise, mask_fractal

    return freqmult(gaussnoise(spark, width, height, 0.0, 1.0, seed), mask_fractal(spark, width, height, dimension))
