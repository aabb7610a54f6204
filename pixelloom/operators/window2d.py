"""Neighbourhoods as two window passes.

A kernel of w x h taps is split into its rows: one pass along x makes, for each kernel row,
what that row contributes to a pixel (any expression of its w taps), and one pass along y
combines the h contributions.  Both passes are built-in lag/lead windows with constant
offsets over two exchanges, whatever the kernel, with no copies of pixels and no Python.
Beyond the edges the nearest pixel stands (extend copy), or zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, functions as F

from ..raster import Raster


def _shift(c: str, k: int, w, edge: str) -> Column:
    if k == 0:
        return F.col(c)
    moved = F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    if edge == "copy":
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.coalesce(moved, (F.last(c) if k > 0 else F.first(c)).over(whole))
    return moved


def window2d(r: Raster, width: int, height: int, row: Callable[[int, int, list[Column]], list[Column]], total: Callable[[int, list[list[Column]]], list[Column]], edge="copy") -> list:
    """(df, columns): ``row(band, k, taps)`` gives the contributions of kernel row k, ``total(band, rows)`` the
    results for a band from the contributions of all rows, in order; the centre is at (width // 2, height // 2)."""
    cx, cy = width // 2, height // 2
    along = Window.partitionBy(*r.keys, "y").orderBy("x")
    df = r.df
    taps = [(c, i, _shift(c, i - cx, along, edge).alias(f"t_{c}_{i}")) for c in r.names for i in range(width)]
    df = df.select(*r.at, *r.names, *[t for _, _, t in taps])
    parts, shape = [], {}
    for b, c in enumerate(r.names):
        got = [F.col(f"t_{c}_{i}") for i in range(width)]
        for k in range(height):
            values = row(b, k, got)
            shape[b] = len(values)
            parts += [v.alias(f"r_{b}_{k}_{j}") for j, v in enumerate(values)]
    df = df.select(*r.at, *r.names, *parts)
    down = Window.partitionBy(*r.keys, "x").orderBy("y")
    moved = [_shift(f"r_{b}_{k}_{j}", k - cy, down, edge).alias(f"s_{b}_{k}_{j}") for b in range(r.bands) for k in range(height) for j in range(shape[b])]
    df = df.select(*r.at, *r.names, *moved)
    out = []
    for b in range(r.bands):
        out += total(b, [[F.col(f"s_{b}_{k}_{j}") for j in range(shape[b])] for k in range(height)])
    return df, out
