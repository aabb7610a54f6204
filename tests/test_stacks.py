"""What an operator gives for a stack is what it gives for each of its images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import arithmetic as A, colour as K, conversion as V, draw as D, histogram as H, morphology as M, mosaicing as S, resample as R
from pixelloom.raster import Raster, from_table

W, HEIGHT = 8, 6
NAMES = ("one", "two", "three")


def pixels(name):
    rng = np.random.default_rng(len(name) + ord(name[0]))
    return rng.integers(0, 4, (HEIGHT, W)) * 60


@pytest.fixture(scope="module")
def stack(spark):
    rows = [(n, x, y, int(pixels(n)[y, x])) for n in NAMES for y in range(HEIGHT) for x in range(W)]
    df = spark.createDataFrame(rows, "img string, x int, y int, v int")
    return from_table(df, F.col("x"), F.col("y"), [F.col("v")], W, HEIGHT, keys=("img",))


@pytest.fixture(scope="module")
def singles(stack):
    return {n: stack.having(stack.df.where(F.col("img") == n).drop("img"), keys=()) for n in NAMES}


def three(r):
    return r.with_bands([r.cols[0], 255 - r.cols[0], (r.cols[0] * 3) % 256], "uchar", interpretation="srgb")


OPERATORS = {
    "stats": A.stats, "avg": A.avg, "deviate": A.deviate, "max": lambda r: A.extremes(r, True, 3), "min": lambda r: A.extremes(r, False, 2), "getpoint": lambda r: A.getpoint(r, 2, 3),
    "hist_find": A.hist_find, "hist_find_indexed": lambda r: A.hist_find_indexed(r, r), "hist_find_ndim": A.hist_find_ndim, "project": A.project, "profile": A.profile,
    "find_trim": lambda r: A.find_trim(r, 50.0), "measure": lambda r: A.measure(r, 2, 2), "hough_line": lambda r: A.hough_line(r, 16, 16), "hough_circle": lambda r: A.hough_circle(r, 1, 2, 3),
    "cooccurrence": A.cooccurrence, "texture": A.texture, "differences": A.differences, "linreg": lambda r: A.linreg([r, r + 1, r * 2], [0.0, 1.0, 2.0]), "zerox": lambda r: A.zerox(r - 90),
    "add": lambda r: r + r, "hist_equal": H.hist_equal, "percent": lambda r: H.percent(r, 40), "percent_lum": lambda r: H.percent_lum(r, 50, 255.0, 64), "hist_plot": lambda r: H.hist_plot(H.wide(A.hist_find(r), 1)),
    "hist_entropy": lambda r: H.hist_entropy(H.wide(A.hist_find(r), 1)), "hist_ismonotonic": lambda r: H.hist_ismonotonic(H.hist_cum(H.wide(A.hist_find(r), 1))),
    "hist_match": lambda r: H.hist_match(H.hist_cum(H.wide(A.hist_find(r), 1)), H.hist_cum(H.wide(A.hist_find(A.invert(r)), 1))),
    "countlines": lambda r: M.countlines(r, "horizontal"), "labelregions": M.labelregions, "regions": lambda r: M.regions(r, 2 * W), "fill_nearest": M.fill_nearest, "rank": lambda r: M.rank(r, 3, 3, 4),
    "affine": lambda r: R.affine(r, (1.2, 0.3, -0.2, 0.9), "bicubic"), "similarity": lambda r: R.similarity(r, 1.5, 20.0), "rotate": lambda r: R.rotate(r, 30.0), "resize_up": lambda r: R.resize(r, 2.5),
    "resize_down": lambda r: R.resize(r, 0.5), "thumbnail": lambda r: R.thumbnail(r, 16), "quadratic": lambda r: R.quadratic(r, [(0.5, 0.25), (0.1, 0.0), (0.0, 0.1), (0.01, 0.0), (0.0, 0.0), (0.0, 0.0)]),
    "mapim": lambda r: R.mapim(r, r.with_bands([F.col("x") / 2.0, F.col("y") / 2.0], "double")), "merge": lambda r: S.merge(r, r, "horizontal", -6, 0, 4),
    "match": lambda r: S.match(r, r, (0, 0), (1, 0), (5, 5), (6, 5)), "smartcrop_entropy": lambda r: V.smartcrop(r, 4, 3, "entropy"), "smartcrop_attention": lambda r: V.smartcrop(three(r), 4, 3, "attention"),
    "smartcrop_specific": lambda r: V.smartcrop(r, 4, 3, "specific", (5, 1)), "draw_flood": lambda r: D.draw_flood(r, 200, 3, 2), "draw_image": lambda r: D.draw_image(r, r, 3, 2), "draw_line": lambda r: D.draw_line(r, 9, 0, 0, 7, 5),
    "embed": lambda r: V.embed(r, 1, 2, 12, 12), "scale": V.scale, "insert": lambda r: V.insert(r, r, 5, 3, True), "uhdr2scRGB": lambda r: K.uhdr2scrgb(three(r), R.shrink(r, 2, 2)),
}


def rows(found, drop=False):
    df = found.df if isinstance(found, Raster) else found
    if drop:
        df = df.drop("img")
    cut = lambda v: round(v, 6) if isinstance(v, float) else v
    return df.columns, [tuple(cut(v) for v in r) for r in df.collect()]


@pytest.mark.parametrize("name", OPERATORS)
def test_stack_is_each_image(stack, singles, name):
    fn = OPERATORS[name]
    found = fn(stack)
    if isinstance(found, Raster):
        assert found.keys == ("img",)
    columns, got = rows(found)
    at = columns.index("img")
    rest = [c for c in columns if c != "img"]
    by_image = {n: sorted((tuple(v for k, v in enumerate(r) if k != at) for r in got if r[at] == n), key=str) for n in NAMES}
    # One single image is enough to tell: the others are held apart by the same key.
    n = NAMES[1]
    single, want = rows(fn(singles[n]))
    order = [single.index(c) for c in rest]
    assert by_image[n] == sorted((tuple(r[k] for k in order) for r in want), key=str)
    assert all(by_image.values()) and len(got) == sum(map(len, by_image.values()))


def test_regions_in_blocks_are_regions(singles):
    one = singles["one"]
    assert sorted(map(str, M.regions(one, W).df.collect())) == sorted(map(str, M.regions(one).df.collect()))


def test_lookup_tables_are_rasters_too(spark, singles):
    table = from_table(spark.range(256), F.col("id"), F.lit(0), [255 - F.col("id")], 256, 1)
    got = H.maplut(singles["one"], table, "uchar").df.collect()
    assert all(r["b0"] == 255 - pixels("one")[r["y"], r["x"]] for r in got)


def test_places_of_interest():
    flat = np.zeros((40, 40, 3))
    noisy = flat.copy()
    noisy[25:35, 5:15] = np.random.default_rng(2).integers(0, 256, (10, 10, 3))
    for place in (V.entropy_place, V.attention_place):
        left, top = place(noisy, 20, 20)
        assert left <= 10 and top >= 12


def test_what_cannot_be_done_is_refused(stack):
    with pytest.raises(ValueError):
        S.mosaic(stack, stack, "horizontal", 1, 1, 1, 1)
    with pytest.raises(ValueError):
        K.cicp2scrgb(three(stack), "smpte240")
    with pytest.raises(ValueError):
        K.scrgb2cicp(three(stack), "pq")


def test_nearest_over_blocks_and_missing_pixels(spark):
    # Two lines a block; a block without non-zero pixels, an image of zeros, and pixels that are not there.
    rng = np.random.default_rng(8)
    images = {n: (rng.random((11, 7)) < share) * rng.integers(1, 256, (11, 7)) for n, share in (("few", 0.06), ("many", 0.5), ("none", 0.0))}
    images["few"][4:8] = 0
    there = {n: (rng.random((11, 7)) < 0.8) & ((np.arange(11)[:, None] < 10) | (np.arange(7) < 3)) for n in images}
    rows = [(n, x, y, int(a[y, x])) for n, a in images.items() for y in range(11) for x in range(7) if there[n][y, x]]
    r = from_table(spark.createDataFrame(rows, "img string, x int, y int, v int"), F.col("x"), F.col("y"), [F.col("v")], 7, 11, keys=("img",))
    found = M.fill_nearest(r, 14)
    want = set()
    for n, x, y, _ in rows:
        near = min((((x - sx) ** 2 + (y - sy) ** 2, sy, sx, v) for m, sx, sy, v in rows if m == n and v), default=None)
        if near:
            want.add((n, x, y, near[3], round(near[0] ** 0.5, 6)))
    got = [(*v[:4], round(v[4], 6)) for v in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert sorted(map(tuple, M.fill_nearest(r).collect())) == sorted(map(tuple, found.collect()))
    # A frame without an end is worked out anew for each row: the square of a column's height.
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
