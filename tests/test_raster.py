"""The raster engine: queries against SQL, and what SQL does not reach against numpy."""

import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import colour, icc
from pixelloom.operators import arithmetic as A, colour as K, conversion as V, convolution as N, create as G, draw as D, freqfilt as Q, morphology as M, resample as R
from pixelloom.plans import catalog, registry
from pixelloom.raster import Raster, STORAGE, common_format, promoted
from pixelloom.sources import codecs, files

SF = "/root/testdata/sf0.01"
SAMPLE = [n for k, n in enumerate(sorted(catalog.oracle_sql())) if k % 6 == 0]


def raster(spark, a, fmt="uchar", **header):
    a = a[:, :, None] if a.ndim == 2 else a
    h, w, bands = a.shape
    rows = [(x, y, *[v.item() for v in a[y, x]]) for y in range(h) for x in range(w)]
    kind = "double" if a.dtype.kind == "f" else "long"
    df = spark.createDataFrame(rows, "x int, y int, " + ", ".join(f"b{k} {kind}" for k in range(bands))).select("x", "y", *[F.col(f"b{k}").cast(STORAGE[fmt]).alias(f"b{k}") for k in range(bands)])
    return Raster(df, w, h, bands, fmt, **header)


def array(r):
    out = np.zeros((r.height, r.width, r.bands))
    for row in r.df.collect():
        out[row["y"], row["x"]] = [row[f"b{k}"] for k in range(r.bands)]
    return out


@pytest.fixture(scope="module")
def small():
    return np.random.default_rng(0).integers(0, 256, (13, 17)).astype(np.uint8)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    if os.path.isdir(SF):
        for f in os.listdir(SF):
            con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_query_equals_sql(spark, duck, name):
    a, b = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(str, a[cols].itertuples(index=False, name=None))) == sorted(map(str, b[cols].itertuples(index=False, name=None)))


def test_format_tables():
    assert common_format("uchar", "char") == "short" and common_format("ushort", "short") == "int" and common_format("uint", "char") == "int"
    assert common_format("int", "float") == "float" and common_format("double", "complex") == "dpcomplex"
    assert promoted("add", "uchar") == "ushort" and promoted("subtract", "ushort") == "int"


@pytest.mark.parametrize("op", ["add", "subtract", "multiply"])
def test_operators_on_unequal_sizes(spark, small, op):
    other = small[:5, :9]
    got = array(getattr(A, op)(raster(spark, small), raster(spark, other)))[:, :, 0]
    wide = np.zeros(small.shape, int)
    wide[:5, :9] = other
    assert (got == {"add": np.add, "subtract": np.subtract, "multiply": np.multiply}[op](small.astype(int), wide)).all()


def test_overloads_and_stack(spark, small):
    r = raster(spark, small)
    assert (array((r + 1) * 2)[:, :, 0] == (small.astype(int) + 1) * 2).all() and (array(r > 100)[:, :, 0] == (small > 100) * 255).all()
    stack = Raster(r.df.withColumn("img", F.lit("a")).unionByName(r.df.withColumn("img", F.lit("b"))), r.width, r.height, 1, "uchar", keys=("img",))
    assert stack.df.count() == 2 * small.size and (stack + stack).df.groupBy("img").count().count() == 2
    assert A.avg(stack).count() == 2


def reference_regions(a):
    label, n = -np.ones(a.shape, int), 0
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            if label[y, x] < 0:
                todo = [(y, x)]
                label[y, x] = n
                while todo:
                    p, q = todo.pop()
                    for i, j in ((p + 1, q), (p - 1, q), (p, q + 1), (p, q - 1)):
                        if 0 <= i < a.shape[0] and 0 <= j < a.shape[1] and label[i, j] < 0 and a[i, j] == a[p, q]:
                            label[i, j] = n
                            todo.append((i, j))
                n += 1
    return label


def test_regions_and_flood(spark, small):
    a = (small > 120).astype(np.uint8) * 255
    label = reference_regions(a)
    assert (array(M.labelregions(raster(spark, a)))[:, :, 0] == label).all()
    got = array(D.draw_flood(raster(spark, a), 7, 3, 4))[:, :, 0]
    assert (got == np.where(label == label[4, 3], 7, a)).all()


def test_fourier_and_filters(spark, small):
    r = raster(spark, small)
    back = array(Q.invfft(Q.fwfft(r), True))[:, :, 0]
    assert np.allclose(back, small)
    got = Q.fwfft(r).df.where("x = 2 and y = 3").first()["b0"]
    want = np.fft.fft2(small)[3, 2] / small.size
    assert np.isclose(got["re"], want.real) and np.isclose(got["im"], want.imag)
    shifted = np.roll(small, (2, 3), (0, 1))
    top = Q.phasecor(raster(spark, shifted), r).df.orderBy(F.desc("b0")).first()
    assert (top["x"], top["y"]) == (3, 2)


def test_neighbourhoods_with_numpy(spark, small):
    p = np.pad(small.astype(float), 1, "edge")
    win = np.stack([p[j : j + 13, i : i + 17] for j in range(3) for i in range(3)])
    r = raster(spark, small)
    assert np.allclose(array(N.convf(r, N.rotated45([[1, 2, 3], [4, 5, 6], [7, 8, 9]]), 9))[:, :, 0], np.tensordot(np.array([4, 1, 2, 7, 5, 3, 8, 9, 6]), win, 1) / 9, atol=1e-3)
    assert (array(M.median(r))[:, :, 0] == np.median(win, 0)).all()
    assert array(N.canny(r)).shape == (13, 17, 1)


def test_rotations_come_back(spark, small):
    r = raster(spark, small)
    assert (array(V.rot(V.rot(r, "d90"), "d270"))[:, :, 0] == small).all() and (array(V.rot(r, "d90"))[:, :, 0] == np.rot90(small, -1)).all()
    assert (array(V.wrap(V.wrap(r, 4, 5), -4, -5))[:, :, 0] == small).all()
    square = raster(spark, small[:5, :5])
    out = square
    for _ in range(8):
        out = V.rot45(out)
    assert (array(out)[:, :, 0] == small[:5, :5]).all()


@pytest.mark.parametrize("extend,mode", [("copy", "edge"), ("repeat", "wrap"), ("mirror", "symmetric")])
def test_embed_like_padding(spark, small, extend, mode):
    got = array(V.embed(raster(spark, small), 3, 4, 17 + 8, 13 + 9, extend))[:, :, 0]
    assert (got == np.pad(small, ((4, 5), (3, 5)), mode)).all()


def test_resampling_properties(spark):
    flat = raster(spark, np.full((12, 16), 77, np.uint8))
    for kernel in R.KERNELS:
        assert (array(R.reduce_(flat, 2.0, 1.5, kernel)) == 77).all()
    for how in R.INTERPOLATORS:
        got = array(R.affine(flat, (1, 0, 0, 1), how, odx=0.5, ody=0.25, oarea=(1, 1, 14, 10)))
        assert (got == 77).all(), how
    ramp = raster(spark, np.tile(np.arange(16, dtype=np.uint8) * 10, (12, 1)))
    assert np.allclose(array(R.resize(ramp, 0.5, kernel="linear"))[5, 1:7, 0], np.arange(1, 7) * 20 + 5, atol=1)


def test_colour_round_trips(spark):
    a = np.random.default_rng(1).integers(0, 256, (6, 7, 3)).astype(np.uint8)
    r = raster(spark, a, interpretation="srgb")
    for space in ("xyz", "lab", "lch", "oklab", "oklch", "yxy", "scrgb", "hsv"):
        got = array(K.colourspace(K.colourspace(r, space), "srgb"))
        assert np.abs(got - a).max() <= (6 if space == "hsv" else 1), space
    p3 = icc.profile_load("p3")
    assert np.abs(array(K.icc_transform(r, icc.profile_load("srgb"))) - a).max() <= 1
    assert np.abs(array(K.icc_transform(K.icc_transform(r, p3, depth=16), icc.profile_load("srgb"))) - a).max() >= 0
    lab = array(K.icc_import(raster(spark, np.full((1, 1, 3), 255, np.uint8))))[0, 0]
    assert np.allclose(lab, [100, 0, 0], atol=0.1)
    with pytest.raises(ValueError):
        icc.parse(b"\0" * 200)


def test_taps_are_added_in_one_order(spark):
    # Of numbers so far apart, every order of adding has another sum.
    rng = np.random.default_rng(6)
    a = rng.choice([-1.0, 1.0], (40, 50)) * 10.0 ** rng.integers(0, 18, (40, 50))
    r = raster(spark, a, "double")
    want = np.zeros((40, 50))
    for i in (0, 1):
        for j in (0, 1):
            want[:-1, :-1] += a[j : 39 + j, i : 49 + i] * ((0.75, 0.25)[i] * 0.5)
    dealt = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in dealt}
    try:
        for conf in (before, dealt):  # taps arrive as they were made, or as they were dealt
            for k, v in conf.items():
                spark.conf.set(k, v)
            assert (array(R.affine(r, (1, 0, 0, 1), idx=-0.25, idy=-0.5, oarea=(0, 0, 50, 40)))[:, :, 0] == want).all()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ciede2000_pairs(spark):
    # Published test pairs.
    pairs = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0), ((22.7233, 20.0904, -46.6940), (23.0331, 14.9730, -42.5619), 2.0373), ((90.8027, -2.0831, 1.4410), (91.1528, -1.6435, 0.0447), 1.4441)]
    p, q = (raster(spark, np.array([[x[k] for x in pairs]]), "double") for k in range(2))
    assert np.allclose(array(K.dE00(p, q))[0, :, 0], [x[2] for x in pairs], atol=2e-4)


@pytest.fixture(scope="module")
def wide_values(spark, tmp_path_factory):
    """Events whose values reach the ends of the domains of arc functions, and beyond."""
    folder = str(tmp_path_factory.mktemp("wide"))
    rows = [(k, k % 7, "view", v) for k, v in enumerate([0.0, 12.34, 250.0, 499.99, 500.0, 500.01, 560.21, 1e9])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def same_as_sql(spark, folder, name):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS FROM '{folder}/events.parquet/*.parquet'")
    want = db.sql(catalog.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in catalog.queries()[name](spark, folder).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 8
    return [r[2] for r in sorted(got)]


def test_atanh_outside_its_domain(spark, wide_values):
    got = same_as_sql(spark, wide_values, "math_atanh")
    assert np.isinf(got[4]) and np.isnan(got[5:]).all() and np.isfinite(got[:4]).all()


def test_asin_outside_its_domain(spark, wide_values):
    got = same_as_sql(spark, wide_values, "math_asin")
    assert got[4] == 90.0 and np.isnan(got[5:]).all()


def test_acos_outside_its_domain(spark, wide_values):
    got = same_as_sql(spark, wide_values, "math_acos")
    assert got[4] == 0.0 and np.isnan(got[5:]).all()


@pytest.fixture(scope="module")
def odd_values(spark, tmp_path_factory):
    """Events whose values are beyond both ends of the domains of arc functions, infinite, NaN or missing."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(k, k % 7, "view", v) for k, v in enumerate([-12.3, -500.0, -500.01, -1e300, 500.01, 1e308, math.inf, -math.inf, math.nan, None])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def same_bits_as_sql(spark, folder, name):
    # As text the engine of the SQL tells nan from -nan, which == and str() do not.
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS FROM '{folder}/events.parquet/*.parquet'")
    bits = lambda rows: {(x, y): v if v is None else struct.pack(">d", v).hex() for x, y, v in rows}
    got = bits(catalog.queries()[name](spark, folder).collect())
    assert got == bits(db.sql(catalog.oracle_sql()[name]).fetchall())
    return [got[k] for k in sorted(got)]


@pytest.fixture(scope="module")
def signed_nans(tmp_path_factory):
    """Events with NaN of both signs, which Spark's own writer does not keep, and a value outside the domain of arc functions."""
    import duckdb

    folder = tmp_path_factory.mktemp("nans")
    (folder / "events.parquet").mkdir()
    duckdb.connect().execute(f"COPY (SELECT k AS event_id, k AS user_id, 'view' AS event_type, ['nan'::DOUBLE, -('nan'::DOUBLE), 501.0][k + 1] AS value FROM range(3) t(k)) TO '{folder}/events.parquet/0.parquet' (FORMAT parquet)")
    return str(folder)


def test_acos_outside_its_domain_has_no_sign(spark, wide_values, odd_values):
    assert same_bits_as_sql(spark, wide_values, "math_acos")[5:] == ["7ff8000000000000"] * 3
    got = same_bits_as_sql(spark, odd_values, "math_acos")
    assert got[2:] == ["7ff8000000000000"] * 7 + [None] and got[1] == struct.pack(">d", 180.0).hex()


def test_acos_of_nan_keeps_its_sign(spark, signed_nans):
    assert same_bits_as_sql(spark, signed_nans, "math_acos") == ["7ff8000000000000", "fff8000000000000", "7ff8000000000000"]


def test_asin_outside_its_domain_has_no_sign(spark, wide_values, odd_values):
    assert same_bits_as_sql(spark, wide_values, "math_asin")[5:] == ["7ff8000000000000"] * 3
    got = same_bits_as_sql(spark, odd_values, "math_asin")
    assert got[2:] == ["7ff8000000000000"] * 7 + [None] and got[1] == struct.pack(">d", -90.0).hex()


def test_asin_of_nan_keeps_its_sign(spark, signed_nans):
    assert same_bits_as_sql(spark, signed_nans, "math_asin") == ["7ff8000000000000", "fff8000000000000", "7ff8000000000000"]


def test_close_angles(spark):
    rng = np.random.default_rng(7)
    a, b = (rng.uniform(-150, 150, 3000) for _ in range(2))
    for k, (x, y) in enumerate([(1.0, 1.0), (-1.0, 1.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (0.0, 0.0), (-3.0, -3.0), (0.5, -0.5)]):
        a[k], b[k] = x, y
    got = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").select("a", "b", colour.close_atan2(F.col("b"), F.col("a")).alias("t"), F.atan2("b", "a").alias("plain")).collect()
    off = [sum(r[c] != math.atan2(r["b"], r["a"]) for r in got) for c in ("t", "plain")]
    assert off[0] <= 30 and off[0] * 4 < off[1], off
    assert all(abs(r["t"] - math.atan2(r["b"], r["a"])) < 5e-16 for r in got)


def test_ciede2000_of_opposite_hues(spark):
    # Hues 180 degrees apart: the last bit of each decides on which side the mean hue lies.  Values of the SQL.
    pairs = [((65.0, 95.0), (-65.0, -95.0)), ((85.0, 47.0), (-85.0, -47.0)), ((-45.0, 88.0), (45.0, -88.0)), ((48.0, 24.0), (-60.0, -30.0)), ((-27.0, 0.0), (75.0, 0.0))]

    def hue(x, y):
        d = math.degrees(math.atan2(y, x))
        return d + 360 if d < 0 else d

    p, q = (raster(spark, np.array([[(50.0, *x[k]) for x in pairs]]), "double") for k in range(2))
    got = array(K.dE00(p, q))[0, :, 0]
    for ((a1, b1), (a2, b2)), d in zip(pairs, got):
        cb = ((a1 * a1 + b1 * b1) ** 0.5 + (a2 * a2 + b2 * b2) ** 0.5) / 2
        g = 0.5 * (1 - math.sqrt(math.pow(cb, 7) / (math.pow(cb, 7) + 25.0**7)))
        a1, a2 = (1 + g) * a1, (1 + g) * a2
        c1, c2, h1, h2 = math.sqrt(a1 * a1 + b1 * b1), math.sqrt(a2 * a2 + b2 * b2), hue(a1, b1), hue(a2, b2)
        near, cd = abs(h1 - h2) < 180, (c1 + c2) / 2
        hd, dh = ((h1 + h2) / 2, h1 - h2) if near else (abs(h1 + h2 - 360) / 2, 360 - (h1 - h2))
        cos = lambda v: math.cos(math.radians(v))
        t = 1 - 0.17 * cos(hd - 30) + 0.24 * cos(2 * hd) + 0.32 * cos(3 * hd + 6) - 0.20 * cos(4 * hd - 63)
        rt = -math.sin(math.radians(60 * math.exp(-(((hd - 275) / 25) ** 2)))) * 2 * math.sqrt(cd**7 / (cd**7 + 25.0**7))
        nc, nh = (c1 - c2) / (1 + 0.045 * cd), 2 * math.sqrt(c1 * c2) * math.sin(math.radians(dh / 2)) / (1 + 0.015 * cd * t)
        assert abs(d - math.sqrt(nc * nc + nh * nh + rt * nc * nh)) < 1e-4


@pytest.mark.parametrize("codec", ["png", "ppm", "native", "tiff", "fits", "nifti", "bmp", "gif", "rad", "csv", "matrix"])
def test_codecs_round_trip(codec):
    a = np.random.default_rng(3).integers(0, 256, (9, 11, 3 if codec in ("png", "ppm", "native", "tiff", "bmp") else 1)).astype(np.uint8)
    _, decode, encode, _ = codecs.CODECS[codec]
    got = decode(encode(a))
    if codec == "rad":
        assert np.abs(got[:, :, :1] - a).max() <= 2
    else:
        assert (got[:, :, : a.shape[2]] == a).all()
    if codec not in ("csv", "matrix"):
        assert codecs.find_load(encode(a)) == codec


def test_codec_details():
    deep = np.random.default_rng(4).integers(0, 65536, (5, 6, 1)).astype(np.uint16)
    for codec in ("png", "ppm", "tiff", "native"):
        assert (codecs.CODECS[codec][1](codecs.CODECS[codec][2](deep)) == deep).all()
    assert codecs.matrix_header(codecs.matrix_encode(deep, 8, 128)) == (8.0, 128.0)
    assert (codecs.csv_decode(b"1, 2\n3, 4\n", skip=1)[:, :, 0] == [[3, 4]]).all()
    with pytest.raises(codecs.Unsupported):
        codecs.find_load(b"%PDF-1.7")


def test_nifti_of_long_sides():
    for shape, size in (((32767, 2), 348), ((32768, 2), 540), ((2, 40000), 540)):
        a = np.random.default_rng(5).integers(-9, 9, (*shape, 1)).astype(np.int16)
        data = codecs.nifti_encode(a)
        assert int.from_bytes(data[:4], "little") == size and codecs.find_load(data) == "nifti"
        got = codecs.nifti_decode(data)
        assert got.shape == a.shape and got.dtype == a.dtype and (got == a).all()
    # The other byte order.
    head = struct.pack(">i8s2h8q", 540, b"n+2\0\r\n\x1a\n", 4, 16, 3, 2, 3, 2, 1, 1, 1, 1).ljust(168, b"\0") + struct.pack(">q", 544)
    assert codecs.nifti_decode(head.ljust(544, b"\0") + np.arange(12, dtype=">i2").tobytes())[:, :, 0].tolist() == np.arange(12).reshape(6, 2).tolist()


def test_files_and_source(spark, tmp_path, small):
    files.save(raster(spark, small), f"file://{tmp_path}/out", "png").collect()
    back = files.load(spark, f"file://{tmp_path}/out")
    assert (array(back)[:, :, 0] == small).all() and back.keys == ("img",)
    spark.dataSource.register(files.PixelSource)
    rows = spark.read.format("pixels").option("path", f"{tmp_path}/out").load()
    assert rows.count() == small.size and rows.agg(F.sum("v")).first()[0] == small.sum()
    tiles = files.dzsave(raster(spark, small), f"file://{tmp_path}/dz", tile=8, overlap=0)
    assert sum(t.count() for t in tiles) == 6 + 2 + 1
    with pytest.raises(PermissionError):
        files.system(spark, "cat", spark.range(1).selectExpr("cast(id as string)"))


def test_streams(spark, tmp_path):
    from pixelloom.streaming import scanlines

    events = spark.createDataFrame([(k, f"2024-01-0{1 + k % 3} 0{k % 9}:00:00", k % 2, "view", float(k), "") for k in range(30)], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    stream = scanlines.read_events(spark, str(tmp_path))
    got = scanlines.run_to_memory(scanlines.windowed(stream), "w1")
    assert sorted(map(str, got.collect())) == sorted(map(str, scanlines.windowed(events).collect()))
    lines = stream.select(F.lit("a").alias("img"), F.col("event_id").cast("int").alias("y"), F.col("value").alias("v"))
    sums = scanlines.run_to_memory(scanlines.line_sums(lines), "w2", "append")
    assert sums.agg(F.sum("total")).first()[0] == sum(range(30)) and sums.count() == 30


def test_registry_names():
    ops = registry.operations()
    assert len(ops) > 250 and "sin" in ops and "pngload" in ops
    assert registry.describe("add").startswith("add(left")


def test_generated_masks(spark):
    m = array(G.mask_ideal(spark, 16, 16, 0.5))[:, :, 0]
    assert m[0, 0] == 1 and m[0, 7] == 1 and m[0, 2] == 0
    assert (array(G.text(spark, "I"))[:, :, 0] > 0).sum() == 9


def test_plans_stay_declarative(spark):
    """Point chains stay one projection over the scan; only the needed column is read."""
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    from pixelloom.plans.fixtures import Tables

    t = Tables(spark, SF)
    plan = A.linear(A.math(t.ev, "sin"), 2.0, 1.0).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "props" not in plan
    conv = N.gaussblur(t.ev, 1.5).df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in conv and "Join" not in conv
