"""Every query of the raster engine by name, with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import blend
from ..operators import arithmetic as A, colour as K, conversion as V, convolution as N, create as G, draw as D, freqfilt as Q, histogram as H, morphology as M, mosaicing as S, resample as R
from ..raster import RANGE
from .fixtures import Tables, fixed, shown, sql_fixed, with_ctes

_Q: dict = {}
_SQL: dict = {}


def _add(name, fn, sql=None):
    _Q[name] = lambda spark, folder, fn=fn: fn(Tables(spark, folder))
    if sql:
        _SQL[name] = sql


def _i(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def _point(name, fn, expr, cte="ev", integer=True, real=True, digits=4):
    """A raster query whose SQL is one expression over one relation."""
    value = _i(expr) if integer else sql_fixed(expr, digits, real)
    _add(name, lambda t: shown(fn(t), digits), with_ctes([cte], f"SELECT x, y, {value} AS b0 FROM {cte}"))


def _bands(name, fn, exprs, cte="ev4", integer=True, real=True, digits=4, ctes=None, source=None):
    cols = ", ".join(f"{_i(e) if integer else sql_fixed(e, digits, real)} AS b{k}" for k, e in enumerate(exprs))
    _add(name, lambda t: shown(fn(t), digits), with_ctes(ctes or [cte], f"SELECT x, y, {cols} FROM {source or cte}"))


def _geometry(name, fn, x, y, where="TRUE", cte="ev", extra=""):
    _add(name, lambda t: shown(fn(t)), with_ctes([cte, "dim"], f"SELECT CAST({x} AS INT) AS x, CAST({y} AS INT) AS y, {_i('v')} AS b0 FROM {cte}, dim{extra} WHERE {where}"))


def _arithmetic():
    _point("add", lambda t: t.ev + t.orders, "a + b", "z")
    _point("subtract", lambda t: t.ev - t.orders, "a - b", "z")
    _point("multiply", lambda t: t.ev * t.orders, "a * b", "z")
    _point("divide", lambda t: t.ev / t.orders, "CASE WHEN b = 0 THEN 0 ELSE a / CAST(b AS DOUBLE) END", "z", False)
    _point("remainder", lambda t: t.orders % t.ev, "CASE WHEN a = 0 THEN 4294967295 ELSE b % a END", "z")
    _point("remainder_const", lambda t: t.ev % 7, "v % 7")
    _point("maxpair", lambda t: A.maxpair(t.ev, t.orders), "greatest(a, b)", "z")
    _point("minpair", lambda t: A.minpair(t.ev, t.orders), "least(a, b)", "z")
    _point("sum", lambda t: A.sum_([t.ev, t.orders, t.ev]), "2 * a + b", "z")
    _point("abs", lambda t: A.abs_(t.ev - 128), "abs(v - 128)")
    _point("sign", lambda t: A.sign(t.ev - 128), "sign(v - 128)")
    _point("invert", lambda t: A.invert(t.ev), "255 - v")
    _point("linear", lambda t: A.linear(t.ev, 1.5, -3.0), "1.5 * v - 3.0", integer=False)
    _point("linear_uchar", lambda t: A.linear(t.ev, 1.5, -30.0, True), "floor(least(255.0, greatest(0.0, 1.5 * v - 30.0)))")
    _point("clamp", lambda t: A.clamp(t.ev, 50, 200), "least(200, greatest(50, v))")
    for rel, op in {"equal": "=", "noteq": "<>", "less": "<", "lesseq": "<=", "more": ">", "moreeq": ">="}.items():
        _point(f"relational_{rel}", lambda t, rel=rel: A.relational(t.ev, t.orders, rel), f"CASE WHEN a {op} b THEN 255 ELSE 0 END", "z")
        _point(f"relational_const_{rel}", lambda t, rel=rel: A.relational(t.ev, 100, rel), f"CASE WHEN v {op} 100 THEN 255 ELSE 0 END")
    for name, expr in {"and": "a & b", "or": "a | b", "eor": "xor(a, b)"}.items():
        _point(f"boolean_{name}", lambda t, n=name: A.boolean(t.ev, t.orders, n), expr, "z")
        _point(f"boolean_const_{name}", lambda t, n=name: A.boolean(t.ev, 60, n), expr.replace("a", "v", 1).replace("b", "60") if name != "eor" else "xor(v, 60)")
    _point("boolean_lshift", lambda t: A.boolean(t.ev, 2, "lshift"), "(v << 2) & 255")
    _point("boolean_rshift", lambda t: A.boolean(t.ev, 2, "rshift"), "v >> 2")
    maths = {"sin": "sin(radians(v))", "cos": "cos(radians(v))", "atan": "degrees(atan(v))", "log": "CASE WHEN v = 0 THEN 0 ELSE ln(v) END", "log10": "CASE WHEN v = 0 THEN 0 ELSE log10(v) END", "asinh": "asinh(v)"}
    for name, expr in maths.items():
        _point(f"math_{name}", lambda t, n=name: A.math(t.val, n), expr, "val", False, False)
    bounded = {"asin": "degrees(asin(v))", "acos": "degrees(acos(v))", "tan": "tan(radians(v))", "exp": "exp(v)", "exp10": "pow(10.0, v)", "sinh": "sinh(v)", "cosh": "cosh(v)", "tanh": "tanh(v)", "atanh": "atanh(v)"}
    for name, expr in bounded.items():
        _add(f"math_{name}", lambda t, n=name: shown(A.math(t.val.point(lambda c: c / 500.0), n)), with_ctes(["val"], f"SELECT x, y, {sql_fixed(expr.replace('v', '(v / 500.0)'), 4, False)} AS b0 FROM val"))
    _add("math_acosh", lambda t: shown(A.math(t.val.point(lambda c: c + 1.0), "acosh")), with_ctes(["val"], f"SELECT x, y, {sql_fixed('acosh(v + 1.0)', 4, False)} AS b0 FROM val"))
    _point("math2_pow", lambda t: A.math2(t.val, 1.5, "pow"), "pow(v, 1.5)", "val", False, False, 3)
    _point("math2_wop", lambda t: A.math2(t.val.point(lambda c: c / 100.0), 2.0, "wop"), "pow(2.0, v / 100.0)", "val", False, False)
    _point("math2_atan2", lambda t: A.math2(t.val, t.val.point(lambda c: c - 250.0), "atan2"), "degrees(atan2(v, v - 250.0))", "val", False, False)
    for how, fn in {"floor": "floor(v)", "ceil": "ceil(v)", "rint": "round_even(v, 0)"}.items():
        _point(f"round_{how}", lambda t, h=how: A.round_(t.val, h), fn, "val", False, False)
    # complex
    _add("complexform", lambda t: shown(A.complexform(t.ev, t.idx)), with_ctes(["ev", "idx"], f"SELECT ev.x, ev.y, {sql_fixed('ev.v')} AS b0_re, {sql_fixed('idx.v')} AS b0_im FROM ev JOIN idx ON ev.x = idx.x AND ev.y = idx.y"))
    z = lambda re, im: f"SELECT x, y, {sql_fixed(re)} AS b0_re, {sql_fixed(im)} AS b0_im FROM cx"
    _add("complex_polar", lambda t: shown(A.complex_(t.cplx, "polar")), with_ctes(["cx"], z("sqrt(re * re + im * im)", "CASE WHEN degrees(atan2(im, re)) < 0 THEN degrees(atan2(im, re)) + 360 ELSE degrees(atan2(im, re)) END")))
    _add("complex_rect", lambda t: shown(A.complex_(t.cplx, "rect")), with_ctes(["cx"], z("re * cos(radians(im))", "re * sin(radians(im))")))
    _add("complex_conj", lambda t: shown(A.complex_(t.cplx, "conj")), with_ctes(["cx"], z("re", "-im")))
    norm = "sqrt(pow(re * re2 + im * im2, 2) + pow(im * re2 - re * im2, 2))"
    _add("complex2_cross_phase", lambda t: shown(A.cross_phase(t.cplx, t.cplx2), 3), with_ctes(["cx"], f"SELECT x, y, {sql_fixed(f'(re * re2 + im * im2) / {norm}', 3)} AS b0_re, {sql_fixed(f'(im * re2 - re * im2) / {norm}', 3)} AS b0_im FROM cx"))
    for part in ("real", "imag"):
        _point(f"complexget_{part}", lambda t, p=part: A.complexget(t.cplx, p), "re" if part == "real" else "im", "cx", False)
    _point("complex_abs", lambda t: A.abs_(t.cplx), "sqrt(re * re + im * im)", "cx", False)
    # statistics
    cut = lambda c, d=4: fixed(F.col(c), d).alias(c)
    _add("avg", lambda t: A.avg(t.ev3).select(cut("avg")), with_ctes(["ev4"], f"SELECT {sql_fixed('sum(b0 + b1 + b2) / (3.0 * count(*))', 4, False)} AS avg FROM ev4"))
    dev = "sqrt(abs(sum(v * v) - sum(v) * CAST(sum(v) AS DOUBLE) / count(*)) / (count(*) - 1))"
    _add("deviate", lambda t: A.deviate(t.ev).select(cut("deviate")), with_ctes(["ev"], f"SELECT {sql_fixed(dev, 4, False)} AS deviate FROM ev"))
    for name, up in (("max", True), ("min", False)):
        _add(name, lambda t, up=up: A.extremes(t.ev, up, 10).select("x", "y", F.col("v").cast("long").alias("v")), with_ctes(["ev"], f"SELECT x, y, {_i('v')} AS v FROM ev ORDER BY v {'DESC' if up else 'ASC'}, y, x LIMIT 10"))
    _add("getpoint", lambda t: A.getpoint(t.ev3, 10, 20).select(*[F.col(f"b{k}").cast("long").alias(f"b{k}") for k in range(3)]), with_ctes(["ev4"], f"SELECT {_i('b0')} AS b0, {_i('b1')} AS b1, {_i('b2')} AS b2 FROM ev4 WHERE x = 10 AND y = 20"))
    band = "SELECT x, y, CAST(0 AS INT) AS band, b0 AS v FROM ev4 UNION ALL SELECT x, y, 1, b1 FROM ev4 UNION ALL SELECT x, y, 2, b2 FROM ev4"
    row = f"min(v) AS min, max(v) AS max, sum(v) AS sum, sum(v * v) AS sum2, {sql_fixed('sum(v) / CAST(count(*) AS DOUBLE)', 4, False)} AS avg, {sql_fixed(dev, 4, False)} AS sd, min(struct_pack(v := v, y := y, x := x)) AS lo, min(struct_pack(v := -v, y := y, x := x)) AS hi"
    fields = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("min", "max", "sum", "sum2"))
    _add("stats", lambda t: A.stats(t.ev3).select("band", "min", "max", "sum", "sum2", cut("avg"), cut("sd"), "xmin", "ymin", "xmax", "ymax"),
         with_ctes(["ev4"], f"SELECT band, {fields}, avg, sd, lo.x AS xmin, lo.y AS ymin, hi.x AS xmax, hi.y AS ymax FROM (SELECT CAST(coalesce(band, -1) AS INT) AS band, {row} FROM lf GROUP BY ROLLUP (band))", {"lf": band}))
    _add("hist_find", lambda t: A.hist_find(t.ev3), with_ctes(["ev4"], "SELECT CAST(b AS INT) AS band, CAST(k AS INT) AS bin, coalesce(n, 0) AS n FROM range(3) r(b) CROSS JOIN range(256) s(k) LEFT JOIN (SELECT band, v, count(*) AS n FROM lf GROUP BY 1, 2) h ON h.band = b AND h.v = k", {"lf": band}))
    for how in ("sum", "max", "min"):
        _add(f"hist_find_indexed_{how}", lambda t, h=how: A.hist_find_indexed(t.ev, t.idx, h), with_ctes(["ev", "idx"], f"SELECT CAST(idx.v AS INT) AS bin, CAST({how}(ev.v) AS DOUBLE) AS b0 FROM ev JOIN idx ON ev.x = idx.x AND ev.y = idx.y GROUP BY 1"))
        _add(f"project_{how}", lambda t, h=how: A.project(t.ev, h), with_ctes(["ev"], f"SELECT 'column' AS axis, x AS pos, CAST({how}(v) AS DOUBLE) AS b0 FROM ev GROUP BY x UNION ALL SELECT 'row', y, CAST({how}(v) AS DOUBLE) FROM ev GROUP BY y"))
    _add("hist_find_ndim", lambda t: A.hist_find_ndim(t.ev3, 8), with_ctes(["ev4"], "SELECT CAST(b0 // 32 AS INT) AS c0, CAST(b1 // 32 AS INT) AS c1, CAST(b2 // 32 AS INT) AS c2, count(*) AS n FROM ev4 GROUP BY 1, 2, 3"))
    _add("profile", lambda t: A.profile(t.bin), with_ctes(["bn", "dim"], "SELECT 'column' AS axis, x AS pos, CAST(coalesce(min(CASE WHEN v <> 0 THEN y END), (SELECT my + 1 FROM dim)) AS INT) AS b0 FROM bn GROUP BY x UNION ALL SELECT 'row', y, CAST(coalesce(min(CASE WHEN v <> 0 THEN x END), 100) AS INT) FROM bn GROUP BY y"))
    _add("measure", lambda t: A.measure(t.ev, 4, 5).select("h", "v", cut("b0")), with_ctes(["ev", "dim"],
         f"SELECT CAST(floor(x / 25.0) AS INT) AS h, CAST(floor(y / ph) AS INT) AS v, {sql_fixed('avg(CAST(ev.v AS DOUBLE))', 4, False)} AS b0 FROM ev, (SELECT (my + 1) / 5.0 AS ph FROM dim) WHERE x - floor(x / 25.0) * 25 >= 6.25 AND x - floor(x / 25.0) * 25 < 18.75 AND y - floor(y / ph) * ph >= ph / 4 AND y - floor(y / ph) * ph < ph * 0.75 GROUP BY 1, 2"))
    hl = "SELECT CAST(i AS INT) AS x, CAST(floor((x / d * cos(i * (pi() / 64)) + y / d * sin(i * (pi() / 64)) + 1) * 32.0) AS INT) AS y FROM bn, (SELECT sqrt(10000.0 + (my + 1) * (my + 1)) AS d FROM dim), range(64) t(i) WHERE v <> 0"
    _add("hough_line", lambda t: A.hough_line(t.bin, 64, 64), with_ctes(["bn", "dim"], f"SELECT x, y, count(*) AS n FROM ({hl}) WHERE y >= 0 AND y < 64 GROUP BY 1, 2"))
    _add("hough_circle", lambda t: A.hough_circle(t.bin, 1, 5, 7), None)
    _add("find_trim", lambda t: A.find_trim(t.bin, 10.0), with_ctes(["bn", "dim"], "SELECT CAST(min(x) AS INT) AS left, CAST(min(y) AS INT) AS top, CAST(max(x) - min(x) + 1 AS INT) AS width, CAST(max(y) - min(y) + 1 AS INT) AS height FROM (" + _NB_MEDIAN + ") WHERE m > 10", {"m": _offsets(3, 3), "nb": _NEIGHBOURS.replace("ev ", "bn ")}))
    # texture
    _add("cooccurrence", lambda t: A.cooccurrence(t.idx).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n"), with_ctes(["idx"], f"SELECT {_i('p.v')} AS a, {_i('q.v')} AS b, count(*) AS n FROM idx p JOIN idx q ON q.x = p.x + 1 AND q.y = p.y GROUP BY 1, 2"))
    co = "SELECT p.v AS a, q.v AS b, count(*) AS n FROM idx p JOIN idx q ON q.x = p.x + 1 AND q.y = p.y GROUP BY 1, 2"
    _add("texture", lambda t: A.texture(t.idx).select(cut("asm"), cut("contrast"), cut("entropy")), with_ctes(["idx"], f"SELECT {sql_fixed('sum(p * p)', 4, False)} AS asm, {sql_fixed('sum(p * pow(a - b, 2))', 4, False)} AS contrast, {sql_fixed('-sum(p * log2(p))', 4, False)} AS entropy FROM (SELECT a, b, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM co)", {"co": co}))
    _add("grey_differences", lambda t: A.differences(t.idx).select(F.col("d").cast("long").alias("d"), "n"), with_ctes(["idx"], "SELECT CAST(abs(a - b) AS BIGINT) AS d, CAST(sum(n) AS BIGINT) AS n FROM co GROUP BY 1", {"co": co}))
    _add("linreg", lambda t: A.linreg([t.ev, t.idx, t.bin], [0, 1, 2]).select("x", "y", cut("intercept"), cut("slope")),
         with_ctes(["ev", "idx", "bn"], f"SELECT x, y, {sql_fixed('regr_intercept(v, t)', 4, False)} AS intercept, {sql_fixed('regr_slope(v, t)', 4, False)} AS slope FROM (SELECT x, y, v, 0.0 AS t FROM ev UNION ALL SELECT x, y, v, 1.0 FROM idx UNION ALL SELECT x, y, v, 2.0 FROM bn) GROUP BY x, y"))
    _point("zerox", lambda t: A.zerox(t.ev - 128), "CASE WHEN v < 128 AND lead(v) OVER (PARTITION BY y ORDER BY x) >= 128 THEN 255 ELSE 0 END")


def _offsets(w: int, h: int) -> str:
    return f"SELECT i - {w // 2} AS dx, j - {h // 2} AS dy FROM range({w}) a(i), range({h}) b(j)"


_NEIGHBOURS = "SELECT p.x, p.y, p.v AS c, m.dx, m.dy, q.v FROM ev p CROSS JOIN m CROSS JOIN dim JOIN ev q ON q.x = least(greatest(p.x + m.dx, 0), 99) AND q.y = least(greatest(p.y + m.dy, 0), dim.my)"
_NB_MEDIAN = "SELECT x, y, list_sort(list(v))[5] AS m FROM nb GROUP BY x, y"


def _mask_sql(mask) -> str:
    h, w = len(mask), len(mask[0])
    rows = ", ".join(f"({x - w // 2}, {y - h // 2}, {v})" for y, line in enumerate(mask) for x, v in enumerate(line))
    return f"SELECT * FROM (VALUES {rows}) t(dx, dy, c)"


def _nb(name, fn, mask, expr, integer=True, digits=4, cte="ev", real=True):
    """A neighbourhood query: ``expr`` aggregates nb(x, y, c: centre, k: coefficient, v: neighbour)."""
    src = _NEIGHBOURS.replace("ev ", f"{cte} ").replace("m.dx, m.dy, q.v", "m.dx, m.dy, m.c AS k, q.v")
    value = _i(expr) if integer else sql_fixed(expr, digits, real)
    _add(name, lambda t: shown(fn(t), digits), with_ctes([cte, "dim"], f"SELECT x, y, {value} AS b0 FROM nb GROUP BY x, y", {"m": _mask_sql(mask), "nb": src}))


SHARP, BLUR, SOBEL = [[-1, -1, -1], [-1, 16, -1], [-1, -1, -1]], [[1, 1, 1], [1, 1, 1], [1, 1, 1]], [[1, 2, 1], [0, 0, 0], [-1, -2, -1]]
CROSS = [[128, 255, 128], [255, 255, 255], [128, 255, 128]]


def _neighbourhoods():
    trunc = lambda e, n: f"trunc(({e}) / CAST({n} AS DOUBLE))"
    clip = lambda e: f"least(255, greatest(0, {e}))"
    for name, mask, scale in (("sharp", SHARP, 8), ("blur", BLUR, 9)):
        _nb(f"convi_{name}", lambda t, m=mask, s=scale: N.convi(t.ev, m, s), mask, clip(trunc(f"sum(k * v) + {scale // 2}", scale)))
        _nb(f"convf_{name}", lambda t, m=mask, s=scale: N.convf(t.ev, m, s), mask, f"sum(k * v) / {float(scale)}", False)
    _nb("conv_offset", lambda t: N.convi(t.ev, SOBEL, 1, 128), SOBEL, clip("sum(k * v) + 128"))
    _add("conva", lambda t: shown(N.conva(t.ev, BLUR, 9), 2), _SQL["convf_blur"].replace("10000.0", "100.0"))
    line = [[1.0, 2.0, 1.0]]
    one = f"SELECT x, y, CAST({clip(trunc('sum(m.c * q) + 2', 4))} AS BIGINT) AS v FROM (SELECT p.x, p.y, m.c, q.v AS q FROM ev p CROSS JOIN (VALUES (-1, 1), (0, 2), (1, 1)) m(d, c) JOIN ev q ON q.y = p.y AND q.x = least(greatest(p.x + m.d, 0), 99)) m GROUP BY x, y"
    two = f"SELECT x, y, CAST({clip(trunc('sum(m.c * q) + 2', 4))} AS BIGINT) AS b0 FROM (SELECT p.x, p.y, m.c, q.v AS q FROM h p CROSS JOIN dim CROSS JOIN (VALUES (-1, 1), (0, 2), (1, 1)) m(d, c) JOIN h q ON q.x = p.x AND q.y = least(greatest(p.y + m.d, 0), dim.my)) m GROUP BY x, y"
    _add("convsep", lambda t: shown(N.convsep(t.ev, line[0], 4, 0, "integer")), with_ctes(["ev", "dim"], two, {"h": one}))
    _add("convasep", lambda t: shown(N.convasep(t.ev, line[0], 4)))
    g, s = N.gaussline(1.5, 0.2)
    values = ", ".join(f"({i - len(g) // 2}, {int(v)})" for i, v in enumerate(g))
    _add("gaussblur", lambda t: shown(N.gaussblur(t.ev, 1.5)), with_ctes(["ev", "dim"], two.replace("(VALUES (-1, 1), (0, 2), (1, 1))", f"(VALUES {values})").replace("+ 2)", f"+ {int(s) // 2})").replace("CAST(4 AS", f"CAST({int(s)} AS"),
         {"h": one.replace("(VALUES (-1, 1), (0, 2), (1, 1))", f"(VALUES {values})").replace("+ 2)", f"+ {int(s) // 2})").replace("CAST(4 AS", f"CAST({int(s)} AS")}))
    for name, fn, a, b in (("sobel", N.sobel, 1, 2), ("scharr", N.scharr, 3, 10), ("prewitt", N.prewitt, 1, 1)):
        gx = "sum(CASE dx WHEN -1 THEN 1 WHEN 1 THEN -1 ELSE 0 END * CASE dy WHEN 0 THEN {b} ELSE {a} END * v)".format(a=a, b=b)
        gy = "sum(CASE dy WHEN -1 THEN 1 WHEN 1 THEN -1 ELSE 0 END * CASE dx WHEN 0 THEN {b} ELSE {a} END * v)".format(a=a, b=b)
        half = lambda e: f"least(127, greatest(-128, trunc(({e} + 1) / 2.0)))"
        _nb(name, lambda t, fn=fn: fn(t.ev), BLUR, f"least(255, 2 * (abs({half(gx)}) + abs({half(gy)})))")
    turned = N.rotated45(SOBEL, 2)
    pick = lambda m: "abs(sum(v * (CASE " + " ".join(f"WHEN dx = {x - 1} AND dy = {y - 1} THEN {v}" for y, line_ in enumerate(m) for x, v in enumerate(line_)) + " END)))"
    for how, f in (("max", "greatest({}, {})"), ("min", "least({}, {})"), ("sum", "{} + {}")):
        _nb(f"compass_{how}", lambda t, h=how: N.compass(t.ev, SOBEL, 2, 90, h), BLUR, f.format(pick(SOBEL), pick(turned)), False)
    ref = [[10, 50, 200], [40, 90, 30], [250, 5, 120]]
    _nb("fastcor", lambda t: N.fastcor(t.ev, ref), ref, "sum((k - v) * (k - v))")
    n, mean = 9, sum(map(sum, ref)) / 9
    spread = sum((v - mean) ** 2 for line_ in ref for v in line_)
    below = f"sqrt(greatest(0.0, sum(CAST(v * v AS DOUBLE)) - sum(v) * CAST(sum(v) AS DOUBLE) / {n}) * {spread!r})"
    _nb("spcor", lambda t: N.spcor(t.ev, ref), ref, f"CASE WHEN {below} = 0 THEN 0.0 ELSE sum((k - {mean!r}) * v) / {below} END", False)
    _add("canny", lambda t: shown(N.canny(t.ev), 2))
    _add("sharpen", lambda t: shown(N.sharpen(t.lab), 3))
    # morphology
    match = "CASE WHEN k = 255 THEN v <> 0 WHEN k = 0 THEN v = 0 END"
    for op, agg in (("erode", "bool_and"), ("dilate", "bool_or")):
        _nb(f"morph_{op}", lambda t, o=op: M.morph(t.bin, CROSS, o), CROSS, f"CASE WHEN {agg}({match}) THEN 255 ELSE 0 END", cte="bn")
    for name, idx in (("rank", 2), ("median", 4), ("rank_min", 0), ("rank_max", 8)):
        _nb(name, lambda t, i=idx: M.rank(t.ev, 3, 3, i), BLUR, f"list_sort(list(v))[{idx + 1}]")
    five = [[1] * 5 for _ in range(5)]
    _nb("hist_local", lambda t: H.hist_local(t.ev, 5, 5), five, "floor(255 * sum(CASE WHEN v <= c THEN 1 ELSE 0 END) / 25.0)")
    _add("hist_local_slope", lambda t: shown(H.hist_local(t.ev, 5, 5, 3)))
    mean_, sd = "(sum(CAST(v AS DOUBLE)) / 25.0)", "sqrt(greatest(0.0, sum(CAST(v * v AS DOUBLE)) / 25.0 - (sum(CAST(v AS DOUBLE)) / 25.0) * (sum(CAST(v AS DOUBLE)) / 25.0)))"
    _nb("stdif", lambda t: H.stdif(t.ev, 5, 5), five, f"least(255, greatest(0, floor(0.5 * 128.0 + (1 - 0.5) * {mean_} + (any_value(c) - {mean_}) * (0.5 * 50.0 / (50.0 + 0.5 * {sd})) + 0.5)))")
    for d, part, order, size in (("horizontal", "x", "y", "100.0"), ("vertical", "y", "x", "(SELECT my + 1.0 FROM dim)")):
        _add(f"countlines_{d}", lambda t, d=d: M.countlines(t.ev, d).select(fixed(F.col("nolines")).alias("nolines")), with_ctes(["ev", "dim"], f"SELECT {sql_fixed(f'sum(u) / {size}', 4, False)} AS nolines FROM (SELECT CASE WHEN v >= 128 AND lag(v) OVER (PARTITION BY {part} ORDER BY {order}) < 128 THEN 1.0 ELSE 0.0 END AS u FROM ev)"))
    # Regions from a sparse mask, whose regions are small enough for a recursive query.
    _add("labelregions", lambda t: shown(M.labelregions(A.relational(t.ev, 200, "more"))))
    _add("fill_nearest", lambda t: M.fill_nearest(t.ev.point(lambda c: F.when(c >= 128, c).otherwise(0))).select("x", "y", F.col("b0").cast("long").alias("b0"), fixed(F.col("distance")).alias("distance")),
         with_ctes(["ev"], f"SELECT p.x, p.y, {_i('arg_min(q.v, struct_pack(d := (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y), sy := q.y, sx := q.x))')} AS b0, {sql_fixed('sqrt(min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)))', 4, False)} AS distance FROM ev p JOIN ev q ON q.v >= 128 AND abs(p.x - q.x) <= 12 AND abs(p.y - q.y) <= 12 GROUP BY p.x, p.y"))


def _conversion():
    def joined(name, fn, exprs, cte, source, integer=True):
        _bands(name, fn, exprs, integer=integer, ctes=cte, source=source)

    for b in range(3):
        _bands(f"extract_band_{b}", lambda t, b=b: V.extract_band(t.ev3, b), [f"b{b}"])
    both = "(SELECT e.*, idx.v AS i FROM ev4 e JOIN idx ON e.x = idx.x AND e.y = idx.y)"
    joined("bandjoin", lambda t: V.bandjoin([t.ev3, t.idx]), ["b0", "b1", "b2", "i"], ["ev4", "idx"], both)
    _bands("bandjoin_const", lambda t: V.bandjoin_const(t.ev, [7, 300]), ["v", "7", "255"], "ev")
    _bands("addalpha", lambda t: V.addalpha(t.ev3), ["b0", "b1", "b2", "255"])
    _bands("bandmean", lambda t: V.bandmean(t.ev3), ["(b0 + b1 + b2 + 1) // 3"])
    for op, e in {"and": "b0 & b1 & b2", "or": "b0 | b1 | b2", "eor": "xor(xor(b0, b1), b2)"}.items():
        _bands(f"bandbool_{op}", lambda t, o=op: V.bandbool(t.ev3, o), [e])
    three = "(SELECT ev.x, ev.y, ev.v AS p, idx.v AS q, bn.v AS r FROM ev JOIN idx ON ev.x = idx.x AND ev.y = idx.y JOIN bn ON ev.x = bn.x AND ev.y = bn.y)"
    for name, k in (("bandrank", -1), ("bandrank_min", 0), ("bandrank_max", 2)):
        joined(name, lambda t, k=k: V.bandrank([t.ev, t.idx, t.bin], k), [f"list_sort([p, q, r])[{2 if k < 0 else k + 1}]"], ["ev", "idx", "bn"], three)
    _add("bandfold", lambda t: shown(V.bandfold(t.ev, 4)), with_ctes(["ev"], "SELECT CAST(x // 4 AS INT) AS x, y, " + ", ".join(f"CAST(max(CASE WHEN x % 4 = {k} THEN v END) AS BIGINT) AS b{k}" for k in range(4)) + " FROM ev GROUP BY x // 4, y"))
    _add("bandunfold", lambda t: shown(V.bandunfold(t.ev3)), with_ctes(["ev4"], "SELECT CAST(x * 3 + k AS INT) AS x, y, CAST(CASE k WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS BIGINT) AS b0 FROM ev4 CROSS JOIN range(3) t(k)"))
    m = [[0.3, 0.6, 0.1], [0.5, -0.25, 0.75]]
    _bands("recomb", lambda t: V.recomb(t.ev3, m), [f"{r[0]} * b0 + {r[1]} * b1 + {r[2]} * b2" for r in m], integer=False)
    _point("msb", lambda t: V.msb(t.orders), "v >> 24", "od")
    _point("byteswap", lambda t: V.byteswap(V.cast(t.orders, "ushort")), "((least(65535, v) & 255) << 8) | (least(65535, v) >> 8)", "od")
    lim = {f: RANGE[f] for f in RANGE}
    for f, (lo, hi) in lim.items():
        _point(f"cast_{f}", lambda t, f=f: V.cast(t.val.point(lambda c: c * 300.0 - 40000.0), f), f"trunc(least({hi}, greatest({lo}, v * 300.0 - 40000.0)))", "val")
    for f in ("float", "double"):
        _point(f"cast_{f}", lambda t, f=f: V.cast(t.ev, f), "v", integer=False)
    _point("cast_shift_up", lambda t: V.cast(t.ev, "ushort", True), "(v << 8) + 255 * (v & 1)")
    _point("cast_shift_down", lambda t: V.cast(V.cast(t.orders, "ushort"), "uchar", True), "least(65535, v) >> 8", "od")
    _point("copy", lambda t: V.copy(t.ev, interpretation="b_w"), "v")
    # geometry
    _geometry("extract_area", lambda t: V.extract_area(t.ev, 10, 20, 30, 15), "x - 10", "y - 20", "x >= 10 AND x < 40 AND y >= 20 AND y < 35")
    _geometry("flip_horizontal", lambda t: V.flip(t.ev, "horizontal"), "99 - x", "y")
    _geometry("flip_vertical", lambda t: V.flip(t.ev, "vertical"), "x", "my - y")
    _geometry("rot_d90", lambda t: V.rot(t.ev, "d90"), "my - y", "x")
    _geometry("rot_d180", lambda t: V.rot(t.ev, "d180"), "99 - x", "my - y")
    _geometry("rot_d270", lambda t: V.rot(t.ev, "d270"), "y", "99 - x")
    orient = {1: ("x", "y"), 2: ("99 - x", "y"), 3: ("99 - x", "my - y"), 4: ("x", "my - y"), 5: ("y", "x"), 6: ("my - y", "x"), 7: ("my - y", "99 - x"), 8: ("y", "99 - x")}
    for o, (x, y) in orient.items():
        _geometry(f"autorot_{o}", lambda t, o=o: V.autorot(t.ev, o), x, y)
    _add("rot45", lambda t: shown(V.rot45(V.extract_area(t.ev, 0, 0, 5, 5))), with_ctes(["ev"], "SELECT CAST(m.nx AS INT) AS x, CAST(m.ny AS INT) AS y, CAST(v AS BIGINT) AS b0 FROM ev JOIN (VALUES " + ", ".join(str(k) for k in _rot45_places(5)) + ") m(px, py, nx, ny) ON ev.x = m.px AND ev.y = m.py"))
    _geometry("wrap", lambda t: V.wrap(t.ev), "(x + 50) % 100", "(y + (my + 1) // 2) % (my + 1)")
    _geometry("transpose3d", lambda t: V.transpose3d(t.ev, 10), "x", "(y % 10) * ((my + 1) // 10) + y // 10")
    _geometry("subsample", lambda t: V.subsample(t.ev, 3, 2), "x // 3", "y // 2", "x % 3 = 0 AND y % 2 = 0 AND x < 99 AND y // 2 < (my + 1) // 2")
    _geometry("zoom", lambda t: V.zoom(t.ev, 2, 3), "x * 2 + i", "y * 3 + j", extra=", range(2) a(i), range(3) b(j)")
    _geometry("replicate", lambda t: V.replicate(t.ev, 2, 2), "x + 100 * i", "y + (my + 1) * j", extra=", range(2) a(i), range(2) b(j)")
    _geometry("grid", lambda t: V.grid_(t.ev, 10, 2, t.ev.height // 20), "x + 100 * ((y // 10) % 2)", "y % 10 + 10 * (y // 10 // 2)")
    canvas = "(SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y FROM range(120) a(i), (SELECT unnest(range(my + 31)) AS j FROM dim))"
    for ext, fill in (("black", 0), ("white", 255), ("background", 77)):
        _add(f"embed_{ext}", lambda t, e=ext: shown(V.embed(t.ev, 10, 20, 120, t.ev.height + 30, e, 77)), with_ctes(["ev", "dim"], f"SELECT c.x, c.y, CAST(coalesce(ev.v, {fill}) AS BIGINT) AS b0 FROM {canvas} c LEFT JOIN ev ON ev.x = c.x - 10 AND ev.y = c.y - 20"))
    wrap = {"copy": ("least(99, greatest(0, c.x - 10))", "least(my, greatest(0, c.y - 20))"), "repeat": ("(c.x + 90) % 100", "(c.y - 20 + 2 * (my + 1)) % (my + 1)"),
            "mirror": ("CASE WHEN (c.x + 190) % 200 < 100 THEN (c.x + 190) % 200 ELSE 199 - (c.x + 190) % 200 END", "CASE WHEN (c.y - 20 + 4 * (my + 1)) % (2 * (my + 1)) <= my THEN (c.y - 20 + 4 * (my + 1)) % (2 * (my + 1)) ELSE 2 * my + 1 - (c.y - 20 + 4 * (my + 1)) % (2 * (my + 1)) END")}
    for ext, (x, y) in wrap.items():
        _add(f"embed_{ext}", lambda t, e=ext: shown(V.embed(t.ev, 10, 20, 120, t.ev.height + 30, e)), with_ctes(["ev", "dim"], f"SELECT c.x, c.y, CAST(ev.v AS BIGINT) AS b0 FROM {canvas} c CROSS JOIN dim JOIN ev ON ev.x = {x} AND ev.y = {y}"))
    for d in ("centre", "north", "east", "south", "west", "north_east", "south_east", "south_west", "north_west"):
        gx = "0" if "west" in d else "20" if "east" in d else "10"
        gy = "0" if "north" in d else "30" if "south" in d else "15"
        _add(f"gravity_{d}", lambda t, d=d: shown(V.gravity(t.ev, d, 120, t.ev.height + 30)), with_ctes(["ev", "dim"], f"SELECT c.x, c.y, CAST(coalesce(ev.v, 0) AS BIGINT) AS b0 FROM {canvas} c LEFT JOIN ev ON ev.x = c.x - {gx} AND ev.y = c.y - {gy}"))
    _add("insert", lambda t: shown(V.insert(t.ev, t.part, 30, 10)), with_ctes(["ev", "pt", "dim"], "SELECT ev.x, ev.y, CAST(coalesce(pt.v, ev.v) AS BIGINT) AS b0 FROM ev LEFT JOIN pt ON pt.x = ev.x - 30 AND pt.y = ev.y - 10"))
    pdim = "(SELECT max(y) AS py FROM pt)"
    _add("insert_expand", lambda t: shown(V.insert(t.ev, t.part, 80, 10, True, 9)), with_ctes(["ev", "pt", "dim"], f"SELECT c.x, c.y, CAST(coalesce(pt.v, ev.v, 9) AS BIGINT) AS b0 FROM (SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y FROM range(130) a(i), (SELECT unnest(range(greatest(my, py + 10) + 1)) AS j FROM dim, {pdim})) c LEFT JOIN ev ON ev.x = c.x AND ev.y = c.y LEFT JOIN pt ON pt.x = c.x - 80 AND pt.y = c.y - 10"))
    _add("join_horizontal", lambda t: shown(V.join(t.ev, t.ev, "horizontal", shim=3)), with_ctes(["ev", "dim"], "SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, CAST(coalesce(a.v, b.v, 0) AS BIGINT) AS b0 FROM range(203) r(i) CROSS JOIN (SELECT unnest(range(my + 1)) AS j FROM dim) LEFT JOIN ev a ON a.x = i AND a.y = j LEFT JOIN ev b ON b.x = i - 103 AND b.y = j"))
    _add("join_vertical", lambda t: shown(V.join(t.ev, t.ev, "vertical")), with_ctes(["ev", "dim"], "SELECT x, y, CAST(v AS BIGINT) AS b0 FROM ev UNION ALL SELECT x, CAST(y + my + 1 AS INT), CAST(v AS BIGINT) FROM ev, dim"))
    _add("arrayjoin", lambda t: shown(V.arrayjoin([t.ev, t.idx, t.bin], 2, 1, 5)), with_ctes(["ev", "idx", "bn", "dim"],
         "SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, CAST(coalesce(a.v, b.v, c.v, 5) AS BIGINT) AS b0 FROM range(201) r(i) CROSS JOIN (SELECT unnest(range(2 * my + 3)) AS j, my FROM dim) LEFT JOIN ev a ON a.x = i AND a.y = j LEFT JOIN idx b ON b.x = i - 101 AND b.y = j LEFT JOIN bn c ON c.x = i AND c.y = j - my - 2"))
    trio = "(SELECT bn.x, bn.y, bn.v AS c, ev.v AS p, idx.v AS q FROM bn JOIN ev ON ev.x = bn.x AND ev.y = bn.y JOIN idx ON idx.x = bn.x AND idx.y = bn.y)"
    joined("ifthenelse", lambda t: V.ifthenelse(t.bin, t.ev, t.idx), ["CASE WHEN c <> 0 THEN p ELSE q END"], ["bn", "ev", "idx"], trio)
    joined("ifthenelse_blend", lambda t: V.ifthenelse(t.ev, t.ev, t.bin, True), ["(p * p + (255 - p) * c + 128) // 255"], ["bn", "ev", "idx"], trio)
    joined("switch", lambda t: V.switch([t.ev > 200, t.bin, t.idx]), ["CASE WHEN p > 200 THEN 0 WHEN c <> 0 THEN 1 WHEN q <> 0 THEN 2 ELSE 3 END"], ["bn", "ev", "idx"], trio)
    joined("case", lambda t: H.case(t.idx, [t.ev, t.bin, t.idx]), ["CASE WHEN q = 0 THEN p WHEN q = 1 THEN c ELSE q END"], ["bn", "ev", "idx"], trio)
    # alpha and range
    _bands("flatten", lambda t: V.flatten(t.ev4, [10, 20, 30]), [f"floor((b{k} * CAST(b3 AS DOUBLE) + {10 * (k + 1)}.0 * (255.0 - b3)) / 255.0)" for k in range(3)])
    _bands("premultiply", lambda t: V.premultiply(t.ev4), [f"b{k} * CAST(b3 AS DOUBLE) / 255.0" for k in range(3)] + ["b3"], integer=False)
    _bands("unpremultiply", lambda t: V.unpremultiply(t.ev4), [f"CASE WHEN b3 = 0 THEN 0.0 ELSE CAST(b{k} AS DOUBLE) * 255.0 / b3 END" for k in range(3)] + ["b3"], integer=False, digits=2)
    _point("gamma", lambda t: V.gamma(t.ev), f"floor(pow(v, 1 / 2.4) / {255 ** (1 / 2.4) / 255!r} + 0.5)")
    _add("scale", lambda t: shown(V.scale(t.orders)), with_ctes(["od"], "SELECT x, y, CAST(least(255, floor((v - lo) * (255.0 / CAST(hi - lo AS DOUBLE)) + 0.5)) AS BIGINT) AS b0 FROM od, (SELECT min(v) AS lo, max(v) AS hi FROM od)"))
    _add("scale_log", lambda t: shown(V.scale(t.orders, True)), with_ctes(["od"], "SELECT x, y, CAST(least(255, floor((255.0 / log10(1.0 + pow(hi, 0.25))) * log10(1.0 + pow(v, 0.25)) + 0.5)) AS BIGINT) AS b0 FROM od, (SELECT CAST(max(v) AS DOUBLE) AS hi FROM od)"))
    ramp = lambda a, b: f"greatest(0.0, least(255.0, (v - {a}.0) * 255.0 / {b - a}.0))"
    _bands("falsecolour", lambda t: V.falsecolour(t.ev), [f"floor({ramp(64, 160)})", f"floor({ramp(128, 224)})", f"floor(CASE WHEN v < 96 THEN {ramp(0, 64)} WHEN v < 192 THEN 255.0 - {ramp(96, 160)} ELSE {ramp(192, 255)} END)"], "ev")
    for mode in blend.MODES:
        _add(f"composite2_{mode}", lambda t, m=mode: shown(V.composite2(t.ev4, t.over, m)), _composite_sql(mode))
    _add("composite", lambda t: shown(V.composite([t.ev4, t.over, t.ev4], ["over", "multiply"])))
    for how in ("low", "high", "centre", "all"):
        left, top = {"low": ("0", "0"), "high": ("40", "my - 49"), "centre": ("20", "(my + 1 - 50) // 2"), "all": ("0", "0")}[how]
        where = "TRUE" if how == "all" else f"x >= {left} AND x < {left} + 60 AND y >= {top} AND y < {top} + 50"
        _geometry(f"smartcrop_{how}", lambda t, h=how: V.smartcrop(t.ev, 60, 50, h), f"x - ({left})", f"y - ({top})", where)
    for how in ("entropy", "attention"):
        # Entropies of slices and blurred scores decide step by step: no SQL.
        _add(f"smartcrop_{how}", lambda t, h=how: shown(V.smartcrop(t.ev3 if h == "attention" else t.ev, 60, 50, h)))
    for name in ("tilecache", "linecache", "cache"):
        _point(name, lambda t: V.sequential(t.ev), "v")
    _point("sequential", lambda t: V.sequential(t.ev), "v")


def _rot45_places(n: int):
    """(x, y, x', y') of an odd square turned once."""
    flat = N.rotated45([[y * n + x for x in range(n)] for y in range(n)], 1)
    return [(v % n, v // n, x, y) for y, line in enumerate(flat) for x, v in enumerate(line)]


def _composite_sql(mode: str) -> str:
    """The blend in SQL: alphas aa, ab and premultiplied colours a{k}, b{k}, in nested selects."""
    pd = {"clear": ("0", "0", "0"), "source": ("1", "0", "aa"), "over": ("1", "(1 - aa)", "aa + ab * (1 - aa)"), "in": ("ab", "0", "aa * ab"), "out": ("(1 - ab)", "0", "aa * (1 - ab)"), "atop": ("1", "(1 - aa)", "ab"),
          "dest": ("0", "1", "ab"), "dest_over": ("(1 - ab)", "1", "ab + aa * (1 - ab)"), "dest_in": ("0", "aa", "aa * ab"), "dest_out": ("0", "(1 - aa)", "(1 - aa) * ab"), "dest_atop": ("(1 - ab)", "1", "aa"),
          "xor": ("(1 - ab)", "(1 - aa)", "aa + ab - 2 * aa * ab"), "add": ("1", "1", "least(1.0, aa + ab)"), "saturate": ("least(aa, 1 - ab)", "1", "least(1.0, aa + ab)")}
    sep = {"multiply": "{a} * {b}", "screen": "{a} + {b} - {a} * {b}", "overlay": "CASE WHEN {b} <= 0.5 THEN 2 * {a} * {b} ELSE 1 - 2 * (1 - {a}) * (1 - {b}) END", "darken": "least({a}, {b})", "lighten": "greatest({a}, {b})",
           "colour_dodge": "CASE WHEN {a} < 1 THEN least(1.0, {b} / (1 - {a})) ELSE 1.0 END", "colour_burn": "CASE WHEN {a} > 0 THEN 1 - least(1.0, (1 - {b}) / {a}) ELSE 0.0 END",
           "hard_light": "CASE WHEN {a} <= 0.5 THEN 2 * {a} * {b} ELSE 1 - 2 * (1 - {a}) * (1 - {b}) END",
           "soft_light": "CASE WHEN {a} <= 0.5 THEN {b} - (1 - 2 * {a}) * {b} * (1 - {b}) ELSE {b} + (2 * {a} - 1) * (CASE WHEN {b} <= 0.25 THEN ((16 * {b} - 12) * {b} + 4) * {b} ELSE sqrt({b}) END - {b}) END",
           "difference": "abs({a} - {b})", "exclusion": "{a} + {b} - 2 * {a} * {b}"}
    base = "SELECT e.x, e.y, o3 / 255.0::DOUBLE AS aa, b3 / 255.0::DOUBLE AS ab, " + ", ".join(f"(o{k} / 255.0::DOUBLE) * (o3 / 255.0::DOUBLE) AS a{k}, (b{k} / 255.0::DOUBLE) * (b3 / 255.0::DOUBLE) AS b{k}" for k in range(3)) + " FROM ev4 e JOIN ov o ON o.x = e.x AND o.y = e.y"
    extra = {"pm": base}
    src = "pm"
    if mode in pd:
        fa, fb, alpha = pd[mode]
        colours = [f"{fa} * a{k} + {fb} * b{k}" for k in range(3)]
    else:
        alpha = "aa + ab * (1 - aa)"
        if mode in sep:
            fs = [sep[mode].format(a=f"a{k}", b=f"b{k}") for k in range(3)]
        else:
            bare = ", ".join(f"CASE WHEN aa = 0 THEN 0.0 ELSE a{k} / aa END AS s{k}, CASE WHEN ab = 0 THEN 0.0 ELSE b{k} / ab END AS t{k}" for k in range(3))
            lum = lambda c: f"(0.3 * {c}0 + 0.59 * {c}1 + 0.11 * {c}2)"
            lo, hi = (lambda c: f"least({c}0, {c}1, {c}2)"), (lambda c: f"greatest({c}0, {c}1, {c}2)")
            c, d = {"hue": ("s", "t"), "saturation": ("t", "s"), "colour": ("s", None), "luminosity": ("t", None)}[mode]
            to = "s" if mode == "luminosity" else "t"
            sat = ", ".join((f"CASE WHEN {hi(c)} > {lo(c)} THEN ({c}{k} - {lo(c)}) * ({hi(d)} - {lo(d)}) / ({hi(c)} - {lo(c)}) ELSE 0.0 END AS u{k}" if d else f"{c}{k} AS u{k}") for k in range(3))
            extra |= {"q1": f"SELECT *, {bare} FROM pm", "q2": f"SELECT *, {sat} FROM q1", "q3": f"SELECT *, " + ", ".join(f"u{k} + ({lum(to)} - {lum('u')}) AS v{k}" for k in range(3)) + " FROM q2",
                      "q4": f"SELECT *, {lum('v')} AS l, {lo('v')} AS n, {hi('v')} AS m FROM q3", "q5": "SELECT *, " + ", ".join(f"CASE WHEN n < 0 THEN l + (v{k} - l) * l / (l - n) ELSE v{k} END AS w{k}" for k in range(3)) + " FROM q4"}
            src = "q5"
            fs = [f"CASE WHEN m > 1 THEN l + (w{k} - l) * (1 - l) / (m - l) ELSE w{k} END" for k in range(3)]
        colours = [f"(1 - ab) * a{k} + (1 - aa) * b{k} + aa * ab * ({f})" for k, f in enumerate(fs)]
    out = lambda v: f"CAST(least(255, greatest(0, floor(({v}) * 255.0 + 0.5))) AS BIGINT)"
    cols = ", ".join(f"{out(f'CASE WHEN ra = 0 THEN 0.0 ELSE c{k} / ra END')} AS b{k}" for k in range(3))
    extra["res"] = f"SELECT x, y, CAST({alpha} AS DOUBLE) AS ra, " + ", ".join(f"CAST({c} AS DOUBLE) AS c{k}" for k, c in enumerate(colours)) + f" FROM {src}"
    return with_ctes(["ev4", "ov"], f"SELECT x, y, {cols}, {out('ra')} AS b3 FROM res", extra)


def _histograms():
    cut = lambda c, d=4: fixed(F.col(c), d).alias(c)
    hist = lambda t: H.wide(A.hist_find(t.ev, 0), 1)
    h = "SELECT CAST(k AS INT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(256) s(k) LEFT JOIN (SELECT v, count(*) AS n FROM ev GROUP BY 1) ON v = k"
    cum = "SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS c FROM h"
    norm = "SELECT bin, CAST(floor(CAST(CAST(CAST(c AS DOUBLE) * (255 / CAST(max(c) OVER () AS DOUBLE)) AS REAL) AS DOUBLE)) AS BIGINT) AS e FROM cu"
    more = {"h": h, "cu": cum, "nm": norm}
    _add("hist_cum", lambda t: H.hist_cum(hist(t)).select("bin", F.col("b0").cast("long").alias("b0")), with_ctes(["ev"], "SELECT bin, c AS b0 FROM cu", more))
    _add("hist_norm", lambda t: H.hist_norm(H.hist_cum(hist(t))), with_ctes(["ev"], "SELECT bin, e AS b0 FROM nm", more))
    _add("hist_equal", lambda t: shown(H.hist_equal(t.ev)), with_ctes(["ev"], "SELECT x, y, e AS b0 FROM ev JOIN nm ON nm.bin = ev.v", more))
    _add("hist_entropy", lambda t: H.hist_entropy(hist(t)).select(cut("entropy")), with_ctes(["ev"], f"SELECT {sql_fixed('-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END)', 4, False)} AS entropy FROM (SELECT n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM h)", more))
    _add("hist_ismonotonic", lambda t: H.hist_ismonotonic(H.hist_cum(hist(t))), with_ctes(["ev"], "SELECT bool_and(d >= 0) AS monotonic FROM (SELECT c - lag(c) OVER (ORDER BY bin) AS d FROM cu)", more))
    rh = "SELECT CAST(k AS INT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM range(256) s(k) LEFT JOIN (SELECT b2 AS v, count(*) AS n FROM ev4 GROUP BY 1) ON v = k"
    _add("hist_match", lambda t: H.hist_match(H.hist_cum(hist(t)), H.hist_cum(H.wide(A.hist_find(V.extract_band(t.ev3, 2), 0), 1))), with_ctes(["ev", "ev4"], "SELECT cu.bin, CAST(coalesce((SELECT min(r.bin) FROM rc r WHERE r.c >= cu.c), 255) AS BIGINT) AS b0 FROM cu", {**more, "rh": rh, "rc": "SELECT bin, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS c FROM rh"}))
    _add("hist_plot", lambda t: H.hist_plot(hist(t)).select("x", "y", F.col("v").cast("long").alias("v")), with_ctes(["ev"], "SELECT bin AS x, CAST(k AS INT) AS y, CAST(CASE WHEN n > k THEN 255 ELSE 0 END AS BIGINT) AS v FROM h, (SELECT unnest(range(max(n))) AS k FROM h)", more))
    _add("maplut", lambda t: shown(H.maplut(t.ev, G.identity(t.spark).select("bin", (F.col("b0") * F.col("b0")).alias("b0")))), with_ctes(["ev"], f"SELECT x, y, {sql_fixed('v * v', 4, False)} AS b0 FROM ev"))
    for p in (10, 50, 90):
        _add(f"percent_{p}", lambda t, p=p: H.percent(t.ev, p), with_ctes(["ev"], f"SELECT min(bin) AS threshold FROM nm WHERE e > 256 * ({p} / 100.0)", more))
    _add("percent_lum", lambda t: H.percent_lum(t.ev, 60).select(cut("threshold")), with_ctes(["ev"], f"SELECT {sql_fixed('(min(b) + 1) * 125.0 / 10000', 4, False)} AS threshold FROM (SELECT b, sum(n) OVER (ORDER BY b) AS c, sum(n) OVER () AS t FROM (SELECT greatest(0, least(9999, floor(v * 10000 / 125.0))) AS b, count(*) AS n FROM ev GROUP BY 1)) WHERE c >= t * 0.6"))


def _generators():
    w, h = 64, 48
    base = f"(SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y FROM range({w}) a(i), range({h}) b(j))"

    def made(name, fn, exprs, integer=False, digits=4, height=h):
        src = base.replace(f"range({h})", f"range({height})")
        cols = ", ".join(f"{_i(e) if integer else sql_fixed(e, digits)} AS b{k}" for k, e in enumerate(exprs))
        _add(name, lambda t: shown(fn(t.spark), digits), f"SELECT x, y, {cols} FROM {src}")

    made("black", lambda s: G.black(s, w, h, 2), ["0", "0"], True)
    made("xyz", lambda s: G.xyz(s, w, h, 3), ["x", f"y % {h}", f"y // {h}"], True, height=3 * h)
    made("grey", lambda s: G.grey(s, w, h), [f"x / {w - 1}.0::DOUBLE"])
    made("grey_uchar", lambda s: G.grey(s, w, h, True), [f"floor((x / {w - 1}.0::DOUBLE) * 255.0 / 1.0)"], True)
    made("zone", lambda s: G.zone(s, w, h), [f"cos({math.pi / w!r}::DOUBLE * ((x - {w // 2}) * (x - {w // 2}) + (y - {h // 2}) * (y - {h // 2})))"])
    th, c = math.atan(1.0), math.sqrt(0.5) * math.pi * 2 / w
    made("sines", lambda s: G.sines(s, w, h), [f"cos({c!r} * (x * {math.cos(th)!r} - y * {math.sin(th)!r}))"])
    made("eye", lambda s: G.eye(s, w, h), [f"y * y * cos({0.5 * math.pi / (2 * (w - 1))!r} * x * x) / {float(h - 1) ** 2!r}"])
    _add("identity", lambda t: G.identity(t.spark, 2), "SELECT CAST(i AS INT) AS bin, i AS b0, i AS b1 FROM range(256) a(i)")
    _add("identity_ushort", lambda t: G.identity(t.spark, 1, True, 1000), "SELECT CAST(i AS INT) AS bin, i AS b0 FROM range(1000) a(i)")
    _add("gaussnoise", lambda t: G.gaussnoise(t.spark, w, h).df.select("x", "y"), f"SELECT x, y FROM {base}")
    sx, sy = f"(CASE WHEN x >= {w // 2} THEN x - {w} ELSE x END)", f"(CASE WHEN y >= {h // 2} THEN y - {h} ELSE y END)"
    u, v = f"({sx} / {w // 2}.0::DOUBLE)", f"({sy} / {h // 2}.0::DOUBLE)"
    d2 = f"({u} * {u} + {v} * {v})"
    far = lambda a, b: f"(({u} - {a}) * ({u} - {a}) + ({v} - {b}) * ({v} - {b}))"
    dc = lambda e: f"CASE WHEN x = 0 AND y = 0 THEN 1.0 ELSE {e} END"
    flag = lambda e: f"CASE WHEN {e} THEN 1.0 ELSE 0.0 END"
    made("mask_ideal", lambda s: G.mask_ideal(s, w, h, 0.5), [dc(flag(f"{d2} > 0.25"))])
    made("mask_ideal_reject_nodc", lambda s: G.mask_ideal(s, w, h, 0.5, reject=True, nodc=True), [f"1.0 - {flag(f'{d2} > 0.25')}"])
    ox, oy = f"((x + {w // 2}) % {w})", f"((y + {h // 2}) % {h})"
    opt = lambda e: e.replace("x", "XX").replace("y", "YY").replace("XX", ox).replace("YY", oy)
    made("mask_ideal_optical", lambda s: G.mask_ideal(s, w, h, 0.5, optical=True), [f"CASE WHEN x = {w // 2} AND y = {h // 2} THEN 1.0 WHEN {opt(d2)} > 0.25 THEN 1.0 ELSE 0.0 END"])
    made("mask_ideal_ring", lambda s: G.mask_ideal_ring(s, w, h, 0.5, 0.2), [dc(flag(f"{d2} > {0.4 * 0.4!r} AND {d2} < {0.6 * 0.6!r}"))])
    made("mask_ideal_band", lambda s: G.mask_ideal_band(s, w, h, 0.5, 0.25, 0.2), [dc(flag(f"{far(0.5, 0.25)} < {0.2 * 0.2!r} OR {far(-0.5, -0.25)} < {0.2 * 0.2!r}"))])
    made("mask_butterworth", lambda s: G.mask_butterworth(s, w, h, 2, 0.5, 0.1), [dc(f"1 / (1 + {1 / 0.1 - 1!r} * pow(0.25 / {d2}, 2.0))")])
    made("mask_butterworth_ring", lambda s: G.mask_butterworth_ring(s, w, h, 2, 0.5, 0.1, 0.4), [dc(f"1 / (1 + {1 / 0.1 - 1!r} * pow((sqrt({d2}) - 0.5) * (sqrt({d2}) - 0.5) / {(0.4 / 2) ** 2!r}, 2.0))")])
    lobe = lambda d: f"1 / (1 + {1 / 0.1 - 1!r} * pow({d} / {0.2 * 0.2!r}, 2.0))"
    made("mask_butterworth_band", lambda s: G.mask_butterworth_band(s, w, h, 2, 0.5, 0.25, 0.2, 0.1), [dc(f"({lobe(far(0.5, 0.25))} + {lobe(far(-0.5, -0.25))}) / {1 + 1 / (1 + (1 / 0.1 - 1) * (4 * (0.5 * 0.5 + 0.25 * 0.25) / (0.2 * 0.2)) ** 2)!r}")])
    made("mask_gaussian", lambda s: G.mask_gaussian(s, w, h, 0.5, 0.1), [dc(f"1 - exp({math.log(0.1) / 0.25!r} * {d2})")])
    kr = math.log(0.1) / (0.4 / 2) ** 2
    made("mask_gaussian_ring", lambda s: G.mask_gaussian_ring(s, w, h, 0.5, 0.1, 0.4), [dc(f"exp({kr!r} * (sqrt({d2}) - 0.5) * (sqrt({d2}) - 0.5))")])
    kb = math.log(0.1) / (0.2 * 0.2)
    made("mask_gaussian_band", lambda s: G.mask_gaussian_band(s, w, h, 0.5, 0.25, 0.2, 0.1), [dc(f"(exp({kb!r} * {far(0.5, 0.25)}) + exp({kb!r} * {far(-0.5, -0.25)})) / {1 + math.exp(kb * 4 * (0.5 * 0.5 + 0.25 * 0.25))!r}")])
    made("mask_fractal", lambda s: G.mask_fractal(s, w, h, 2.3), [dc(f"pow({sx} * {sx} + {sy} * {sy}, {(2.3 - 4) / 2!r})")])
    made("sdf_circle", lambda s: G.sdf(s, w, h, "circle", (20, 10), r=12.0), ["sqrt((x - 20.0) * (x - 20.0) + (y - 10.0) * (y - 10.0)) - 12.0"])
    q = lambda r: (f"abs(x - 30.0) - 20.0 + {r}", f"abs(y - 25.0) - 15.0 + {r}")
    box = lambda r: "sqrt(pow(greatest({0}, 0.0), 2) + pow(greatest({1}, 0.0), 2)) + least(greatest({0}, {1}), 0.0) - {2}".format(*q(r), r)
    made("sdf_box", lambda s: G.sdf(s, w, h, "box", (10, 10), (50, 40)), [box("0.0")])
    made("sdf_rounded_box", lambda s: G.sdf(s, w, h, "rounded_box", (10, 10), (50, 40), corners=(2, 4, 6, 8)), [box("(CASE WHEN x > 30 AND y > 25 THEN 2.0 WHEN x > 30 THEN 4.0 WHEN y > 25 THEN 6.0 ELSE 8.0 END)")])
    t = "greatest(0.0, least(1.0, ((x - 5.0) * 40 + (y - 8.0) * 30) / 2500.0))"
    made("sdf_line", lambda s: G.sdf(s, w, h, "line", (5, 8), (45, 38)), [f"sqrt(pow(x - 5.0 - {t} * 40, 2) + pow(y - 8.0 - {t} * 30, 2))"])
    for name, fn in (("worley", G.worley), ("perlin", G.perlin)):
        _add(name, lambda t, fn=fn: shown(fn(t.spark, w, h, 16)))
    _add("text", lambda t: shown(G.text(t.spark, "HELLO 42")))
    _add("fractsurf", lambda t: Q.fractsurf(t.spark, 32, 32, 2.5).df.select("x", "y"), "SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y FROM range(32) a(i), range(32) b(j)")
    for name, made_ in (("gaussmat", G.gaussmat(1.5, 0.1)[0]), ("logmat", G.logmat(1.5, 0.1)[0])):
        n = len(made_) // 2
        e = "exp(-(d / 4.5))" if name == "gaussmat" else "0.5 * (2 - d / 2.25) * exp(-d / 4.5)"
        _add(name, lambda t, m=made_: G.matrix(t.spark, m).select("x", "y", fixed(F.col("v")).alias("v")), f"SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, {sql_fixed(f'round_even(20 * {e}, 0)', 4, False)} AS v FROM (SELECT i, j, CAST((i - {n}) * (i - {n}) + (j - {n}) * (j - {n}) AS DOUBLE) AS d FROM range({2 * n + 1}) a(i), range({2 * n + 1}) b(j))")
    pts = "(SELECT CAST(n_nationkey AS DOUBLE) * 10 AS p, CAST((n_nationkey * 37) % 101 AS DOUBLE) AS q FROM nation)"
    _add("buildlut", lambda t: G.buildlut(t.table("nation").select((F.col("n_nationkey") * 10).cast("double").alias("p"), ((F.col("n_nationkey") * 37) % 101).cast("double").alias("q"))).select("bin", fixed(F.col("b0")).alias("b0")),
         f"SELECT CAST(k AS INT) AS bin, {sql_fixed('CASE WHEN p1 IS NULL THEN q ELSE q + (k - p) * (q1 - q) / (p1 - p) END', 4, False)} AS b0 FROM (SELECT p, q, lead(p) OVER (ORDER BY p) AS p1, lead(q) OVER (ORDER BY p) AS q1 FROM {pts}) s JOIN range(241) r(k) ON k >= p AND (k < p1 OR (p1 IS NULL AND k = p))")
    _add("invertlut", lambda t: G.invertlut(t.spark, [(0.1, 0.2), (0.5, 0.4), (0.9, 0.8)]).select("bin", fixed(F.col("b0")).alias("b0")),
         f"SELECT CAST(i AS INT) AS bin, {sql_fixed('CASE WHEN k <= 0.2 THEN k * (0.1 / 0.2) WHEN k <= 0.4 THEN 0.1 + (k - 0.2) * ((0.5 - 0.1) / (0.4 - 0.2)) WHEN k <= 0.8 THEN 0.5 + (k - 0.4) * ((0.9 - 0.5) / (0.8 - 0.4)) ELSE 0.9 + (k - 0.8) * ((1.0 - 0.9) / (1.0 - 0.8)) END', 3, False)} AS b0 FROM (SELECT i, i / 255.0::DOUBLE AS k FROM range(256) a(i))")
    _Q["invertlut"] = (lambda spark, folder: G.invertlut(spark, [(0.1, 0.2), (0.5, 0.4), (0.9, 0.8)]).select("bin", fixed(F.col("b0"), 3).alias("b0")))
    cubic = lambda v: f"(3 * {v} * {v} - 2 * {v} * {v} * {v})"
    bump = lambda a, b, c_: f"(CASE WHEN x < {a} THEN 0.0 WHEN x < {b} THEN {cubic(f'((x - {a}) / {b - a})')} WHEN x < {c_} THEN 1.0 - {cubic(f'((x - {b}) / {c_ - b})')} ELSE 0.0 END)"
    _add("tonelut", lambda t: G.tonelut(t.spark, 1000, 1000, S=10.0, M=-5.0, H=8.0), f"SELECT CAST(i AS INT) AS bin, CAST(floor(greatest(0.0, least(1000.0, 10.0 * (x + 10.0 * {bump(0.0, 20.0, 50.0)} + -5.0 * {bump(20.0, 50.0, 80.0)} + 8.0 * {bump(50.0, 80.0, 100.0)})))) AS BIGINT) AS b0 FROM (SELECT i, 100.0::DOUBLE * i / 1000 AS x FROM range(1001) a(i))")


def _stage(exprs: list[str], source: str, names="pqrs", integer=False) -> str:
    """A step in SQL: values pass through single precision as storage does."""
    cast = (lambda e: f"CAST({e} AS BIGINT)") if integer else (lambda e: f"CAST(CAST({e} AS REAL) AS DOUBLE)")
    return f"SELECT x, y, {', '.join(f'{cast(e)} AS {n}' for e, n in zip(exprs, names))} FROM {source}"


def _mat(m, scale: str) -> list[str]:
    return [f"(p * {a!r} + q * {b!r} + r * {c!r}) * {scale}" for a, b, c in m]


_DECODE = [f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END" for c in ("b0", "b1", "b2")]
_HUE = "CASE WHEN degrees(atan2(r, q)) < 0 THEN degrees(atan2(r, q)) + 360 ELSE degrees(atan2(r, q)) END"


def _encode(c: str) -> str:
    f = f"greatest(0.0, least(1.0, {c}))"
    return f"floor((CASE WHEN {f} <= 0.0031308 THEN {f} * 12.92 ELSE 1.055 * pow({f}, {1 / 2.4!r}) - 0.055 END) * 255.0 + 0.5)"


def _colours():
    C = K.C
    fxyz = lambda v, w: f"(CASE WHEN {v} / {w!r} < 0.008856 THEN 7.787 * ({v} / {w!r}) + 16.0 / 116.0 ELSE cbrt({v} / {w!r}) END)"
    x_, y_, z_ = (fxyz(v, w) for v, w in zip("pqr", C.D65))
    fy = f"(CASE WHEN p < 8.0 THEN 7.787 * ((p * 100.0 / 903.3) / 100.0) + 16.0 / 116.0 ELSE (p + 16.0) / 116.0 END)"
    back = lambda t, w: f"CASE WHEN {t} < 0.2069 THEN {w!r} * ({t} - 0.13793) / 7.787 ELSE {w!r} * {t} * {t} * {t} END"
    seg = lambda j: f"(CASE WHEN r < 49.1 THEN {C.CMC_HUES[0][j]} WHEN r < 110.1 THEN {C.CMC_HUES[1][j]} WHEN r < 269.6 THEN {C.CMC_HUES[2][j]} ELSE {C.CMC_HUES[3][j]} END)"
    pc = f"cos(radians({seg(4)} * r + {seg(5)}))"
    step = {
        "scRGB2XYZ": _mat(C.SCRGB_XYZ, "100.0"), "XYZ2scRGB": _mat(C.XYZ_SCRGB, "0.01"),
        "XYZ2Lab": [f"116.0 * {y_} - 16.0", f"500.0 * ({x_} - {y_})", f"200.0 * ({y_} - {z_})"],
        "Lab2XYZ": [back(f"(q / 500.0 + {fy})", C.D65[0]), "CASE WHEN p < 8.0 THEN p * 100.0 / 903.3 ELSE 100.0 * pow((p + 16.0) / 116.0, 3.0) END", back(f"({fy} - r / 200.0)", C.D65[2])],
        "Lab2LCh": ["p", "sqrt(q * q + r * r)", _HUE], "LCh2Lab": ["p", "q * cos(radians(r))", "q * sin(radians(r))"],
        "LCh2CMC": ["CASE WHEN p < 16.0 THEN 1.744 * p ELSE 21.75 * ln(greatest(p, 1.0)) + 0.3838 * p - 38.54 END", "greatest(0.0, 0.162 * q + 10.92 * ln(0.638 + 0.07216 * q) + 4.907)",
                    f"r + ({seg(1)} + {seg(2)} * {pc} * pow(abs({pc}), {seg(3)})) * sqrt(q * q * q * q / (q * q * q * q + 1900.0))"],
        "XYZ2Yxy": ["q", "CASE WHEN p + q + r <> 0 THEN p / (p + q + r) ELSE 0.0 END", "CASE WHEN p + q + r <> 0 THEN q / (p + q + r) ELSE 0.0 END"],
        "Yxy2XYZ": ["CASE WHEN q <> 0 AND r <> 0 THEN p * q / r ELSE 0.0 END", "p", "CASE WHEN q <> 0 AND r <> 0 THEN (p * q / r) * (1 - q - r) / q ELSE 0.0 END"],
    }
    lms = ["(p / 100.0 * {!r} + q / 100.0 * {!r} + r / 100.0 * {!r})".format(*row) for row in C.XYZ_LMS]
    step["XYZ2Oklab"] = [" + ".join(f"cbrt({l} * 1.0) * {m!r}" for l, m in zip(lms, row)) for row in C.LMS_OKLAB]
    inv = ["(p * {!r} + q * {!r} + r * {!r})".format(*row) for row in C.OKLAB_LMS]
    step["Oklab2XYZ"] = ["(" + " + ".join(f"{l} * {l} * {l} * {m!r}" for l, m in zip(inv, row)) + ") * 100.0" for row in C.LMS_XYZ]
    step["Oklab2Oklch"], step["Oklch2Oklab"] = step["Lab2LCh"], step["LCh2Lab"]
    step["CMYK2XYZ"] = [f"{w!r} * (1 - {c} / 255.0) * (1 - s / 255.0)" for c, w in zip("pqr", C.D65)]

    def chain(name, fn, names, last=None, digits=3, integer=False):
        """sRGB pixels through named steps; ``last`` gives the final expressions where they are not a named step's."""
        ctes, src = {"s0": _stage(_DECODE, "ev4")}, "s0"
        for k, n in enumerate(names):
            ctes[f"s{k + 1}"] = _stage(step[n], src)
            src = f"s{k + 1}"
        exprs = last or ["p", "q", "r"]
        cols = ", ".join(f"{_i(e) if integer else sql_fixed(e, digits)} AS b{k}" for k, e in enumerate(exprs))
        _add(name, lambda t: shown(fn(t), digits), with_ctes(["ev4"], f"SELECT x, y, {cols} FROM {src}", ctes))

    to = lambda space: (lambda t: K.colourspace(t.ev3, space))
    chain("sRGB2scRGB", to("scrgb"), [], digits=5)
    chain("scRGB2XYZ", to("xyz"), ["scRGB2XYZ"])
    chain("XYZ2Lab", to("lab"), ["scRGB2XYZ", "XYZ2Lab"], digits=2)
    chain("Lab2LCh", to("lch"), ["scRGB2XYZ", "XYZ2Lab", "Lab2LCh"], digits=2)
    chain("LCh2CMC", to("cmc"), ["scRGB2XYZ", "XYZ2Lab", "Lab2LCh", "LCh2CMC"], digits=1)
    chain("XYZ2Yxy", to("yxy"), ["scRGB2XYZ", "XYZ2Yxy"])
    chain("Yxy2XYZ", lambda t: K.step(K.colourspace(t.ev3, "yxy"), "Yxy2XYZ"), ["scRGB2XYZ", "XYZ2Yxy", "Yxy2XYZ"], digits=2)
    chain("Lab2XYZ", lambda t: K.step(K.colourspace(t.ev3, "lab"), "Lab2XYZ"), ["scRGB2XYZ", "XYZ2Lab", "Lab2XYZ"], digits=2)
    chain("LCh2Lab", lambda t: K.step(K.colourspace(t.ev3, "lch"), "LCh2Lab"), ["scRGB2XYZ", "XYZ2Lab", "Lab2LCh", "LCh2Lab"], digits=2)
    chain("XYZ2Oklab", to("oklab"), ["scRGB2XYZ", "XYZ2Oklab"])
    chain("Oklab2Oklch", to("oklch"), ["scRGB2XYZ", "XYZ2Oklab", "Oklab2Oklch"], digits=2)
    chain("Oklch2Oklab", lambda t: K.step(K.colourspace(t.ev3, "oklch"), "Oklch2Oklab"), ["scRGB2XYZ", "XYZ2Oklab", "Oklab2Oklch", "Oklch2Oklab"])
    chain("Oklab2XYZ", lambda t: K.step(K.colourspace(t.ev3, "oklab"), "Oklab2XYZ"), ["scRGB2XYZ", "XYZ2Oklab", "Oklab2XYZ"], digits=2)
    chain("XYZ2scRGB", lambda t: K.step(K.colourspace(t.ev3, "xyz"), "XYZ2scRGB"), ["scRGB2XYZ", "XYZ2scRGB"], digits=3)
    chain("scRGB2sRGB", lambda t: K.colourspace(K.colourspace(t.ev3, "xyz"), "srgb"), ["scRGB2XYZ", "XYZ2scRGB"], [_encode(c) for c in "pqr"], integer=True)
    chain("scRGB2BW", to("b_w"), [], [_encode("(0.2126 * p + 0.7152 * q + 0.0722 * r)")], integer=True)
    k = [f"greatest(0.0, least(1.0, 1 - {v} / {w!r}))" for v, w in zip("pqr", C.D65)]
    black = f"least({k[0]}, {k[1]}, {k[2]})"
    cmyk = [f"floor(255.0 * (CASE WHEN {black} < 1 THEN ({v} - {black}) / (1 - {black}) ELSE 0.0 END) + 0.5)" for v in k] + [f"floor(255.0 * {black} + 0.5)"]
    chain("XYZ2CMYK", to("cmyk"), ["scRGB2XYZ"], cmyk, integer=True)
    _bands("CMYK2XYZ", lambda t: K.step(t.ev4, "CMYK2XYZ"), [e.replace("(1 - p", "(1 - b0").replace("(1 - q", "(1 - b1").replace("(1 - r", "(1 - b2").replace("(1 - s", "(1 - b3") for e in step["CMYK2XYZ"]], integer=False)
    top, low = "greatest(b0, b1, b2)", "least(b0, b1, b2)"
    sector = lambda d, base: f"floor(42.5 * (({d}) / CAST({top} - {low} AS DOUBLE)) + {base})"
    hue = f"CASE WHEN {top} = {low} THEN 0 WHEN b1 < b2 THEN CASE WHEN b2 < b0 THEN {sector('b1 - b2', 255.0)} ELSE {sector('b0 - b1', 170.0)} END ELSE CASE WHEN b1 < b0 THEN {sector('b1 - b2', 0.0)} ELSE {sector('b2 - b0', 85.0)} END END"
    _bands("sRGB2HSV", to("hsv"), [hue, f"CASE WHEN {top} = 0 THEN 0 ELSE floor(({top} - {low}) * 255.0 / CAST({top} AS DOUBLE)) END", top])
    c_ = "(b2 * b1 / 255.0::DOUBLE)"
    x2 = f"({c_} * (1 - abs(b0 / 42.5::DOUBLE - 2 * floor(b0 / 42.5::DOUBLE / 2) - 1)))"
    six = lambda *v: "floor(CASE WHEN b0 < 42 THEN {0} WHEN b0 < 85 THEN {1} WHEN b0 < 127 THEN {2} WHEN b0 < 170 THEN {3} WHEN b0 < 212 THEN {4} ELSE {5} END + (b2 - {6}))".format(*v, c_)
    _bands("HSV2sRGB", lambda t: K.step(t.ev3, "HSV2sRGB"), [six(c_, x2, "0", "0", x2, c_), six(x2, c_, c_, x2, "0", "0"), six("0", "0", x2, c_, c_, x2)])
    _bands("Lab2LabS", lambda t: K.step(t.lab, "Lab2LabS"), ["trunc(greatest(0.0, least(32767.0, l * (32767.0 / 100.0))))", *[f"trunc(greatest(-32768.0, least(32767.0, {v} * 256.0)))" for v in "ab"]], "lab")
    _bands("LabS2Lab", lambda t: K.step(K.step(t.lab, "Lab2LabS"), "LabS2Lab"), ["trunc(greatest(0.0, least(32767.0, l * (32767.0 / 100.0)))) / (32767.0 / 100.0)", *[f"trunc(greatest(-32768.0, least(32767.0, {v} * 256.0))) / 256.0" for v in "ab"]], "lab", False)
    ql = "CAST(greatest(0, least(1023, floor(10.23 * l + 0.5))) AS BIGINT)"
    qa, qb = (f"CAST(greatest(-1024, least(1023, round_even(8.0 * {v}, 0))) AS BIGINT)" for v in "ab")
    _bands("Lab2LabQ", lambda t: K.step(t.lab, "Lab2LabQ"), [f"{ql} >> 2", f"({qa} >> 3) & 255", f"({qb} >> 3) & 255", f"(({ql} & 3) << 6) | (({qa} & 7) << 3) | ({qb} & 7)"], "lab")
    _bands("LabQ2Lab", lambda t: K.step(K.step(t.lab, "Lab2LabQ"), "LabQ2Lab"), [f"{ql} * (100.0::DOUBLE / 1023.0)", f"{qa} * 0.125", f"{qb} * 0.125"], "lab", False, digits=3)
    _add("LabQ2sRGB", lambda t: shown(K.colourspace(K.step(t.lab, "Lab2LabQ"), "srgb")))
    _add("LabQ2LabS", lambda t: shown(K.colourspace(K.step(t.lab, "Lab2LabQ"), "labs")), with_ctes(["lab"], f"SELECT x, y, CAST(trunc(greatest(0.0, least(32767.0, CAST(CAST({ql} * (100.0::DOUBLE / 1023.0) AS REAL) AS DOUBLE) * (32767.0::DOUBLE / 100.0)))) AS BIGINT) AS b0, CAST(greatest(-32768.0, least(32767.0, {qa} * 32.0)) AS BIGINT) AS b1, CAST(greatest(-32768.0, least(32767.0, {qb} * 32.0)) AS BIGINT) AS b2 FROM lab"))
    _add("LabS2LabQ", lambda t: shown(K.colourspace(K.step(t.lab, "Lab2LabS"), "labq")))
    e_ = "b3"
    _bands("rad2float", lambda t: K.step(t.ev4, "rad2float"), [f"CASE WHEN {e_} = 0 THEN 0.0 ELSE (b{j} + 0.5) * pow(2.0, {e_} - 136) END / 1e30" for j in range(3)], integer=False)
    _Q["rad2float"] = lambda spark, folder: shown(K.step(Tables(spark, folder).ev4, "rad2float").point(lambda c: c.cast("double") / 1e30, "double"))
    _SQL["rad2float"] = with_ctes(["ev4"], "SELECT x, y, " + ", ".join(f"floor(CAST(CAST(CASE WHEN b3 = 0 THEN 0.0 ELSE (b{j} + 0.5) * pow(2.0, b3 - 136) END AS REAL) AS DOUBLE) / 1e30 * 10000.0 + 0.5) / 10000.0 AS b{j}" for j in range(3)) + " FROM ev4")
    g = "greatest(b0, b1, b2)"
    ex = f"(floor(log2({g})) + 1)"
    _bands("float2rad", lambda t: K.step(t.ev3.cast("float"), "float2rad"), [*[f"CASE WHEN {g} > 0 THEN floor(b{j} * (256.0 / pow(2.0, {ex}))) ELSE 0 END" for j in range(3)], f"CASE WHEN {g} > 0 THEN {ex} + 128 ELSE 0 END"])
    two = "(SELECT m.x, m.y, m.l AS l1, m.a AS a1, m.b AS b1, n.l AS l2, n.a AS a2, n.b AS b2 FROM lab m JOIN lab2 n ON m.x = n.x AND m.y = n.y)"
    _add("dE76", lambda t: shown(K.dE76(t.lab, t.lab2), 3), with_ctes(["lab", "lab2"], f"SELECT x, y, {sql_fixed('sqrt((l1 - l2) * (l1 - l2) + (a1 - a2) * (a1 - a2) + (b1 - b2) * (b1 - b2))', 3)} AS b0 FROM {two}"))
    h = lambda a, b: f"CASE WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
    s1 = f"SELECT *, 0.5 * (1 - sqrt(pow(cb, 7) / (pow(cb, 7) + pow(25.0, 7)))) AS g FROM (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cb FROM {two})"
    s2 = f"SELECT *, sqrt(ad1 * ad1 + b1 * b1) AS c1, sqrt(ad2 * ad2 + b2 * b2) AS c2, {h('ad1', 'b1')} AS h1, {h('ad2', 'b2')} AS h2 FROM (SELECT *, (1 + g) * a1 AS ad1, (1 + g) * a2 AS ad2 FROM s1)"
    s3 = "SELECT *, (l1 + l2) / 2 AS lb, (c1 + c2) / 2 AS cd, CASE WHEN abs(h1 - h2) < 180 THEN (h1 + h2) / 2 ELSE abs(h1 + h2 - 360) / 2 END AS hd, CASE WHEN abs(h1 - h2) < 180 THEN h1 - h2 ELSE 360 - (h1 - h2) END AS dh FROM s2"
    s4 = "SELECT *, -sin(radians(2 * 30 * exp(-pow((hd - 275) / 25, 2)))) * 2 * sqrt(pow(cd, 7) / (pow(cd, 7) + pow(25.0, 7))) AS rt, 1 - 0.17 * cos(radians(hd - 30)) + 0.24 * cos(radians(2 * hd)) + 0.32 * cos(radians(3 * hd + 6)) - 0.20 * cos(radians(4 * hd - 63)) AS t FROM s3"
    s5 = "SELECT *, (l1 - l2) / (1 + 0.015 * pow(lb - 50, 2) / sqrt(20 + pow(lb - 50, 2))) AS nl, (c1 - c2) / (1 + 0.045 * cd) AS nc, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cd * t) AS nh FROM s4"
    _add("dE00", lambda t: shown(K.dE00(t.lab, t.lab2), 2), with_ctes(["lab", "lab2"], f"SELECT x, y, {sql_fixed('sqrt(greatest(0.0, nl * nl + nc * nc + nh * nh + rt * nc * nh))', 2)} AS b0 FROM s5", {"s1": s1, "s2": s2, "s3": s3, "s4": s4, "s5": s5}))
    _add("dECMC", lambda t: shown(K.dECMC(t.lab, t.lab2), 2))
    _add("CMC2LCh", lambda t: shown(K.cmc2lch(K.colourspace(t.ev3, "cmc")), 1))
    for tr in ("srgb", "bt709", "pq", "hlg", "linear"):
        _add(f"CICP2scRGB_{tr}", lambda t, tr=tr: shown(K.cicp2scrgb(t.ev3, "bt2020", tr), 3))
    _bands("scRGB2CICP", lambda t: K.scrgb2cicp(K.colourspace(t.ev3, "scrgb")), ["b0", "b1", "b2"])
    _add("uhdr2scRGB", lambda t: shown(K.uhdr2scrgb(t.ev3, R.shrink(t.ev, 2, 2)), 3))


def _drawing():
    _geometry_rect = "x >= 10 AND x < 40 AND y >= 20 AND y < 35"
    _point("draw_rect_fill", lambda t: D.draw_rect(t.ev, 77, 10, 20, 30, 15, True), f"CASE WHEN {_geometry_rect} THEN 77 ELSE v END")
    _point("draw_rect", lambda t: D.draw_rect(t.ev, 77, 10, 20, 30, 15), f"CASE WHEN {_geometry_rect} AND (x = 10 OR x = 39 OR y = 20 OR y = 34) THEN 77 ELSE v END")
    _point("draw_point", lambda t: D.draw_point(t.ev, 77, 5, 6), "CASE WHEN x = 5 AND y = 6 THEN 77 ELSE v END")
    _point("draw_line", lambda t: D.draw_line(t.ev, 77, 2, 3, 60, 3 + 29), "CASE WHEN x BETWEEN 2 AND 60 AND y = 3 + (x - 2 + 1) // 2 THEN 77 ELSE v END")
    _point("draw_circle_fill", lambda t: D.draw_circle(t.ev, 77, 50, 40, 12, True), "CASE " + " ".join(f"WHEN y = {40 + dy} AND abs(x - 50) <= {w} THEN 77" for dy, w in sorted(D.circle_spans(12).items())) + " ELSE v END")
    _add("draw_circle", lambda t: shown(D.draw_circle(t.ev, 77, 50, 40, 12)))
    paste = "LEFT JOIN pt ON pt.x = ev.x - 30 AND pt.y = ev.y - 10"
    _add("draw_image_set", lambda t: shown(D.draw_image(t.ev, t.part, 30, 10)), with_ctes(["ev", "pt"], f"SELECT ev.x, ev.y, CAST(coalesce(pt.v, ev.v) AS BIGINT) AS b0 FROM ev {paste}"))
    _add("draw_image_add", lambda t: shown(D.draw_image(t.ev, t.part, 30, 10, "add")), with_ctes(["ev", "pt"], f"SELECT ev.x, ev.y, CAST(least(255, ev.v + coalesce(pt.v, 0)) AS BIGINT) AS b0 FROM ev {paste}"))
    _add("draw_mask", lambda t: shown(D.draw_mask(t.ev, 200, t.part, 30, 10)), with_ctes(["ev", "pt"], f"SELECT ev.x, ev.y, (200 * coalesce(pt.v, 0) + ev.v * (255 - coalesce(pt.v, 0))) // 255 AS b0 FROM ev {paste}"))
    _add("draw_flood", lambda t: shown(D.draw_flood(t.bin, 77, 10, 10)), with_ctes(["bn"], """SELECT bn.x, bn.y, CAST(CASE WHEN reach.x IS NULL THEN bn.v ELSE 77 END AS BIGINT) AS b0 FROM bn LEFT JOIN reach ON bn.x = reach.x AND bn.y = reach.y""",
         {"reach": "SELECT x, y, v FROM bn WHERE x = 10 AND y = 10 UNION SELECT b.x, b.y, b.v FROM reach r, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy), bn b WHERE b.x = r.x + dx AND b.y = r.y + dy AND b.v = r.v"}).replace("WITH ", "WITH RECURSIVE ", 1))
    _nb("draw_smudge", lambda t: D.draw_smudge(t.ev, 0, 0, 100, t.ev.height), BLUR, "floor((16 * any_value(c) + sum(v)) / 25.0)")


def _resampling():
    def shrunk(axis, f, size, ceil=False):
        other = "y" if axis == "x" else "x"
        out = f"({size} + {f - 1}) // {f}" if ceil else f"CAST(floor({size} / {f}.0 + 0.5) AS BIGINT)"
        return f"SELECT CAST(o AS INT) AS {axis}, {other}, CAST(floor((sum(v) + {f // 2}) / {f}.0) AS BIGINT) AS v FROM (SELECT unnest(range({out})) AS o, my FROM dim) CROSS JOIN range({f}) t(i) JOIN ev ON ev.{axis} = least({size} - 1, o * {f} + i) GROUP BY o, {other}"

    for axis, fn, size in (("x", R.shrinkh, "100"), ("y", R.shrinkv, "(my + 1)")):
        for ceil in (False, True):
            name = f"shrink{'h' if axis == 'x' else 'v'}{'_ceil' if ceil else ''}"
            _add(name, lambda t, fn=fn, c=ceil: shown(fn(t.ev, 3, c)), with_ctes(["ev", "dim"], "SELECT x, y, v AS b0 FROM s", {"s": shrunk(axis, 3, size, ceil)}))
    _add("shrink", lambda t: shown(R.shrink(t.ev, 4, 2)), with_ctes(["ev", "dim"], "SELECT x, y, v AS b0 FROM h", {"w": shrunk("y", 2, "(my + 1)"), "h": shrunk("x", 4, "100").replace("JOIN ev ON ev", "JOIN w ON w")}))
    for kernel in R.KERNELS:
        size, rows = R.taps(100, 2.5, kernel)
        values = ", ".join(f"({i}, {o}, {w!r}::DOUBLE)" for i, o, w in rows)
        _add(f"reduceh_{kernel}", lambda t, k=kernel: shown(R.reduceh(t.ev.cast("double"), 2.5, k), 3), with_ctes(["ev"], f"SELECT CAST(o AS INT) AS x, y, {sql_fixed('sum(v * w)', 3, False)} AS b0 FROM ev JOIN (VALUES {values}) m(i, o, w) ON i = x GROUP BY o, y"))
    _add("reducev", lambda t: shown(R.reducev(t.ev, 2.0)))
    _add("reduce", lambda t: shown(R.reduce_(t.ev, 2.0, 2.0, "linear")))
    _add("resize_down", lambda t: shown(R.resize(t.ev, 0.5)))
    _add("resize_up", lambda t: shown(R.resize(t.ev, 2.0, kernel="nearest")), with_ctes(["ev"], "SELECT CAST(2 * x + i AS INT) AS x, CAST(2 * y + j AS INT) AS y, CAST(v AS BIGINT) AS b0 FROM ev, range(2) a(i), range(2) b(j)"))
    _add("thumbnail_image", lambda t: shown(R.thumbnail(t.ev, 40)))
    _add("thumbnail_crop", lambda t: shown(R.thumbnail(t.ev, 40, 20, crop="centre")))

    def sampled(u, v, taps, round_=True, width="100", height="(my + 1)"):
        """taps: (dx, dy, weight in tu, tv) around floor(u), floor(v)."""
        rows = " UNION ALL ".join(f"SELECT x, y, CAST(least(99, greatest(0, fu + {i})) AS INT) AS tx, CAST(least((SELECT my FROM dim), greatest(0, fv + {j})) AS INT) AS ty, {w} AS w FROM f WHERE inside" for i, j, w in taps)
        ctes = {"o": f"SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, CAST({u} AS DOUBLE) AS u, CAST({v} AS DOUBLE) AS v FROM range({width}) a(i), (SELECT unnest(range({height})) AS j FROM dim)",
                "f": "SELECT *, floor(u) AS fu, floor(v) AS fv, u - floor(u) AS tu, v - floor(v) AS tv, u >= 0 AND v >= 0 AND u <= 99 AND v <= (SELECT my FROM dim) AS inside FROM o", "k": rows,
                "g": "SELECT k.x, k.y, sum(ev.v * k.w) AS s FROM k JOIN ev ON ev.x = k.tx AND ev.y = k.ty GROUP BY k.x, k.y"}
        return with_ctes(["ev", "dim"], "SELECT o.x, o.y, CAST(coalesce(least(255, greatest(0, floor(s + 0.5))), 0) AS BIGINT) AS b0 FROM o LEFT JOIN g ON g.x = o.x AND g.y = o.y", ctes)

    bil = [(i, j, f"({'tu' if i else '(1 - tu)'} * {'tv' if j else '(1 - tv)'})") for i in (0, 1) for j in (0, 1)]
    cat = lambda t: [f"((-{t} + 2 * {t} * {t} - {t} * {t} * {t}) / 2)", f"((2 - 5 * {t} * {t} + 3 * {t} * {t} * {t}) / 2)", f"(({t} + 4 * {t} * {t} - 3 * {t} * {t} * {t}) / 2)", f"((-{t} * {t} + {t} * {t} * {t}) / 2)"]
    bic = [(i - 1, j - 1, f"{a} * {b}") for i, a in enumerate(cat("tu")) for j, b in enumerate(cat("tv"))]
    near = [(0, 0, "1.0")]
    area = lambda t: (0, 0, 100, t.ev.height)
    m = (0.8, 0.3, -0.2, 0.9)
    det = m[0] * m[3] - m[1] * m[2]
    ia, ib, ic, id_ = m[3] / det, -m[1] / det, -m[2] / det, m[0] / det
    gu, gv = f"(i + 0 - 5.0::DOUBLE) * {ia!r}::DOUBLE + (j + 0 - 9.0::DOUBLE) * {ib!r}::DOUBLE - 0.0", f"(i + 0 - 5.0::DOUBLE) * {ic!r}::DOUBLE + (j + 0 - 9.0::DOUBLE) * {id_!r}::DOUBLE - 0.0"
    for name, taps in (("bilinear", bil), ("bicubic", bic)):
        _add(f"affine_{name}", lambda t, n=name: shown(R.affine(t.ev, m, n, odx=5.0, ody=9.0, oarea=area(t))), sampled(gu, gv, taps))
    _add("affine_nearest", lambda t: shown(R.affine(t.ev, m, "nearest", odx=5.0, ody=9.0, oarea=area(t))), sampled(gu, gv, near).replace("floor(u) AS fu, floor(v) AS fv", "floor(u + 0.5) AS fu, floor(v + 0.5) AS fv"))
    for name in ("vsqbs", "lbb", "nohalo"):
        _add(f"affine_{name}", lambda t, n=name: shown(R.affine(t.ev, m, n, odx=5.0, ody=9.0, oarea=area(t))))
    _add("similarity", lambda t: shown(R.similarity(t.ev, 0.75, 30.0)))
    _add("rotate", lambda t: shown(R.rotate(t.ev, 15.0)))
    index = lambda t: t.ev.with_bands([F.col("x") * 0.5 + F.col("y") * 0.25, F.col("y") * 0.5 + 3.0], "double")
    _add("mapim", lambda t: shown(R.mapim(t.ev, index(t))), sampled("i * 0.5 + j * 0.25", "j * 0.5 + 3.0", bil))
    _add("quadratic", lambda t: shown(R.quadratic(t.ev, [(1.5, 0.5), (0.1, 0.0), (0.0, -0.1), (0.001, 0.0)], "bilinear")), sampled("1.0 * 1.5 + i * 0.1::DOUBLE + j * 0.0 + i * j * 0.001::DOUBLE + i * i * 0 + j * j * 0 + i", "1.0 * 0.5 + i * 0.0 + j * -0.1::DOUBLE + i * j * 0.0 + j", bil))


def _transforms():
    for name, fn in (("fwfft", lambda t: Q.fwfft(t.ev)), ("invfft", lambda t: Q.invfft(Q.fwfft(t.ev)))):
        _add(name, lambda t, fn=fn: shown(fn(t), 3))
    _point("invfft_real", lambda t: Q.invfft(Q.fwfft(t.ev), True), "v", integer=False, digits=3)
    _add("freqmult", lambda t: shown(Q.freqmult(t.ev, G.mask_gaussian(t.spark, 100, t.ev.height, 0.5, 0.1)), 3))
    _add("phasecor", lambda t: shown(Q.phasecor(t.ev, V.wrap(t.ev, 3, 5)), 3))
    _add("spectrum", lambda t: shown(Q.spectrum(t.ev)))
    w = "(0.5 - 0.5 * cos(greatest(0.0, least(1.0, (i - 85 + 0.5) / 10.0::DOUBLE)) * pi()))"
    _add("merge", lambda t: shown(S.merge(t.ev, t.ev, "horizontal", -80, 0, 10)), with_ctes(["ev", "dim"],
         f"SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y, CAST(CASE WHEN q.v IS NULL THEN p.v WHEN p.v IS NULL THEN q.v ELSE floor(p.v * (1 - {w}) + q.v * {w} + 0.5) END AS BIGINT) AS b0 FROM range(180) a(i) CROSS JOIN (SELECT unnest(range(my + 1)) AS j FROM dim) LEFT JOIN ev p ON p.x = i AND p.y = j LEFT JOIN ev q ON q.x = i - 80 AND q.y = j"))
    _add("mosaic_correlate", lambda t: S.correlate(t.ev, V.wrap(t.ev, 98, t.ev.height - 3), 40, 40, 40, 40, 5, 6).select("dx", "dy"), "SELECT CAST(-2 AS INT) AS dx, CAST(-3 AS INT) AS dy")
    _add("mosaic", lambda t: shown(S.mosaic(t.ev, V.wrap(t.ev, 80, 0), "horizontal", 90, 40, 10, 40, 3, 4)))
    _add("mosaic1", lambda t: shown(S.mosaic1(t.ev, t.ev, "horizontal", (90, 20), (10, 20), (90, 60), (10, 60))))
    _add("match", lambda t: shown(S.match(t.ev, t.ev, (10, 10), (12, 11), (60, 50), (62, 51))))
    _add("globalbalance", lambda t: shown(S.globalbalance([t.ev, t.ev.point(lambda c: c / 2, "float")], [(0, 0), (0, 0)])[1], 2), with_ctes(["ev"], f"SELECT x, y, {sql_fixed('v / 2.0 * 2.0', 2)} AS b0 FROM ev"))
    _add("remosaic", lambda t: shown(S.remosaic([{"ref": "a.v", "sec": "b.v", "direction": "horizontal", "dx": -80, "dy": 0}], {"a.w": t.ev, "b.w": t.bin}, ".v", ".w")))
    mat = "SELECT CAST(n_nationkey % 5 AS INT) AS x, CAST(n_nationkey // 5 AS INT) AS y, CAST((n_nationkey * 7) % 11 + CASE WHEN n_nationkey % 6 = 0 THEN 20 ELSE 0 END AS DOUBLE) AS v FROM nation"
    frame = lambda t: t.table("nation").select((F.col("n_nationkey") % 5).cast("int").alias("x"), F.expr("cast(n_nationkey div 5 as int)").alias("y"), ((F.col("n_nationkey") * 7) % 11 + F.when(F.col("n_nationkey") % 6 == 0, 20).otherwise(0)).cast("double").alias("v"))
    _add("matrixmultiply", lambda t: S.matrixmultiply(frame(t), frame(t)), f"WITH m AS ({mat}) SELECT b.x, a.y, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.x = b.y GROUP BY b.x, a.y")
    _add("matrixinvert", lambda t: S.matrixmultiply(frame(t), S.matrixinvert(frame(t))).select("x", "y", fixed(F.col("v")).alias("v")), f"WITH m AS ({mat}) SELECT x, y, CASE WHEN x = y THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM m")
    _add("matrix_transpose", lambda t: S.transpose(frame(t)), f"WITH m AS ({mat}) SELECT y AS x, x AS y, v FROM m")
    _add("matrix_concat", lambda t: S.matcat([frame(t), frame(t)]), f"WITH m AS ({mat}) SELECT x, y, v FROM m UNION ALL SELECT x, y + 5, v FROM m")


def _files():
    """Round trips: saved by the engine, read back by the engine, compared with the pixels themselves."""
    import uuid

    from ..sources import files
    from .contraction import shared_folder

    def trip(t, r, codec, **options):
        folder = f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"
        files.save(r, folder, codec, **options).collect()
        extra = {"width": r.width, "height": r.height, "bands": r.bands, "format": r.format} if codec == "raw" else {}
        return files.load(t.spark, folder, codec if codec in ("raw", "csv", "matrix") else None, **extra)

    one = with_ctes(["ev"], "SELECT x, y, CAST(v AS BIGINT) AS b0 FROM ev")
    for name, codec, options in (("pgm", "ppm", {}), ("pgm_ascii", "ppm", {"ascii": True}), ("png_mono", "png", {}), ("raw", "raw", {}), ("native", "native", {}), ("tiff", "tiff", {}), ("tiff_plain", "tiff", {"compression": "none"}), ("fits", "fits", {}), ("nifti", "nifti", {})):
        _add(f"save_load_{name}", lambda t, c=codec, o=options: shown(trip(t, t.ev, c, **o)), one)
    three = with_ctes(["ev4"], "SELECT x, y, CAST(b0 AS BIGINT) AS b0, CAST(b1 AS BIGINT) AS b1, CAST(b2 AS BIGINT) AS b2 FROM ev4")
    for name, codec in (("ppm", "ppm"), ("png", "png"), ("bmp", "bmp")):
        _add(f"save_load_{name}", lambda t, c=codec: shown(trip(t, t.ev3, c)), three)
    _add("save_load_png_alpha", lambda t: shown(trip(t, t.ev4, "png")), three.replace("AS b2 FROM ev4", "AS b2, CAST(b3 AS BIGINT) AS b3 FROM ev4"))
    _add("save_load_gif", lambda t: shown(V.extract_band(trip(t, t.ev, "gif"), 0)), one)
    for codec in ("csv", "matrix"):
        _add(f"save_load_{codec}", lambda t, c=codec: shown(trip(t, t.ev, c)), with_ctes(["ev"], f"SELECT x, y, {sql_fixed('v')} AS b0 FROM ev"))
    _add("save_load_pfm", lambda t: shown(trip(t, t.val.cast("float"), "ppm"), 3), with_ctes(["val"], f"SELECT x, y, {sql_fixed('v', 3)} AS b0 FROM val"))
    _add("save_load_pbm", lambda t: shown(trip(t, t.bin, "ppm", bitdepth=1)), with_ctes(["bn"], "SELECT x, y, CAST(v AS BIGINT) AS b0 FROM bn"))
    _add("save_load_rad", lambda t: shown(trip(t, t.ev3.cast("float"), "rad"), 1))
    near = lambda: (F.abs(F.col("got").cast("int") - F.col("b0").cast("int")) <= 3).alias("near")
    _add("save_load_jpeg", lambda t: trip(t, t.ev, "jpeg", Q=100).df.select("x", "y", F.col("b0").alias("got")).join(t.ev.df.select("x", "y", "b0"), ["x", "y"], "full").select("x", "y", near()), with_ctes(["ev"], "SELECT x, y, TRUE AS near FROM ev"))
    _add("stream_windowed", lambda t: _batch_windows(t), "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM events GROUP BY 1, 2")


def _batch_windows(t):
    from ..streaming import scanlines

    return scanlines.windowed(t.table("events"))


def _more_sql():
    """SQL of queries built above, where it takes several steps."""
    clip = lambda e: f"CAST(least(255, greatest(0, floor({e} + 0.5))) AS BIGINT)"

    def reduced(factor_h: float, factor_v: float, kernel: str, width: int, height: int) -> str:
        w, cols = R.taps(width, factor_h, kernel)
        h, rows = R.taps(height, factor_v, kernel)
        values = lambda t: ", ".join(f"({i}, {o}, {v!r}::DOUBLE)" for i, o, v in t)
        ctes = {"v": f"SELECT ev.x, o AS y, {clip('sum(ev.v * w)')} AS v FROM ev JOIN (VALUES {values(rows)}) m(i, o, w) ON i = ev.y GROUP BY ev.x, o" if factor_v != 1 else "SELECT * FROM ev"}
        return with_ctes(["ev"], f"SELECT CAST(o AS INT) AS x, CAST(v.y AS INT) AS y, {clip('sum(v.v * w)')} AS b0 FROM v JOIN (VALUES {values(cols)}) m(i, o, w) ON i = v.x GROUP BY o, v.y" if factor_h != 1 else "SELECT x, CAST(y AS INT) AS y, CAST(v AS BIGINT) AS b0 FROM v", ctes)

    # Kernel tables depend on the size: these are for 100 x 100 pixels, the size at scale 0.01.
    _SQL["reducev"] = reduced(1, 2.0, "lanczos3", 100, 100)
    _SQL["reduce"] = reduced(2.0, 2.0, "linear", 100, 100)
    _SQL["resize_down"] = reduced(2.0, 2.0, "lanczos3", 100, 100)
    _SQL["thumbnail_image"] = reduced(2.5, 2.5, "lanczos3", 100, 100)
    pts, x, y, d = [], 0, 12, 3 - 24
    while x <= y:
        pts += [(50 + sx * a, 40 + sy * b) for a, b in ((x, y), (y, x)) for sx in (1, -1) for sy in (1, -1)]
        d, y = (d + 4 * x + 6, y) if d < 0 else (d + 4 * (x - y) + 10, y - 1)
        x += 1
    _SQL["draw_circle"] = with_ctes(["ev"], f"SELECT ev.x, ev.y, CAST(CASE WHEN m.px IS NULL THEN v ELSE 77 END AS BIGINT) AS b0 FROM ev LEFT JOIN (SELECT DISTINCT * FROM (VALUES {', '.join(map(str, pts))}) t(px, py)) m ON m.px = ev.x AND m.py = ev.y")
    pq = "(pow(greatest(pow({0}, 1 / 78.84375) - 0.8359375, 0.0) / (18.8515625 - 18.6875 * pow({0}, 1 / 78.84375)), 1 / 0.1593017578125) * (10000.0 / 203.0))"
    light = {"srgb": "(CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END)", "bt709": "(CASE WHEN {0} < 0.081 THEN {0} / 4.5 ELSE pow(({0} + 0.099) / 1.099, 1 / 0.45) END)", "linear": "{0}", "pq": pq,
             "hlg": "(CASE WHEN {0} <= 0.5 THEN {0} * {0} / 3 ELSE (exp(({0} - 0.55991073) / 0.17883277) + 0.28466892) / 12 END)"}
    for tr, e in light.items():
        c = [e.format(f"(b{k} / 255.0::DOUBLE)") for k in range(3)]
        _SQL[f"CICP2scRGB_{tr}"] = with_ctes(["ev4"], "SELECT x, y, " + ", ".join(f"{sql_fixed(f'{c[0]} * {m[0]} + {c[1]} * {m[1]} + {c[2]} * {m[2]}', 3)} AS b{k}" for k, m in enumerate(K.BT2020_709)) + " FROM ev4")
    top = "greatest(b0, b1, b2)"
    e = f"(floor(log2({top})) + 1)"
    _SQL["save_load_rad"] = with_ctes(["ev4"], "SELECT x, y, " + ", ".join(sql_fixed(f"CASE WHEN {top} = 0 THEN 0.0 ELSE (floor(b{k} * (256.0 / pow(2.0, {e}))) + 0.5) * pow(2.0, {e} - 8) END", 1) + f" AS b{k}" for k in range(3)) + " FROM ev4")
    # The uniform space twice, then the distance.
    def cmc(prefix, l, a, b):
        h = f"CASE WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
        return f"SELECT x, y, {l} AS p, sqrt({a} * {a} + {b} * {b}) AS q, {h} AS r FROM {prefix}"

    C = K.C
    seg = lambda j: f"(CASE WHEN r < 49.1 THEN {C.CMC_HUES[0][j]} WHEN r < 110.1 THEN {C.CMC_HUES[1][j]} WHEN r < 269.6 THEN {C.CMC_HUES[2][j]} ELSE {C.CMC_HUES[3][j]} END)"
    pc = f"cos(radians({seg(4)} * r + {seg(5)}))"
    uniform = "SELECT x, y, CASE WHEN p < 16.0 THEN 1.744 * p ELSE 21.75 * ln(greatest(p, 1.0)) + 0.3838 * p - 38.54 END AS l, greatest(0.0, 0.162 * q + 10.92 * ln(0.638 + 0.07216 * q) + 4.907) AS c, " + f"r + ({seg(1)} + {seg(2)} * {pc} * pow(abs({pc}), {seg(3)})) * sqrt(q * q * q * q / (q * q * q * q + 1900.0)) AS h FROM "
    ctes = {"m1": cmc("lab", "l", "a", "b"), "n1": cmc("lab2", "l", "a", "b"), "m2": uniform + "m1", "n2": uniform + "n1",
            "m3": "SELECT x, y, l, c * cos(radians(h)) AS a, c * sin(radians(h)) AS b FROM m2", "n3": "SELECT x, y, l, c * cos(radians(h)) AS a, c * sin(radians(h)) AS b FROM n2"}
    _SQL["dECMC"] = with_ctes(["lab", "lab2"], f"SELECT m.x, m.y, {sql_fixed('sqrt((m.l - n.l) * (m.l - n.l) + (m.a - n.a) * (m.a - n.a) + (m.b - n.b) * (m.b - n.b))', 2)} AS b0 FROM m3 m JOIN n3 n ON m.x = n.x AND m.y = n.y", ctes)
    _SQL["LabS2LabQ"] = with_ctes(["lab"], "SELECT x, y, ql >> 2 AS b0, (qa >> 3) & 255 AS b1, (qb >> 3) & 255 AS b2, ((ql & 3) << 6) | ((qa & 7) << 3) | (qb & 7) AS b3 FROM q", {
        "s": "SELECT x, y, trunc(greatest(0.0, least(32767.0, l * (32767.0 / 100.0)))) AS l, trunc(greatest(-32768.0, least(32767.0, a * 256.0))) AS a, trunc(greatest(-32768.0, least(32767.0, b * 256.0))) AS b FROM lab",
        "f": "SELECT x, y, CAST(CAST(l / (32767.0 / 100.0) AS REAL) AS DOUBLE) AS l, CAST(CAST(a / 256.0 AS REAL) AS DOUBLE) AS a, CAST(CAST(b / 256.0 AS REAL) AS DOUBLE) AS b FROM s",
        "q": "SELECT x, y, CAST(greatest(0, least(1023, floor(10.23 * l + 0.5))) AS BIGINT) AS ql, CAST(greatest(-1024, least(1023, round_even(8.0 * a, 0))) AS BIGINT) AS qa, CAST(greatest(-1024, least(1023, round_even(8.0 * b, 0))) AS BIGINT) AS qb FROM f"})
    gain = "SELECT CAST(x // 2 AS INT) AS gx, CAST(y // 2 AS INT) AS gy, CAST(floor((sum(v) + 1) / 2.0) AS BIGINT) AS v FROM (SELECT x, y // 2 * 2 AS y, CAST(floor((sum(v) + 1) / 2.0) AS BIGINT) AS v FROM ev GROUP BY x, y // 2) GROUP BY x // 2, y // 2"
    _SQL["uhdr2scRGB"] = with_ctes(["ev", "ev4"], "SELECT x, y, " + ", ".join(sql_fixed(f"{d} * pow(4.0, g.v / 255.0::DOUBLE)", 3) + f" AS b{k}" for k, d in enumerate(f"({q})" for q in _DECODE)) + " FROM ev4 JOIN g ON g.gx = ev4.x // 2 AND g.gy = ev4.y // 2", {"g": gain})
    limit = 3 * 25 / 256.0
    src = _NEIGHBOURS
    below = f"list_sum(list_transform(list_distinct(list_filter(vs, lambda e: e <= c)), lambda d: least({limit!r}::DOUBLE, CAST(len(list_filter(vs, lambda e: e = d)) AS DOUBLE))))"
    spare = f"list_sum(list_transform(list_distinct(vs), lambda d: greatest(0.0::DOUBLE, len(list_filter(vs, lambda e: e = d)) - {limit!r}::DOUBLE)))"
    _SQL["hist_local_slope"] = with_ctes(["ev", "dim"], f"SELECT x, y, CAST(floor(least(255.0::DOUBLE, 255 * ({below} + {spare} * (c + 1) / 256.0::DOUBLE) / 25.0::DOUBLE)) AS BIGINT) AS b0 FROM (SELECT x, y, any_value(c) AS c, list(v) AS vs FROM nb GROUP BY x, y)", {"m": _offsets(5, 5), "nb": src})


def queries():
    return dict(_Q)


def oracle_sql():
    return dict(_SQL)


_arithmetic()
_neighbourhoods()
_conversion()
_histograms()
_generators()
_colours()
_drawing()
_resampling()
_transforms()
_files()
_more_sql()
