"""Colour transforms as column expressions: triples in, triples out; Catalyst fuses chains into one projection."""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction

from pyspark.sql import Column, functions as F

from .bind import let

# White points and matrices of the public colour standards (D65, sRGB, Oklab).
D65 = (95.0470, 100.0, 108.8827)
D50 = (96.4250, 100.0, 82.4680)
SCRGB_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
XYZ_SCRGB = ((3.240625, -1.537208, -0.498629), (-0.968931, 1.875756, 0.041518), (0.055710, -0.204021, 1.056996))
XYZ_LMS = ((0.8189330101, 0.3618667424, -0.1288597137), (0.0329845436, 0.9293118715, 0.0361456387), (0.0482003018, 0.2643662691, 0.6338517070))
LMS_OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
OKLAB_LMS = ((1.0, 0.39633779, 0.21580376), (1.00000001, -0.10556134, -0.06385417), (1.00000005, -0.08948418, -1.29148554))
LMS_XYZ = ((1.22701385, -0.55779998, 0.28125615), (-0.04058018, 1.11225687, -0.07167668), (-0.07638128, -0.42148198, 1.58616322))

Triple = tuple


def dot(m, c, scale=1.0) -> list[Column]:
    return [(c[0] * row[0] + c[1] * row[1] + c[2] * row[2]) * scale for row in m]


def _guard(cond, value, other=0.0):
    return F.when(cond, value).otherwise(F.lit(other))


def hue(a: Column, b: Column) -> Column:
    d = F.degrees(F.atan2(b, a))
    return F.when(d < 0, d + 360).otherwise(d)


def _arctan(q: Fraction) -> Fraction:
    """To 40 digits, for q of 0 to 1: halved angles, then the series."""
    with localcontext() as c:
        c.prec = 50
        x, n = Decimal(q.numerator) / q.denominator, 0
        while x > Decimal("0.01"):
            x, n = x / (1 + (1 + x * x).sqrt()), n + 1
        return Fraction(sum((-1) ** k * x ** (2 * k + 1) / (2 * k + 1) for k in range(12)) * 2**n)


def _pair(v: Fraction) -> tuple[float, float]:
    """A number as the sum of two doubles."""
    return float(v), float(v - Fraction(float(v)))


STEPS = 256
ARCTANS = [_pair(_arctan(Fraction(k, STEPS))) for k in range(STEPS + 1)]
HALF_PI, PI = _pair(2 * _arctan(Fraction(1))), _pair(4 * _arctan(Fraction(1)))


def _sum2(a: Column, b: Column, fn):
    """``fn`` of the rounded sum and of what rounding left out."""
    return let([a, b, a + b], lambda v: let([v[2], v[2] - v[0], v[0], v[1]], lambda w: fn(w[0], (w[2] - (w[0] - w[1])) + (w[3] - w[1]))))


def close_atan2(b: Column, a: Column) -> Column:
    """The double next to the arc tangent of b / a, but for a few of a thousand; F.atan2 can be the one beside it.

    The angle of the smaller by the larger side comes from a table in steps, kept in two doubles, and from
    the small angle that is left; reflections add to both doubles.
    """
    absolute = [F.abs(a), F.abs(b)]
    split = 134217729.0  # halves of a double, whose products with a step are exact

    def small(v):
        lo, hi, k = v
        c = k / float(STEPS)
        big = hi * split
        return let([lo, hi, k, c, big - (big - hi)], rest)

    def rest(v):
        lo, hi, k, c, head = v
        d = ((lo - head * c) - (hi - head) * c) / (hi + lo * c)
        table = lambda j: F.element_at(F.array(*[F.lit(t[j]) for t in ARCTANS]), k.cast("int") + 1)
        return let([table(0), table(1), d - d * d * d / 3 + d * d * d * d * d / 5], first)

    def first(v):
        return _sum2(v[0], v[2], lambda hi, left: let([hi, left + v[1]], octant))

    def octant(v):
        hi, lo = v
        steep = absolute[1] > absolute[0]
        # Over the diagonal the angle is what lacks to a right one; on the left, what lacks to a straight one.
        turned = let([F.when(steep, -hi).otherwise(hi), F.when(steep, -lo).otherwise(lo), F.when(steep, HALF_PI[0]).otherwise(0.0), F.when(steep, HALF_PI[1]).otherwise(0.0)], add)
        left = let([turned["hi"], turned["lo"]], lambda t: let([-t[0], -t[1], F.lit(PI[0]), F.lit(PI[1])], add))
        return let([F.when(a < 0, left).otherwise(turned)], lambda t: F.when(b < 0, -(t[0]["hi"] + t[0]["lo"])).otherwise(t[0]["hi"] + t[0]["lo"]))

    def add(v):
        return _sum2(v[2], v[0], lambda hi, left: F.struct(hi.alias("hi"), (left + v[1] + v[3]).alias("lo")))

    lo, hi = F.least(*absolute), F.greatest(*absolute)
    return F.when(hi == 0, F.lit(0.0)).otherwise(let([lo, hi, F.floor(lo / hi * STEPS + 0.5).cast("double")], small))


def close_hue(a: Column, b: Column) -> Column:
    return let([F.degrees(close_atan2(b, a))], lambda v: F.when(v[0] < 0, v[0] + 360).otherwise(v[0]))


def srgb_decode(v: Column, top=255.0) -> Column:
    f = v.cast("double") / top
    return F.when(f <= 0.04045, f / 12.92).otherwise(F.pow((f + 0.055) / 1.055, F.lit(2.4)))


def srgb_encode(f: Column, top=255.0) -> Column:
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), f))
    v = F.when(f <= 0.0031308, f * 12.92).otherwise(1.055 * F.pow(f, F.lit(1 / 2.4)) - 0.055)
    return F.floor(v * top + 0.5)


def xyz_lab(c, white=D65):
    def f(v, w):
        t = v / w
        return F.when(t < 0.008856, 7.787 * t + 16.0 / 116.0).otherwise(F.cbrt(t))

    x, y, z = (f(v, w) for v, w in zip(c, white))
    return [116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)]


def lab_xyz(c, white=D65):
    l, a, b = c
    low = l < 8.0
    y = F.when(low, l * white[1] / 903.3).otherwise(white[1] * F.pow((l + 16.0) / 116.0, F.lit(3.0)))
    fy = F.when(low, 7.787 * (y / white[1]) + 16.0 / 116.0).otherwise((l + 16.0) / 116.0)

    def back(t, w):
        return F.when(t < 0.2069, w * (t - 0.13793) / 7.787).otherwise(w * t * t * t)

    return [back(a / 500.0 + fy, white[0]), y, back(fy - b / 200.0, white[2])]


def lab_lch(c):
    return [c[0], F.sqrt(c[1] * c[1] + c[2] * c[2]), hue(c[1], c[2])]


def lch_lab(c):
    return [c[0], c[1] * F.cos(F.radians(c[2])), c[1] * F.sin(F.radians(c[2]))]


def xyz_yxy(c):
    s = c[0] + c[1] + c[2]
    safe = F.when(s == 0, F.lit(1.0)).otherwise(s)
    return [c[1], _guard(s != 0, c[0] / safe), _guard(s != 0, c[1] / safe)]


def yxy_xyz(c):
    big, x, y = c
    ok = (x != 0) & (y != 0)
    sx, sy = F.when(ok, x).otherwise(F.lit(1.0)), F.when(ok, y).otherwise(F.lit(1.0))
    return [_guard(ok, big * x / sy), big, _guard(ok, (big * x / sy) * (1 - x - y) / sx)]


def scrgb_xyz(c):
    return dot(SCRGB_XYZ, c, 100.0)


def xyz_scrgb(c):
    return dot(XYZ_SCRGB, c, 0.01)


def srgb_scrgb(c, top=255.0):
    return [srgb_decode(v, top) for v in c]


def scrgb_srgb(c, top=255.0):
    return [srgb_encode(v, top) for v in c]


def scrgb_bw(c, top=255.0):
    return [srgb_encode(0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2], top)]


def xyz_oklab(c):
    return dot(LMS_OKLAB, [F.cbrt(v) for v in dot(XYZ_LMS, [v / 100.0 for v in c])])


def oklab_xyz(c):
    return dot(LMS_XYZ, [v * v * v for v in dot(OKLAB_LMS, c)], 100.0)


def cmc_l(l):
    return F.when(l < 16.0, 1.744 * l).otherwise(21.75 * F.log(F.greatest(l, F.lit(1.0))) + 0.3838 * l - 38.54)


def cmc_c(c):
    return F.greatest(F.lit(0.0), 0.162 * c + 10.92 * F.log(0.638 + 0.07216 * c) + 4.907)


# Hue segments of the CMC space (upper limit, k4..k8).
CMC_HUES = ((49.1, 133.87, -134.5, -0.924, 1.727, 340.0), (110.1, 11.78, -12.7, -0.218, 2.12, 333.0), (269.6, 13.87, 10.93, 0.14, 1.0, -83.0), (None, 0.14, 5.23, 0.17, 1.61, 233.0))


def cmc_h(c, h):
    pick = lambda j: F.when(h < 49.1, CMC_HUES[0][j]).when(h < 110.1, CMC_HUES[1][j]).when(h < 269.6, CMC_HUES[2][j]).otherwise(CMC_HUES[3][j])
    k4, k5, k6, k7, k8 = (pick(j) for j in range(1, 6))
    p = F.cos(F.radians(k7 * h + k8))
    d = k4 + k5 * p * F.pow(F.abs(p), k6)
    c4 = c * c * c * c
    f = F.sqrt(c4 / (c4 + 1900.0))
    return h + d * f


def lch_cmc(c):
    return [cmc_l(c[0]), cmc_c(c[1]), cmc_h(c[1], c[2])]


def srgb_hsv(c):
    r, g, b = (v.cast("double") for v in c)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    safe = F.when(delta == 0, F.lit(1.0)).otherwise(delta)
    sector = lambda diff, base: 42.5 * (diff / safe) + base
    h = F.when(g < b, F.when(b < r, sector(g - b, 255.0)).otherwise(sector(r - g, 170.0))).otherwise(F.when(g < r, sector(g - b, 0.0)).otherwise(sector(b - r, 85.0)))
    return [F.when((top == 0) | (delta == 0), F.lit(0.0)).otherwise(F.floor(h)), F.when(top == 0, F.lit(0.0)).otherwise(F.floor(delta * 255.0 / F.when(top == 0, F.lit(1.0)).otherwise(top))), top]


def hsv_srgb(c):
    h, s, v = (x.cast("double") for x in c)
    k = v * s / 255.0
    t = h / 42.5
    x = k * (1 - F.abs(t - 2 * F.floor(t / 2) - 1))
    m = v - k
    rows = [(k, x, None), (x, k, None), (None, k, x), (None, x, k), (x, None, k), (k, None, x)]
    out = []
    for j in range(3):
        one = F.lit(None).cast("double")
        values = [(row[j] if row[j] is not None else F.lit(0.0)) + m for row in rows]
        one = F.when(h < 42, values[0]).when(h < 85, values[1]).when(h < 127, values[2]).when(h < 170, values[3]).when(h < 212, values[4]).otherwise(values[5])
        out.append(F.floor(one))
    return out


def xyz_cmyk(c):
    """Without a profile: complements of the white-relative values, black taken out."""
    k = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - v / w)) for v, w in zip(c, D65)]
    black = F.least(*k)
    safe = F.when(black >= 1, F.lit(1.0)).otherwise(1 - black)
    return [F.floor(255.0 * _guard(black < 1, (v - black) / safe) + 0.5) for v in k] + [F.floor(255.0 * black + 0.5)]


def cmyk_xyz(c):
    *ink, k = [v.cast("double") / 255.0 for v in c]
    return [w * (1 - v) * (1 - k) for v, w in zip(ink, D65)]


def lab_labs(c):
    return [F.greatest(F.lit(0.0), F.least(F.lit(32767.0), c[0] * (32767.0 / 100.0))), *[F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), v * (32768.0 / 128.0))) for v in c[1:]]]


def labs_lab(c):
    return [c[0].cast("double") / (32767.0 / 100.0), *[v.cast("double") / (32768.0 / 128.0) for v in c[1:]]]


def lab_labq(c):
    """Four bytes: the high bits of L, a, b and one byte of low bits (10, 11, 11)."""
    l = F.greatest(F.lit(0), F.least(F.lit(1023), F.floor(10.23 * c[0] + 0.5))).cast("int")
    a, b = (F.greatest(F.lit(-1024), F.least(F.lit(1023), F.rint(8.0 * v))).cast("int") for v in c[1:])
    low = F.shiftleft(l.bitwiseAND(F.lit(3)), 6).bitwiseOR(F.shiftleft(a.bitwiseAND(F.lit(7)), 3)).bitwiseOR(b.bitwiseAND(F.lit(7)))
    return [F.shiftright(l, 2), F.shiftright(a, 3).bitwiseAND(F.lit(255)), F.shiftright(b, 3).bitwiseAND(F.lit(255)), low]


def labq_lab(c):
    l0, a0, b0, low = (v.cast("int") for v in c)
    signed = lambda v: F.when(v > 127, v - 256).otherwise(v)
    l = F.shiftleft(l0, 2).bitwiseOR(F.shiftright(low, 6))
    a = F.shiftleft(signed(a0), 3).bitwiseOR(F.shiftright(low, 3).bitwiseAND(F.lit(7)))
    b = F.shiftleft(signed(b0), 3).bitwiseOR(low.bitwiseAND(F.lit(7)))
    return [l * (100.0 / 1023.0), a * 0.125, b * 0.125]


def rad_float(c):
    e = c[3].cast("int")
    f = F.pow(F.lit(2.0), (e - 136).cast("double"))
    return [F.when(e == 0, F.lit(0.0)).otherwise((v.cast("double") + 0.5) * f) for v in c[:3]]


def float_rad(c):
    top = F.greatest(*c)
    e = F.floor(F.log2(F.when(top > 1e-32, top).otherwise(F.lit(1.0)))) + 1
    f = 256.0 / F.pow(F.lit(2.0), e.cast("double"))
    ok = top > 1e-32
    return [*[_guard(ok, F.floor(F.greatest(v, F.lit(0.0)) * f)) for v in c], _guard(ok, (e + 128).cast("double"))]


def de76(p, q):
    return F.sqrt(sum([(a - b) * (a - b) for a, b in zip(p[1:], q[1:])], (p[0] - q[0]) * (p[0] - q[0])))


def de_cmc(p, q):
    """Distance in the uniform space, from its polar coordinates."""
    p, q = (lch_lab(lch_cmc(lab_lch(c))) for c in (p, q))
    return de76(p, q)


def de00(p, q):
    """CIEDE2000, in steps that bind their values.

    Hues of opposite colours are 180 degrees apart, where the mean hue jumps: there the last bit decides, so both are worked out closely.
    """
    seven = lambda c: F.pow(c, F.lit(7.0))
    cos = lambda v: F.cos(F.radians(v))

    def chroma(v):
        (a1, b1), (a2, b2) = v[1:3], v[4:6]
        return let([*v, (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2], stretched)

    def stretched(v):
        *v, cb = v
        g = 0.5 * (1 - F.sqrt(seven(cb) / (seven(cb) + 25.0**7)))
        return let([v[0], (1 + g) * v[1], v[2], v[3], (1 + g) * v[4], v[5]], polar)

    def polar(v):
        l1, a1, b1, l2, a2, b2 = v
        return let([*v, hue(a1, b1), hue(a2, b2)], hues)

    def hues(v):
        l1, a1, b1, l2, a2, b2, h1, h2 = v
        both = F.when(F.abs(F.abs(h1 - h2) - 180) < 1e-9, F.struct(close_hue(a1, b1).alias("h1"), close_hue(a2, b2).alias("h2"))).otherwise(F.struct(h1.alias("h1"), h2.alias("h2")))
        return let([l1, l2, F.sqrt(a1 * a1 + b1 * b1), F.sqrt(a2 * a2 + b2 * b2), both], lambda w: means([*w[:4], w[4]["h1"], w[4]["h2"]]))

    def means(v):
        l1, l2, c1, c2, h1, h2 = v
        near = F.abs(h1 - h2) < 180
        hd = F.when(near, (h1 + h2) / 2).otherwise(F.abs(h1 + h2 - 360) / 2)
        dh = F.when(near, h1 - h2).otherwise(360 - (h1 - h2))
        return let([l1, l2, c1, c2, (l1 + l2) / 2, (c1 + c2) / 2, hd, dh], terms)

    def terms(v):
        l1, l2, c1, c2, lb, cd, hd, dh = v
        turn = 30 * F.exp(-((hd - 275) / 25) * ((hd - 275) / 25))
        rt = -F.sin(F.radians(2 * turn)) * 2 * F.sqrt(seven(cd) / (seven(cd) + 25.0**7))
        t = 1 - 0.17 * cos(hd - 30) + 0.24 * cos(2 * hd) + 0.32 * cos(3 * hd + 6) - 0.20 * cos(4 * hd - 63)
        l50 = (lb - 50) * (lb - 50)
        nl, nc = (l1 - l2) / (1 + 0.015 * l50 / F.sqrt(20 + l50)), (c1 - c2) / (1 + 0.045 * cd)
        nh = 2 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2)) / (1 + 0.015 * cd * t)
        return let([nl, nc, nh, rt], lambda w: F.sqrt(F.greatest(F.lit(0.0), w[0] * w[0] + w[1] * w[1] + w[2] * w[2] + w[3] * w[1] * w[2])))

    return let([*p, *q], chroma)
