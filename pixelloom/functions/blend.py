"""Compositing: Porter-Duff operators and the separable and HSL blend modes of the PDF model, as column expressions.

Colours are premultiplied and all values are in 0..1.  ``a`` is the source (overlay), ``b``
the backdrop.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .bind import let


def _lo(a, b):
    return F.least(a, b)


def _porter_duff(mode, aa, ab):
    """(factor of a, factor of b, result alpha): the coverage algebra."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return {
        "clear": (zero, zero, zero), "source": (one, zero, aa), "over": (one, 1 - aa, aa + ab * (1 - aa)), "in": (ab, zero, aa * ab),
        "out": (1 - ab, zero, aa * (1 - ab)), "atop": (None, 1 - aa, ab), "dest": (zero, one, ab), "dest_over": (1 - ab, one, ab + aa * (1 - ab)),
        "dest_in": (zero, aa, aa * ab), "dest_out": (zero, 1 - aa, (1 - aa) * ab), "dest_atop": (1 - ab, None, aa), "xor": (1 - ab, 1 - aa, aa + ab - 2 * aa * ab),
        "add": (one, one, _lo(F.lit(1.0), aa + ab)), "saturate": (_lo(aa, 1 - ab), one, _lo(F.lit(1.0), aa + ab)),
    }[mode]


SEPARABLE = {
    "multiply": lambda a, b: a * b,
    "screen": lambda a, b: a + b - a * b,
    "overlay": lambda a, b: F.when(b <= 0.5, 2 * a * b).otherwise(1 - 2 * (1 - a) * (1 - b)),
    "darken": lambda a, b: F.least(a, b),
    "lighten": lambda a, b: F.greatest(a, b),
    "colour_dodge": lambda a, b: F.when(a < 1, F.least(F.lit(1.0), b / F.when(a < 1, 1 - a).otherwise(F.lit(1.0)))).otherwise(F.lit(1.0)),
    "colour_burn": lambda a, b: F.when(a > 0, 1 - F.least(F.lit(1.0), (1 - b) / F.when(a > 0, a).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0)),
    "hard_light": lambda a, b: F.when(a <= 0.5, 2 * a * b).otherwise(1 - 2 * (1 - a) * (1 - b)),
    "soft_light": lambda a, b: F.when(a <= 0.5, b - (1 - 2 * a) * b * (1 - b)).otherwise(b + (2 * a - 1) * (F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(F.greatest(b, F.lit(0.0)))) - b)),
    "difference": lambda a, b: F.abs(a - b),
    "exclusion": lambda a, b: a + b - 2 * a * b,
}


def _three(values):
    return F.struct(*[v.alias(f"c{k}") for k, v in enumerate(values)])


def _parts(struct):
    return [struct[f"c{k}"] for k in range(3)]


def _lum(c):
    return 0.3 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def _sat(c):
    return F.greatest(*c) - F.least(*c)


def _set_sat(c, s):
    """Struct of the colours with the saturation s."""
    def scaled(v):
        c, lo, hi, s = v[:3], v[3], v[4], v[5]
        return _three([F.when(hi > lo, (x - lo) * s / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)) for x in c])

    return let([*c, F.least(*c), F.greatest(*c), s], scaled)


def _set_lum(c, l):
    """Struct of the colours with the luminosity l, moved back into range."""
    def low(v):
        c, l, n = v[:3], v[3], F.least(*v[:3])
        return _three([F.when(n < 0, l + (x - l) * l / F.when(n < 0, l - n).otherwise(F.lit(1.0))).otherwise(x) for x in c])

    def shifted(v):
        moved = [x + (v[3] - _lum(v[:3])) for x in v[:3]]
        return let(moved, lambda m: let([*m, _lum(m), F.greatest(*m)], lambda w: let([low(w), w[3], w[4]], high)))

    def high(v):
        l, m = v[1], v[2]
        return _three([F.when(m > 1, l + (x - l) * (1 - l) / F.when(m > 1, m - l).otherwise(F.lit(1.0))).otherwise(x) for x in _parts(v[0])])

    return let([*c, l], shifted)


HSL = {
    "hue": lambda a, b: let([_set_sat(a, _sat(b)), _lum(b)], lambda v: _set_lum(_parts(v[0]), v[1])),
    "saturation": lambda a, b: let([_set_sat(b, _sat(a)), _lum(b)], lambda v: _set_lum(_parts(v[0]), v[1])),
    "colour": lambda a, b: _set_lum(a, _lum(b)),
    "luminosity": lambda a, b: _set_lum(b, _lum(a)),
}
MODES = ["clear", "source", "over", "in", "out", "atop", "dest", "dest_over", "dest_in", "dest_out", "dest_atop", "xor", "add", "saturate", *SEPARABLE, *HSL]


def mix(mode: str, a: list[Column], aa: Column, b: list[Column], ab: Column) -> tuple[list[Column], Column]:
    """(premultiplied result colours, result alpha)."""
    if mode in SEPARABLE or mode in HSL:
        # The HSL modes look at the colours themselves, the separable ones at what alpha leaves of them.
        if mode in SEPARABLE:
            f = [SEPARABLE[mode](x, y) for x, y in zip(a, b)]
        else:
            bare = lambda c, alpha: [F.when(alpha == 0, F.lit(0.0)).otherwise(v / F.when(alpha == 0, F.lit(1.0)).otherwise(alpha)) for v in c]
            f = _parts(let([*bare(a, aa), *bare(b, ab)], lambda v: HSL[mode](v[:3], v[3:])))
        # Where both cover, the mode decides; elsewhere each shows as it is.
        return [(1 - ab) * x + (1 - aa) * y + aa * ab * z for x, y, z in zip(a, b, f)], aa + ab * (1 - aa)
    fa, fb, alpha = _porter_duff(mode, aa, ab)
    fa, fb = (F.lit(1.0) if fa is None else fa), (F.lit(1.0) if fb is None else fb)
    return [fa * x + fb * y for x, y in zip(a, b)], alpha
