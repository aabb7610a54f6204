"""Matrix and tone-curve ICC profiles: built, parsed, and applied as column expressions.

Profiles with look-up tables (most CMYK ones) need a colour management library and raise.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from .colour import D50, lab_xyz, xyz_lab

# Primaries (x, y) of the built-in profiles, the D65 white point, and the D65 to D50 adaptation (Bradford).
PRIMARIES = {"srgb": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)), "p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060)), "rec2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046))}
WHITE_D65 = (0.3127, 0.3290)
BRADFORD = ((1.0478112, 0.0228866, -0.0501270), (0.0295424, 0.9904844, -0.0170491), (-0.0092345, 0.0150436, 0.7521316))
SRGB_CURVE = (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)


def primaries_matrix(primaries, white=WHITE_D65) -> np.ndarray:
    m = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in primaries]).T
    w = np.array([white[0] / white[1], 1.0, (1 - sum(white)) / white[1]])
    return np.array(BRADFORD) @ (m * np.linalg.solve(m, w))


def profile_load(name: str) -> bytes:
    """A built-in profile (srgb, p3, rec2020) or a profile file, as bytes."""
    if name not in PRIMARIES:
        with open(name, "rb") as f:
            return f.read()
    fixed = lambda v: struct.pack(">i", int(round(v * 65536)))
    m = primaries_matrix(PRIMARIES[name])
    curve = b"para\0\0\0\0" + struct.pack(">HH", 3, 0) + b"".join(map(fixed, SRGB_CURVE))
    tags = [(k, b"XYZ \0\0\0\0" + b"".join(fixed(v) for v in m[:, j])) for j, k in enumerate((b"rXYZ", b"gXYZ", b"bXYZ"))]
    tags += [(k, curve) for k in (b"rTRC", b"gTRC", b"bTRC")]
    at, table, body = 132 + 12 * len(tags), b"", b""
    for key, data in tags:
        table += key + struct.pack(">II", at + len(body), len(data))
        body += data.ljust(-(-len(data) // 4) * 4, b"\0")
    head = struct.pack(">I", at + len(body)) + b"none" + struct.pack(">I", 0x04300000) + b"mntrRGB XYZ " + b"\0" * 12 + b"acsp"
    return head.ljust(128, b"\0") + struct.pack(">I", len(tags)) + table + body


def parse(profile: bytes):
    """(3 x 3 matrix to D50 XYZ, curves: each a gamma, a parametric tuple or a table)."""
    if profile[36:40] != b"acsp" or profile[16:20] != b"RGB ":
        raise ValueError("not an RGB profile of the matrix kind: a colour management library is needed")
    n, = struct.unpack(">I", profile[128:132])
    tags = {profile[132 + 12 * k : 136 + 12 * k]: struct.unpack(">II", profile[136 + 12 * k : 144 + 12 * k]) for k in range(n)}
    if b"rXYZ" not in tags:
        raise ValueError("a profile of tables: a colour management library is needed")
    get = lambda t: profile[tags[t][0] : tags[t][0] + tags[t][1]]
    m = np.array([[v / 65536 for v in struct.unpack(">3i", get(t)[8:20])] for t in (b"rXYZ", b"gXYZ", b"bXYZ")]).T
    curves = []
    for t in (b"rTRC", b"gTRC", b"bTRC"):
        d = get(t)
        if d[:4] == b"para":
            kind, = struct.unpack(">H", d[8:10])
            v = [x / 65536 for x in struct.unpack(f">{(1, 3, 4, 5, 7)[kind]}i", d[12 : 12 + 4 * (1, 3, 4, 5, 7)[kind]])]
            curves.append(v[0] if kind == 0 else tuple(v[:5]) if kind >= 3 else (v[0], v[1], v[2], 0.0, -v[2] / v[1]))
        else:
            count, = struct.unpack(">I", d[8:12])
            table = struct.unpack(f">{count}H", d[12 : 12 + 2 * count])
            curves.append(1.0 if count == 0 else table[0] / 256 if count == 1 else [v / 65535 for v in table])
    return m, curves


def _linear(c, curve):
    if isinstance(curve, float):
        return F.pow(c, F.lit(curve))
    if isinstance(curve, tuple):
        g, a, b, k, d = curve
        return F.when(c >= d, F.pow(F.greatest(F.lit(0.0), a * c + b), F.lit(g))).otherwise(k * c)
    at = c * (len(curve) - 1)
    low = F.least(F.floor(at), F.lit(len(curve) - 2)).cast("int")
    table = F.array(*[F.lit(v) for v in curve])
    return F.get(table, low) + (at - low) * (F.get(table, low + 1) - F.get(table, low))


def _encoded(v, curve):
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    if isinstance(curve, float):
        return F.pow(v, F.lit(1 / curve))
    if isinstance(curve, tuple):
        g, a, b, k, d = curve
        edge = (a * d + b) ** g
        return F.when(v >= edge, (F.pow(v, F.lit(1 / g)) - b) / a).otherwise(v / k if k else F.lit(0.0))
    inv = np.interp(np.linspace(0, 1, 1024), curve, np.linspace(0, 1, len(curve)))
    return F.get(F.array(*[F.lit(float(x)) for x in inv]), F.floor(v * 1023 + 0.5).cast("int"))


def device_xyz(c, profile: bytes, top=255.0):
    m, curves = parse(profile)
    light = [_linear(v.cast("double") / top, k) for v, k in zip(c, curves)]
    return [sum([light[j] * float(row[j] * 100) for j in (1, 2)], light[0] * float(row[0] * 100)) for row in m]


def xyz_device(c, profile: bytes, top=255.0):
    m, curves = parse(profile)
    inv = np.linalg.inv(m) / 100
    light = [sum([c[j] * float(row[j]) for j in (1, 2)], c[0] * float(row[0])) for row in inv]
    return [F.floor(_encoded(v, k) * top + 0.5) for v, k in zip(light, curves)]


def device_lab(c, profile, top=255.0):
    return xyz_lab(device_xyz(c, profile, top), D50)


def lab_device(c, profile, top=255.0):
    return xyz_device(lab_xyz(c, D50), profile, top)
