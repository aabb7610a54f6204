"""Image formats to and from arrays: height x width x bands.

Each codec is (sniff, decode, encode); decoders get bytes, encoders an array and options.
Formats that need a codec library absent here are listed in ``EXTERNAL`` and raise by name.
"""

from __future__ import annotations

import gzip
import math
import re
import struct
import zlib

import numpy as np

from . import jpeg
from .errors import Unsupported

# Numpy types of the band formats.
DTYPES = {"uchar": "u1", "char": "i1", "ushort": "u2", "short": "i2", "uint": "u4", "int": "i4", "float": "f4", "double": "f8", "complex": "c8", "dpcomplex": "c16"}
FORMAT_OF = {np.dtype(v).newbyteorder("=").str[1:]: k for k, v in DTYPES.items()}
EXTERNAL = {"webp": b"RIFF", "heif": b"\0\0\0", "jp2k": b"\0\0\0\x0cjP", "jxl": b"\xff\x0a", "pdf": b"%PDF", "svg": b"<svg", "openexr": b"\x76\x2f\x31\x01", "mat": b"MATLAB 5.0", "uhdr": b"", "dcraw": b"", "openslide": b"", "magick": b""}


def format_of(a: np.ndarray) -> str:
    return FORMAT_OF[a.dtype.newbyteorder("=").str[1:]]


def _three(a: np.ndarray) -> np.ndarray:
    return a[:, :, None] if a.ndim == 2 else a


# --- portable maps -----------------------------------------------------------------------------------------------

def ppm_decode(data: bytes) -> np.ndarray:
    magic = data[:2]
    want = {b"P1": 2, b"P4": 2, b"PF": 3, b"Pf": 3}.get(magic, 3)
    at, head = 2, []
    while len(head) < want:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)").match(data, at)
        head.append(m[1])
        at = m.end()
    w, h = int(head[0]), int(head[1])
    bands = 3 if magic in (b"P3", b"P6", b"PF") else 1
    if magic in (b"P1", b"P2", b"P3"):
        body = data[at:]
        digits = re.findall(rb"[01]", body) if magic == b"P1" else body.split()
        a = np.array([int(v) for v in digits[: w * h * bands]], np.int64).reshape(h, w, bands)
        return ((1 - a) * 255).astype(np.uint8) if magic == b"P1" else a.astype(np.uint8 if int(head[2]) < 256 else np.uint16)
    at += 1
    if magic == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
        return ((1 - bits) * 255).astype(np.uint8)[:, :, None]
    if magic in (b"PF", b"Pf"):
        scale = float(head[2])
        a = np.frombuffer(data, "<f4" if scale < 0 else ">f4", w * h * bands, at).reshape(h, w, bands)
        return (a[::-1] * abs(scale)).astype(np.float32)
    kind = np.dtype("u1" if int(head[2]) < 256 else ">u2")
    return np.frombuffer(data, kind, w * h * bands, at).reshape(h, w, bands).astype(kind.newbyteorder("="))


def ppm_encode(a: np.ndarray, ascii=False, bitdepth=8, **_) -> bytes:
    a = _three(a)
    h, w, bands = a.shape
    colour = bands >= 3
    a = a[:, :, :3] if colour else a[:, :, :1]
    if a.dtype.kind == "f":
        return b"%s\n%d %d\n-1.0\n" % (b"PF" if colour else b"Pf", w, h) + a[::-1].astype("<f4").tobytes()
    if bitdepth == 1:
        bits = (a[:, :, 0] < 128).astype(np.uint8)
        if ascii:
            return b"P1\n%d %d\n" % (w, h) + "\n".join(" ".join(map(str, r)) for r in bits.tolist()).encode() + b"\n"
        return b"P4\n%d %d\n" % (w, h) + np.packbits(bits, axis=1).tobytes()
    top = 65535 if a.dtype.itemsize > 1 else 255
    if ascii:
        return b"%s\n%d %d\n%d\n" % (b"P3" if colour else b"P2", w, h, top) + "\n".join(" ".join(map(str, r)) for r in a.reshape(h, -1).tolist()).encode() + b"\n"
    return b"%s\n%d %d\n%d\n" % (b"P6" if colour else b"P5", w, h, top) + a.astype(">u2" if top > 255 else "u1").tobytes()


# --- text formats ------------------------------------------------------------------------------------------------

def csv_decode(data: bytes, skip=0, lines=-1, whitespace=" ", separator=",;\t", **_) -> np.ndarray:
    rows = data.decode().splitlines()[skip:]
    rows = [r for r in (rows if lines < 0 else rows[:lines]) if r.strip()]
    split = re.compile("[" + re.escape(separator) + "]" + ("|[" + re.escape(whitespace) + "]+" if whitespace.strip() else ""))
    return np.array([[float(v.strip(whitespace + '"')) if v.strip(whitespace + '"') else 0.0 for v in split.split(r.strip())] for r in rows], np.float64)[:, :, None]


def csv_encode(a: np.ndarray, separator="\t", **_) -> bytes:
    return ("\n".join(separator.join(f"{v:.17g}" if a.dtype.kind == "f" else str(v) for v in r) for r in _three(a)[:, :, 0].tolist()) + "\n").encode()


def matrix_decode(data: bytes, **_) -> np.ndarray:
    """Header: width height [scale offset]; then rows of numbers."""
    head, *rows = [r for r in data.decode().splitlines() if r.strip()]
    w, h = (int(float(v)) for v in head.split()[:2])
    return np.array([float(v) for r in rows[:h] for v in re.split(r"[\s,;]+", r.strip())[:w]]).reshape(h, w, 1)


def matrix_header(data: bytes) -> tuple[float, float]:
    """(scale, offset) of a matrix file."""
    got = [float(v) for v in data.decode().split("\n", 1)[0].split()]
    return (got[2], got[3]) if len(got) >= 4 else (1.0, 0.0)


def matrix_encode(a: np.ndarray, scale=1.0, offset=0.0, **_) -> bytes:
    a = _three(a)
    head = f"{a.shape[1]} {a.shape[0]}" + (f" {scale:g} {offset:g}" if (scale, offset) != (1.0, 0.0) else "")
    return (head + "\n" + "\n".join(" ".join(f"{v:.17g}" for v in r) for r in a[:, :, 0].astype(float).tolist()) + "\n").encode()


# --- raw and native ----------------------------------------------------------------------------------------------

def raw_decode(data: bytes, width=0, height=0, bands=1, format="uchar", offset=0, **_) -> np.ndarray:
    height = height or (len(data) - offset) // (width * bands * np.dtype(DTYPES[format]).itemsize)
    return np.frombuffer(data, DTYPES[format], width * height * bands, offset).reshape(height, width, bands)


def raw_encode(a: np.ndarray, **_) -> bytes:
    return np.ascontiguousarray(_three(a)).tobytes()


# Fixed values of the native 64-byte header: magic numbers, format and interpretation codes.
NATIVE = {b"\x08\xf2\xa6\xb6": ">", b"\xb6\xa6\xf2\x08": "<"}
CODES = ["uchar", "char", "ushort", "short", "uint", "int", "float", "complex", "double", "dpcomplex"]


def native_decode(data: bytes, **_) -> np.ndarray:
    order = NATIVE[data[:4]]
    w, h, bands, _, code = struct.unpack(order + "5i", data[4:24])
    kind = np.dtype(DTYPES[CODES[code]]).newbyteorder(order)
    return np.frombuffer(data, kind, w * h * bands, 64).reshape(h, w, bands).astype(kind.newbyteorder("="))


def native_encode(a: np.ndarray, **_) -> bytes:
    a = _three(a)
    head = b"\xb6\xa6\xf2\x08" + struct.pack("<5i", a.shape[1], a.shape[0], a.shape[2], 0, CODES.index(format_of(a))) + struct.pack("<2i2f", 0, 0, 1.0, 1.0)
    return head.ljust(64, b"\0") + np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes()


# --- PNG ---------------------------------------------------------------------------------------------------------

def _unfilter(raw: np.ndarray, h: int, stride: int, bpp: int) -> np.ndarray:
    out = np.zeros((h, stride), np.uint8)
    before = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 2:
            line += before
        elif kind == 1:
            for k in range(bpp):
                line[k::bpp] = np.cumsum(line[k::bpp], dtype=np.uint8)
        elif kind:
            cur = bytearray(line.tobytes())
            for x in range(stride):
                a, b, c = (cur[x - bpp] if x >= bpp else 0), int(before[x]), (int(before[x - bpp]) if x >= bpp else 0)
                if kind == 3:
                    add = (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    add = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[x] = (cur[x] + add) & 255
            line = np.frombuffer(bytes(cur), np.uint8)
        out[y] = before = line
    return out


def png_decode(data: bytes, **_) -> np.ndarray:
    at, body, palette, alpha = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">2I5B", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(chunk, np.uint8)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
    if interlace:
        raise Unsupported("interlaced PNG")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride, bpp = (w * bands * depth + 7) // 8, max(1, bands * depth // 8)
    lines = _unfilter(np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, stride + 1), h, stride, bpp)
    if depth == 16:
        return lines.view(">u2").reshape(h, w, bands).astype(np.uint16)
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)
        lines = bits.dot(1 << np.arange(depth)[::-1]).astype(np.uint8)[:, : w * bands]
        if colour != 3:
            lines = lines * (255 // ((1 << depth) - 1))
    a = lines.reshape(h, w, bands)
    if palette is not None and colour == 3:
        out = palette[a[:, :, 0]]
        if alpha is not None:
            full = np.full(len(palette), 255, np.uint8)
            full[: len(alpha)] = alpha
            out = np.dstack([out, full[a[:, :, 0]]])
        return out
    return a


def png_encode(a: np.ndarray, compression=6, **_) -> bytes:
    a = _three(a)
    h, w, bands = a.shape
    depth = 16 if a.dtype.itemsize > 1 else 8
    lines = a.astype(">u2" if depth == 16 else "u1").reshape(h, -1).view(np.uint8)
    body = np.zeros((h, lines.shape[1] + 1), np.uint8)
    body[:, 0], body[:, 1:] = 2, lines
    body[1:, 1:] -= lines[:-1]

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">2I5B", w, h, depth, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body.tobytes(), compression)) + chunk(b"IEND", b"")


# --- others ------------------------------------------------------------------------------------------------------

def bmp_decode(data: bytes, **_) -> np.ndarray:
    start, = struct.unpack("<I", data[10:14])
    size, w, h, _, depth = struct.unpack("<IiiHH", data[14:30])
    bands, up = depth // 8, h > 0
    if depth not in (24, 32):
        raise Unsupported(f"{depth}-bit BMP")
    stride = (w * bands + 3) // 4 * 4
    a = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bands].reshape(abs(h), w, bands)
    a = a[::-1] if up else a
    return np.ascontiguousarray(a[:, :, [2, 1, 0, 3][:bands]])


def bmp_encode(a: np.ndarray, **_) -> bytes:
    a = _three(a)
    a = np.repeat(a[:, :, :1], 3, 2) if a.shape[2] < 3 else a[:, :, :3]
    h, w, _ = a.shape
    stride = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : w * 3] = a[::-1, :, ::-1].astype(np.uint8).reshape(h, -1)
    return b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def rad_decode(data: bytes, **_) -> np.ndarray:
    """Radiance RGBE to floats; new-style run lengths and flat scanlines."""
    head, _, rest = data.partition(b"\n\n")
    size, _, body = rest.partition(b"\n")
    _, h, _, w = size.split()
    w, h, at = int(w), int(h), 0
    out = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if 8 <= w < 32768 and body[at : at + 2] == b"\x02\x02" and body[at + 2] << 8 | body[at + 3] == w:
            at += 4
            for k in range(4):
                x = 0
                while x < w:
                    n = body[at]
                    if n > 128:
                        out[y, x : x + n - 128, k] = body[at + 1]
                        x, at = x + n - 128, at + 2
                    else:
                        out[y, x : x + n, k] = np.frombuffer(body, np.uint8, n, at + 1)
                        x, at = x + n, at + 1 + n
        else:
            out[y] = np.frombuffer(body, np.uint8, w * 4, at).reshape(w, 4)
            at += 4 * w
    scale = np.where(out[..., 3:] == 0, 0.0, np.ldexp(1.0, out[..., 3:].astype(int) - 136))
    return ((out[..., :3] + 0.5) * scale * (out[..., 3:] > 0)).astype(np.float32)


def rad_encode(a: np.ndarray, **_) -> bytes:
    a = _three(a)[:, :, :3].astype(np.float64)
    a = np.repeat(a, 3, 2) if a.shape[2] == 1 else a
    top = a.max(2)
    m, e = np.frexp(top)
    f = np.where(top > 1e-32, m * 256.0 / np.where(top > 1e-32, top, 1), 0)
    out = np.zeros((*top.shape, 4), np.uint8)
    out[..., :3] = np.maximum(a, 0) * f[..., None]
    out[..., 3] = np.where(top > 1e-32, e + 128, 0)
    return b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y %d +X %d\n" % top.shape + out.tobytes()


def fits_decode(data: bytes, **_) -> np.ndarray:
    cards, at = {}, 0
    while True:
        block = data[at : at + 2880].decode("ascii")
        at += 2880
        for k in range(0, 2880, 80):
            key, _, value = block[k : k + 80].partition("=")
            cards[key.strip()] = value.split("/")[0].strip()
        if "END" in cards:
            break
    dims = [int(cards[f"NAXIS{k}"]) for k in range(1, int(cards["NAXIS"]) + 1)] + [1, 1]
    kind = np.dtype({"8": "u1", "16": ">i2", "32": ">i4", "-32": ">f4", "-64": ">f8"}[cards["BITPIX"]])
    w, h, bands = dims[:3]
    a = np.frombuffer(data, kind, w * h * bands, at).reshape(bands, h, w)[:, ::-1]
    return np.ascontiguousarray(a.transpose(1, 2, 0)).astype(kind.newbyteorder("="))


def fits_encode(a: np.ndarray, **_) -> bytes:
    a = _three(a)
    h, w, bands = a.shape
    kind, bits = {"u1": ("u1", 8), "i2": (">i2", 16), "f4": (">f4", -32), "f8": (">f8", -64)}.get(a.dtype.str[1:], (">i4", 32))
    cards = [("SIMPLE", "T"), ("BITPIX", bits), ("NAXIS", 3), ("NAXIS1", w), ("NAXIS2", h), ("NAXIS3", bands)]
    head = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in cards) + "END".ljust(80)
    body = a[::-1].transpose(2, 0, 1).astype(kind).tobytes()
    return head.ljust(2880).encode() + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


# Pixel types of NIfTI by code; 128 is RGB.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 128: "u1", 256: "i1", 512: "u2", 768: "u4"}


def nifti_decode(data: bytes, **_) -> np.ndarray:
    """NIfTI-1, and NIfTI-2 with its 64-bit sizes."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    order = "<" if struct.unpack("<i", data[:4])[0] in (348, 540) else ">"
    if struct.unpack(order + "i", data[:4])[0] == 540:
        (code,), dim, (start,) = (struct.unpack_from(order + f, data, at) for f, at in (("h", 12), ("8q", 16), ("q", 168)))
    else:
        (code,), dim, (start,) = (struct.unpack_from(order + f, data, at) for f, at in (("h", 70), ("8h", 40), ("f", 108)))
    kind, bands = np.dtype(NIFTI_TYPES[code]).newbyteorder(order), 3 if code == 128 else 1
    w, h = dim[1], math.prod(max(1, d) for d in dim[2 : 1 + dim[0]])
    return np.frombuffer(data, kind, w * h * bands, int(start)).reshape(h, w, bands).astype(kind.newbyteorder("="))


def nifti_encode(a: np.ndarray, **_) -> bytes:
    """NIfTI-1; NIfTI-2 where a side is longer than its 16-bit sizes hold."""
    a = _three(a)
    code = next(k for k, v in NIFTI_TYPES.items() if v == a.dtype.str[1:])
    dim, bits = (2, a.shape[1], a.shape[0], 1, 1, 1, 1, 1), a.dtype.itemsize * 8
    if max(dim) > 32767:
        head = bytearray(544)
        struct.pack_into("<i8s2h8q", head, 0, 540, b"n+2\0\r\n\x1a\n", code, bits, *dim)
        struct.pack_into("<q", head, 168, 544)
    else:
        head = bytearray(352)
        struct.pack_into("<i", head, 0, 348)
        struct.pack_into("<8h", head, 40, *dim)
        struct.pack_into("<2h", head, 70, code, bits)
        struct.pack_into("<f", head, 108, 352.0)
        head[344:348] = b"n+1\0"
    return bytes(head) + np.ascontiguousarray(a[:, :, 0]).tobytes()


def analyze_decode(header: bytes, pixels: bytes) -> np.ndarray:
    """Two files: a 348-byte header and the pixels."""
    order = "<" if struct.unpack("<i", header[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", header[40:56])
    kind = np.dtype({2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8"}[struct.unpack(order + "h", header[70:72])[0]]).newbyteorder(order)
    w, h = dim[1], int(np.prod([max(1, d) for d in dim[2 : 1 + dim[0]]]))
    return np.frombuffer(pixels, kind, w * h).reshape(h, w, 1).astype(kind.newbyteorder("="))


def tiff_decode(data: bytes, page=0, **_) -> np.ndarray:
    """Strips or tiles, uncompressed, PackBits or deflate, with or without the horizontal predictor."""
    order = "<" if data[:2] == b"II" else ">"
    at, = struct.unpack(order + "I", data[4:8])
    for _ in range(page + 1):
        n, = struct.unpack(order + "H", data[at : at + 2])
        tags = {}
        for k in range(n):
            p = at + 2 + 12 * k
            tag, kind, count = struct.unpack(order + "HHI", data[p : p + 8])
            size, code = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 12: (8, "d"), 11: (4, "f")}.get(kind, (1, "B"))
            where = p + 8 if size * count <= 4 else struct.unpack(order + "I", data[p + 8 : p + 12])[0]
            tags[tag] = struct.unpack(order + code * count, data[where : where + size * count]) if kind != 2 else data[where : where + count]
        at, = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
    w, h, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    bits, sample, packed, predictor = tags.get(258, (1,))[0], tags.get(339, (1,))[0], tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[sample] + str(bits // 8)).newbyteorder(order)
    tiled = 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (w, min(h, tags.get(278, (h,))[0]))
    out = np.zeros((-(-h // th) * th, -(-w // tw) * tw, bands), kind.newbyteorder("="))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across = -(-w // tw)
    for k, (p, n) in enumerate(zip(places, sizes)):
        raw = data[p : p + n]
        if packed in (8, 32946):
            raw = zlib.decompress(raw)
        elif packed == 32773:
            raw = packbits(raw)
        elif packed != 1:
            raise Unsupported(f"TIFF compression {packed}")
        rows = th if tiled else len(raw) // (tw * bands * kind.itemsize)
        block = np.frombuffer(raw, kind, rows * tw * bands).reshape(rows, tw, bands).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        y, x = k // across * th, k % across * tw
        out[y : y + rows, x : x + tw] = block
    return np.ascontiguousarray(out[:h, :w])


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def tiff_encode(a: np.ndarray, compression="deflate", rows=64, **_) -> bytes:
    a = _three(a)
    h, w, bands = a.shape
    strips = [np.ascontiguousarray(a[y : y + rows]).astype(a.dtype.newbyteorder("<")).tobytes() for y in range(0, h, rows)]
    strips = [zlib.compress(s) for s in strips] if compression == "deflate" else strips
    at, places = 8, []
    for s in strips:
        places.append(at)
        at += len(s)
    sample = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    extra, tags = b"", []

    def tag(code, kind, *values):
        nonlocal extra
        raw = struct.pack("<" + {3: "H", 4: "I"}[kind] * len(values), *values)
        if len(raw) > 4:
            tags.append(struct.pack("<HHII", code, kind, len(values), at + len(extra)))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            tags.append(struct.pack("<HHI", code, kind, len(values)) + raw.ljust(4, b"\0"))

    tag(256, 4, w), tag(257, 4, h), tag(258, 3, *[a.dtype.itemsize * 8] * bands), tag(259, 3, 8 if compression == "deflate" else 1), tag(262, 3, 2 if bands >= 3 else 1)
    tag(273, 4, *places), tag(277, 3, bands), tag(278, 4, rows), tag(279, 4, *map(len, strips)), tag(284, 3, 1), tag(339, 3, *[sample] * bands)
    body = b"".join(strips) + extra
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(tags) + b"\0\0\0\0"


def gif_decode(data: bytes, page=0, **_) -> np.ndarray:
    """First (or given) frame of a GIF as RGB."""
    w, h, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, table = 13, None
    if flags & 128:
        n = 3 * (2 << (flags & 7))
        table, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    frame = 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        x, y, fw, fh, f = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        own = table
        if f & 128:
            n = 3 * (2 << (f & 7))
            own, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        low, at, packed = data[at], at + 1, b""
        while data[at]:
            packed += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        if frame == page:
            index = np.frombuffer(lzw_decode(packed, low)[: fw * fh], np.uint8).reshape(fh, fw)
            out = np.zeros((h, w, 3), np.uint8)
            out[y : y + fh, x : x + fw] = own[index]
            return out
        frame += 1
    raise ValueError("no such frame")


def lzw_decode(data: bytes, low: int) -> bytes:
    clear, end = 1 << low, (1 << low) + 1
    bits = int.from_bytes(data, "little")
    at, size, out, table, before = 0, low + 1, [], [], None
    reset = lambda: [bytes([k]) for k in range(clear)] + [b"", b""]
    while at + size <= 8 * len(data):
        code = bits >> at & ((1 << size) - 1) if len(data) < 4096 else int.from_bytes(data[at // 8 : at // 8 + 4], "little") >> at % 8 & ((1 << size) - 1)
        at += size
        if code == clear:
            table, size, before = reset(), low + 1, None
            continue
        if code == end:
            break
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before is not None and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        if len(table) == 1 << size and size < 12:
            size += 1
    return b"".join(out)


def gif_encode(a: np.ndarray, **_) -> bytes:
    """One frame in a 6 x 6 x 6 (or grey) palette, with clear codes often enough to keep code width fixed."""
    a = _three(a)
    h, w, bands = a.shape
    if bands < 3:
        palette, index = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1), a[:, :, 0]
    else:
        levels = np.arange(6) * 51
        palette = np.zeros((256, 3), np.uint8)
        palette[:216] = np.stack(np.meshgrid(levels, levels, levels, indexing="ij"), -1).reshape(-1, 3)
        q = (a[:, :, :3].astype(int) + 25) // 51
        index = q[..., 0] * 36 + q[..., 1] * 6 + q[..., 2]
    codes = []
    for k, v in enumerate(index.reshape(-1).tolist()):
        if k % 250 == 0:
            codes.append(256)
        codes.append(v)
    codes.append(257)
    bits = (np.array(codes)[:, None] >> np.arange(9) & 1).astype(np.uint8).reshape(-1)
    raw = np.packbits(bits, bitorder="little").tobytes()
    blocks = b"".join(bytes([len(raw[k : k + 255])]) + raw[k : k + 255] for k in range(0, len(raw), 255)) + b"\0"
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + palette.tobytes() + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b";"


# name: (content test, decoder, encoder, suffixes); in the order in which contents are tried.
CODECS = {
    "png": (lambda d: d[:8] == b"\x89PNG\r\n\x1a\n", png_decode, png_encode, (".png",)),
    "ppm": (lambda d: re.match(rb"P[1-6Ff]\s", d[:3]) is not None, ppm_decode, ppm_encode, (".ppm", ".pgm", ".pbm", ".pfm", ".pnm")),
    "native": (lambda d: d[:4] in NATIVE, native_decode, native_encode, (".v",)),
    "tiff": (lambda d: d[:4] in (b"II*\0", b"MM\0*"), tiff_decode, tiff_encode, (".tif", ".tiff")),
    "jpeg": (lambda d: d[:3] == b"\xff\xd8\xff", jpeg.decode, jpeg.encode, (".jpg", ".jpeg", ".jpe", ".jfif")),
    "gif": (lambda d: d[:4] == b"GIF8", gif_decode, gif_encode, (".gif",)),
    "rad": (lambda d: d[:2] == b"#?", rad_decode, rad_encode, (".hdr",)),
    "fits": (lambda d: d[:9] == b"SIMPLE  =", fits_decode, fits_encode, (".fits", ".fit")),
    "nifti": (lambda d: d[344:348] == b"n+1\0" or d[4:8] == b"n+2\0" or d[:2] == b"\x1f\x8b", nifti_decode, nifti_encode, (".nii", ".nii.gz")),
    "bmp": (lambda d: d[:2] == b"BM", bmp_decode, bmp_encode, (".bmp",)),
    "csv": (lambda d: False, csv_decode, csv_encode, (".csv",)),
    "matrix": (lambda d: False, matrix_decode, matrix_encode, (".mat",)),
    "raw": (lambda d: False, raw_decode, raw_encode, (".raw",)),
}


def find_load(data: bytes, name: str = "") -> str:
    """The codec of some bytes: by content first, then by the name's suffix."""
    for codec, (sniff, *_) in CODECS.items():
        if sniff(data):
            return codec
    for codec, magic in EXTERNAL.items():
        if magic and data.startswith(magic) and codec not in ("heif",):
            raise Unsupported(f"{codec} needs a codec library that is not part of this engine")
    return find_save(name)


def find_save(name: str) -> str:
    for codec, (*_, suffixes) in CODECS.items():
        if name.lower().endswith(suffixes):
            return codec
    raise Unsupported(f"no codec for {name!r}")
