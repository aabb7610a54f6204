"""JPEG to and from arrays, in numpy.

``decode`` reads baseline, extended and progressive files of 8 bits with Huffman coding, restarts
and any sampling factors.  ``shrink`` of 2, 4 or 8 takes the low frequencies of each block
through an inverse transform of that many points fewer, so the full image never exists.  A
truncated file gives grey where data lack.  ``encode`` writes baseline files; symbols, code
lengths and bits are array operations.  Entropy decoding is a loop over symbols, the only part
that costs time for each of them.
"""

from __future__ import annotations

import struct

import numpy as np

from .errors import Unsupported


# Quantisation tables for luminance and chrominance at quality 50, by rows.
LUMA = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
        18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32

#: Row-major place of each zigzag position: diagonals, in turn downwards and upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def cosines(n: int) -> np.ndarray:
    """Orthonormal cosine basis of n points: frequency x sample."""
    k, x = np.arange(n)[:, None], np.arange(n)
    return (np.sqrt(np.where(k == 0, 1, 2) / n) * np.cos((2 * x + 1) * k * np.pi / (2 * n))).astype(np.float32)


# --- reading -----------------------------------------------------------------------------------------------------

def markers(data: bytes):
    """(marker, body, place after it) of each segment that has a body."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        code = data[at + 1]
        if code in (0xFF, 0x00, 0x01) or 0xD0 <= code <= 0xD8:
            at += 1 if code == 0xFF else 2
            continue
        if code == 0xD9:
            return
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield code, data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size


FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bands) without decoding."""
    for code, body, _ in markers(data):
        if code in FRAMES:
            h, w, n = struct.unpack(">HHB", body[1:6])
            return w, h, n
    raise Unsupported("JPEG without a frame")


def orientation(data: bytes) -> int:
    """The orientation tag of the camera's block, 1 where there is none."""
    for code, body, _ in markers(data):
        if code == 0xE1 and body[:6] == b"Exif\0\0" and len(body) >= 14:
            t = body[6:]
            o = "<" if t[:2] == b"II" else ">"
            first = struct.unpack(o + "I", t[4:8])[0]
            if first + 2 > len(t):
                return 1
            for k in range(struct.unpack(o + "H", t[first : first + 2])[0]):
                entry = t[first + 2 + 12 * k : first + 14 + 12 * k]
                if len(entry) == 12 and struct.unpack(o + "H", entry[:2])[0] == 0x112:
                    got = struct.unpack(o + "H", entry[8:10])[0]
                    return got if 1 <= got <= 8 else 1
    return 1


def upright(a: np.ndarray, way: int) -> np.ndarray:
    if way >= 5:
        a = a.transpose(1, 0, 2)
    if way in (3, 4, 7, 8):
        a = a[::-1]
    return a[:, ::-1] if way in (2, 3, 6, 7) else a


def lookup(counts, symbols) -> list[int]:
    """16 bits ahead -> length * 256 + symbol; 0 where no code begins so."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            table[code << 16 - size : code + 1 << 16 - size] = size << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table.tolist()


def words(raw: bytes) -> memoryview:
    """The 64 bits that begin at each byte."""
    b = np.frombuffer(raw + b"\0" * 16, np.uint8)
    out = np.zeros(len(b) - 8, np.uint64)
    for k in range(8):
        out |= b[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return memoryview(out)


class Component:
    def __init__(self, ident, h, v, table):
        self.ident, self.h, self.v, self.table = ident, h, v, table

    def shape(self, width, height, hmax, vmax):
        self.wide, self.high = -(-width * self.h // hmax), -(-height * self.v // vmax)
        self.cols, self.rows = -(-width // (8 * hmax)) * self.h, -(-height // (8 * vmax)) * self.v
        self.coefs = np.zeros((self.rows * self.cols, 64), np.int32)
        self.flat = memoryview(self.coefs.reshape(-1))


def order(comps: list[Component]) -> tuple[np.ndarray, list[int]]:
    """(first coefficient of each block by unit and place in it, component of each place)."""
    if len(comps) == 1:
        c = comps[0]
        rows, cols = -(-c.high // 8), -(-c.wide // 8)
        return (np.arange(rows)[:, None] * c.cols + np.arange(cols)).reshape(-1, 1) * 64, [0]
    down, across = comps[0].rows // comps[0].v, comps[0].cols // comps[0].h
    my, mx = (g.reshape(-1) for g in np.mgrid[:down, :across])
    places = [(k, v, h) for k, c in enumerate(comps) for v in range(c.v) for h in range(c.h)]
    return np.stack([((my * comps[k].v + v) * comps[k].cols + mx * comps[k].h + h) * 64 for k, v, h in places], 1), [k for k, _, _ in places]


def first_pass(W, p, flat, at, ac, k, end, low, run):
    """AC coefficients k..end at their first appearance; (place, blocks that still end here)."""
    if run:
        return p, run - 1
    while k <= end:
        w = W[p >> 3] >> 32 - (p & 7) & 0xFFFFFFFF
        e = ac[w >> 16]
        size, zeros, bits = e >> 8, e >> 4 & 15, e & 15
        if not size:
            raise IndexError
        if bits:
            k += zeros
            v = w >> 32 - size - bits & (1 << bits) - 1
            if k > 63:
                raise IndexError
            flat[at + k] = (v if v >> bits - 1 else v - (1 << bits) + 1) << low
            k += 1
            p += size + bits
        elif zeros == 15:
            k += 16
            p += size
        else:
            more = w >> 32 - size - zeros & (1 << zeros) - 1
            return p + size + zeros, (1 << zeros) + more - 1
    return p, 0


def refining_pass(W, p, flat, at, ac, k, end, low, run):
    """One more bit for AC coefficients k..end."""
    one, zeros, new = 1 << low, -1, 0

    def bit():
        nonlocal p
        p += 1
        return W[p - 1 >> 3] >> 63 - (p - 1 & 7) & 1

    def correct(i):
        if bit() and not abs(flat[i]) & one:
            flat[i] += one if flat[i] > 0 else -one

    while not run and k <= end:
        e = ac[W[p >> 3] >> 48 - (p & 7) & 0xFFFF]
        if not e:
            raise IndexError
        p += e >> 8
        zeros, new = e >> 4 & 15, 0
        if e & 15:
            new = one if bit() else -one
        elif zeros < 15:
            run = 1 << zeros
            for _ in range(zeros):
                run += bit() << zeros - 1 - _
            break
        while k <= end:
            if flat[at + k]:
                correct(at + k)
            elif zeros:
                zeros -= 1
            else:
                break
            k += 1
        if k <= end and new:
            flat[at + k] = new
        k += 1
    if run:
        for i in range(at + k, at + end + 1):
            if flat[i]:
                correct(i)
        run -= 1
    return p, run


def scan(raw: bytes, comps, dc, ac, start, end, high, low, restart):
    """Decodes one scan into the coefficients of its components; stops where data end or make no sense."""
    units, places = order(comps)
    step = restart or len(units)
    cuts = np.frombuffer(raw, np.uint8)
    cuts = np.flatnonzero((cuts[:-1] == 0xFF) & (cuts[1:] >= 0xD0) & (cuts[1:] <= 0xD7)) if restart else np.zeros(0, int)
    parts = [raw[a:b].replace(b"\xff\0", b"\xff") for a, b in zip([0, *(cuts + 2).tolist()], [*cuts.tolist(), len(raw)])]
    later = first_pass if not high else refining_pass
    for part, begin in zip(parts, range(0, len(units), step)):
        W, p, run, before = words(part), 0, 0, [0] * len(comps)
        try:
            for unit in units[begin : begin + step].tolist():
                for at, c in zip(unit, places):
                    flat = comps[c].flat
                    if start == 0:
                        if high:
                            flat[at] |= (W[p >> 3] >> 63 - (p & 7) & 1) << low
                            p += 1
                        else:
                            w = W[p >> 3] >> 32 - (p & 7) & 0xFFFFFFFF
                            e = dc[c][w >> 16]
                            size, bits = e >> 8, e & 255
                            if not size or bits > 16:
                                raise IndexError
                            if bits:
                                v = w >> 32 - size - bits & (1 << bits) - 1
                                before[c] += v if v >> bits - 1 else v - (1 << bits) + 1
                            flat[at] = before[c] << low
                            p += size + bits
                    if end:
                        p, run = later(W, p, flat, at, ac[c], max(start, 1), end, low, run)
        except IndexError:
            continue


def samples(c: Component, quant: np.ndarray, n: int) -> np.ndarray:
    """The component's samples with n points for each 8."""
    basis = cosines(n)
    out = np.empty((c.rows * n, c.cols * n), np.float32)
    for row in range(c.rows):
        block = np.zeros((c.cols, 64), np.float32)
        block[:, ZIGZAG] = c.coefs[row * c.cols : (row + 1) * c.cols] * quant
        low = block.reshape(-1, 8, 8)[:, :n, :n] * np.float32(n / 8)
        out[row * n : (row + 1) * n] = (basis.T @ low @ basis).transpose(1, 0, 2).reshape(n, -1)
    return np.clip(np.rint(out + 128), 0, 255)[: -(-c.high * n // 8), : -(-c.wide * n // 8)]


def doubled(a: np.ndarray, axis: int) -> np.ndarray:
    """Twice the samples along an axis, weights 3:1 towards the nearer one."""
    a = np.moveaxis(a, axis, 0)
    out = np.empty((2 * len(a), *a.shape[1:]), np.float32)
    out[0::2] = 0.75 * a + 0.25 * np.concatenate([a[:1], a[:-1]])
    out[1::2] = 0.75 * a + 0.25 * np.concatenate([a[1:], a[-1:]])
    return np.moveaxis(out, 0, axis)


def stretched(a: np.ndarray, axis: int, factor: int, size: int) -> np.ndarray:
    a = doubled(a, axis) if factor == 2 else np.repeat(a, factor, axis)
    return a[:size] if axis == 0 else a[:, :size]


def decode(data: bytes, shrink=1, autorotate=False, **_) -> np.ndarray:
    """Grey, RGB or CMYK samples, height x width x bands; sizes round up when shrunk."""
    if shrink not in (1, 2, 4, 8):
        raise ValueError("shrink is 1, 2, 4 or 8")
    quants, dcs, acs, comps, restart, adobe, jfif = {}, {}, {}, [], 0, None, False
    for code, body, after in markers(data):
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.float32)
                body = body[1 + size :]
        elif code == 0xC4:
            while body:
                total = sum(body[1:17])
                (acs if body[0] >> 4 else dcs)[body[0] & 15] = lookup(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif code == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif code == 0xE0 and body[:5] == b"JFIF\0":
            jfif = True
        elif code == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif code in FRAMES:
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if code not in (0xC0, 0xC1, 0xC2) or depth != 8 or not height:
                raise Unsupported(f"JPEG frame {code:#x} of {depth} bits")
            comps = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
            for c in comps:
                c.shape(width, height, hmax, vmax)
        elif code == 0xDA:
            chosen = [(next(c for c in comps if c.ident == body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            start, end, bits = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            stop = after
            while (stop := data.find(b"\xff", stop)) >= 0 and stop + 1 < len(data) and (data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7):
                stop += 2
            raw = data[after : stop if stop >= 0 else len(data)]
            scan(raw, [c for c, _ in chosen], [dcs.get(t >> 4) for _, t in chosen], [acs.get(t & 15) for _, t in chosen], start, end, bits >> 4, bits & 15, restart)
    if not comps:
        raise Unsupported("JPEG without a frame")
    width, height, n = -(-width // shrink), -(-height // shrink), 8 // shrink
    planes = []
    for c in comps:
        points, fx, fy = n, hmax // c.h, vmax // c.v
        if hmax % c.h or vmax % c.v:
            raise Unsupported("JPEG with fractional sampling")
        while points < 8 and fx % 2 == 0 and fy % 2 == 0:
            points, fx, fy = 2 * points, fx // 2, fy // 2
        a = samples(c, quants[c.table], points)
        a = stretched(stretched(a, 1, fx, width), 0, fy, height)
        planes.append(a)
    a = np.stack(planes, 2)
    coded = adobe != 0 if adobe is not None else jfif or [c.ident for c in comps] != [82, 71, 66]
    if len(comps) == 3 and coded or len(comps) == 4 and adobe == 2:
        y, cb, cr = a[:, :, 0], a[:, :, 1] - 128, a[:, :, 2] - 128
        a = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb, *([a[:, :, 3]] if len(comps) == 4 else [])], 2)
        if len(comps) == 4:
            a[:, :, :3] = 255 - a[:, :, :3]
    if len(comps) == 4 and adobe is not None:
        a = 255 - a
    a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    return upright(a, orientation(data)) if autorotate else a


# --- writing -----------------------------------------------------------------------------------------------------

def scaled(table, quality: int) -> np.ndarray:
    q = min(100, max(1, int(quality)))
    percent = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(table) * percent + 50) // 100, 1, 255)


def code_sizes(counts: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code of at most 16 bits in which no code is all ones, by symbol."""
    import heapq

    heap = [(int(n), [s]) for s, n in enumerate(counts) if n]
    heap = [(n, s, [s[0]]) for n, s in heap] + [(0, [256], [256])]
    depth = np.zeros(257, int)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        depth[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    per = np.bincount(depth, minlength=64)
    per[0] = 0
    for size in range(len(per) - 1, 16, -1):
        while per[size]:
            # Two codes leave this length: one takes their prefix, the other pairs with a shorter code one level down.
            short = max(k for k in range(size - 1) if per[k])
            for k, n in ((size, -2), (size - 1, 1), (short, -1), (short + 1, 2)):
                per[k] += n
    per[np.flatnonzero(per)[-1]] -= 1
    ranked = sorted((s for s in range(256) if counts[s]), key=lambda s: (depth[s], s))
    out = np.zeros(256, int)
    out[ranked] = np.repeat(np.arange(len(per)), per)[: len(ranked)]
    return out


def code_table(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(segment body, code, length) by symbol."""
    sizes = code_sizes(counts)
    ranked = sorted(np.flatnonzero(sizes).tolist(), key=lambda s: (sizes[s], s))
    codes, code, size = np.zeros(256, np.int64), 0, 0
    for s in ranked:
        code <<= int(sizes[s]) - size
        size = int(sizes[s])
        codes[s] = code
        code += 1
    return bytes(np.bincount(sizes[ranked], minlength=17)[1:17].tolist()) + bytes(ranked), codes, sizes


def quantised(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """rows x columns x 64 coefficients in zigzag order."""
    rows, cols = plane.shape[0] // 8, plane.shape[1] // 8
    basis = cosines(8)
    out = np.empty((rows, cols, 64), np.int32)
    for row in range(rows):
        block = plane[8 * row : 8 * row + 8].reshape(8, cols, 8).transpose(1, 0, 2) - np.float32(128)
        out[row] = np.rint((basis @ block @ basis.T).reshape(cols, 64) / table)[:, ZIGZAG]
    return out


def bit_size(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def symbols(blocks: np.ndarray, place: np.ndarray, table: int):
    """(sort key, table, symbol, extra bits, their number) for blocks in scan order at their places."""
    dc = np.diff(blocks[:, 0], prepend=0)
    size = bit_size(dc)
    parts = [(place * 256, 0, size, np.where(dc < 0, dc + (1 << size) - 1, dc), size)]
    b, k = np.nonzero(blocks[:, 1:])
    k += 1
    v = blocks[b, k]
    before = np.where(np.r_[True, b[1:] != b[:-1]], 0, np.r_[0, k[:-1]])[: len(b)]
    run, size = k - before - 1, bit_size(v)
    parts.append((place[b] * 256 + 2 * k + 1, 2, run % 16 << 4 | size, np.where(v < 0, v + (1 << size) - 1, v), size))
    far = np.repeat(np.arange(len(b)), run // 16)
    parts.append((place[b[far]] * 256 + 2 * k[far], 2, np.full(len(far), 0xF0), np.zeros(len(far), int), np.zeros(len(far), int)))
    last = np.zeros(len(blocks), int)
    last[b] = k
    short = np.flatnonzero(last < 63)
    parts.append((place[short] * 256 + 200, 2, np.zeros(len(short), int), np.zeros(len(short), int), np.zeros(len(short), int)))
    return [np.concatenate([np.broadcast_to(p[i] if i != 1 else p[1] + table, p[0].shape) for p in parts]).astype(np.int64) for i in range(5)]


def packed(values: np.ndarray, sizes: np.ndarray, step=1 << 18) -> bytes:
    """Bit strings one after another, ones to the next byte, zero bytes after each 255."""
    out, rest = [], np.zeros(0, np.uint8)
    for at in range(0, len(values), step):
        v, n = values[at : at + step], sizes[at : at + step]
        ends = np.cumsum(n)
        shift = np.repeat(ends, n) - np.arange(ends[-1]) - 1
        bits = np.r_[rest, (np.repeat(v, n) >> shift & 1).astype(np.uint8)]
        whole = len(bits) // 8 * 8
        out.append(np.packbits(bits[:whole]).tobytes())
        rest = bits[whole:]
    if len(rest):
        out.append(np.packbits(np.r_[rest, np.ones(8 - len(rest), np.uint8)]).tobytes())
    return b"".join(out).replace(b"\xff", b"\xff\0")


def segment(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def encode(a: np.ndarray, Q=75, subsample_mode="auto", interlace=False, **_) -> bytes:
    """A baseline file of grey (1 or 2 bands) or RGB samples; alpha goes.  Chroma is halved below quality 90 unless "off"."""
    if interlace:
        raise Unsupported("writing progressive JPEG")
    a = a[:, :, None] if a.ndim == 2 else a
    if a.dtype != np.uint8:
        a = np.clip(np.rint(a), 0, 255).astype(np.uint8)
    height, width, bands = a.shape
    colour = bands >= 3
    half = colour and (subsample_mode == "on" or subsample_mode == "auto" and Q < 90)
    f = 2 if half else 1
    a = np.pad(a[:, :, : 3 if colour else 1], ((0, -height % (8 * f)), (0, -width % (8 * f)), (0, 0)), "edge").astype(np.float32)
    planes = [a[:, :, 0]]
    if colour:
        r, g, b = a[:, :, 0], a[:, :, 1], a[:, :, 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128]
        planes[1:] = [p.reshape(p.shape[0] // f, f, p.shape[1] // f, f).mean((1, 3)) for p in planes[1:]]
    tables = [scaled(LUMA, Q), scaled(CHROMA, Q)][: 2 if colour else 1]
    units = (a.shape[0] // (8 * f), a.shape[1] // (8 * f))
    each = f * f + 2 if colour else 1
    emitted = []
    for c, plane in enumerate(planes):
        n = f if c == 0 else 1
        blocks = quantised(plane, tables[min(c, 1)]).reshape(units[0], n, units[1], n, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
        place = (np.arange(units[0] * units[1])[:, None] * each + np.arange(n * n) + (0 if c == 0 else f * f + c - 1)).reshape(-1)
        emitted.append(symbols(blocks, place, min(c, 1)))
    key, table, symbol, extra, size = (np.concatenate(x) for x in zip(*emitted))
    turn = np.argsort(key, kind="stable")
    table, symbol, extra, size = table[turn], symbol[turn], extra[turn], size[turn]
    codes, lengths, heads = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64), b""
    for t in sorted(set(table.tolist())):
        body, codes[t], lengths[t] = code_table(np.bincount(symbol[table == t], minlength=256))
        heads += segment(0xC4, bytes([t >> 1 << 4 | t & 1]) + body)
    bits = packed(codes[table, symbol] << size | extra, lengths[table, symbol] + size)
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for k, q in enumerate(tables):
        out += segment(0xDB, bytes([k]) + bytes(q[ZIGZAG].tolist()))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([c + 1, f << 4 | f if c == 0 else 0x11, min(c, 1)]) for c in range(len(planes))))
    out += heads + segment(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(len(planes))) + b"\0\x3f\0")
    return out + bits + b"\xff\xd9"
