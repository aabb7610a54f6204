"""Vectorised text handling on Arrow buffers, shared by the Python stages.

A column of texts is one byte buffer plus offsets; words are found, lower-cased and
hashed with a constant number of numpy passes over that buffer, so no Python object is
made per word.  Batches are cut into slices of bounded bytes (one longer text stands
alone), which bounds the memory of a Python worker.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20


def release():
    """Hands free memory of Arrow and the C heap back to the system: workers live on, and later stages reuse them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, column="text", max_bytes=SLICE_BYTES):
    """Cut record batches so that ``column`` holds at most ``max_bytes`` in each, or one row."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
        sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
        del batch, col
        release()


def buffer(array):
    """(bytes as uint8, offsets as int64 from 0) of a string or binary array; null is empty."""
    array = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def separators(*ranges):
    """Table of 256 booleans: which bytes separate words."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


SPACE = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def word_spans(data, offsets, sep=SPACE, fold=True):
    """Starts and ends of the words in the buffer, and each text's first word (n + 1 of them).

    Words never cross texts.  With ``NOT_ALNUM`` upper-case letters count as their lower
    case, so they are word bytes although the table calls them separators.
    """
    sep = sep.copy()
    if fold:
        sep[65:91] = sep[97:123]
    inside = ~sep[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = offsets[1:-1]
        before[cuts[cuts < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    stop = ~inside
    ends = np.empty(len(starts), np.int64)
    if len(starts):
        closing = np.flatnonzero(stop)
        nxt = np.searchsorted(closing, starts)
        ends = np.where(nxt < len(closing), closing[np.minimum(nxt, len(closing) - 1)] if len(closing) else len(inside), len(inside))
        text_end = offsets[np.searchsorted(offsets, starts, side="right")]
        ends = np.minimum(ends, text_end)
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h):
    """A 64-bit finaliser (wraps)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9FB21C651E98DF25)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Masks that keep the first 0 to 8 bytes of a little-endian symbol.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_SPAN = 64


def symbols(data):
    """The 8-byte little-endian symbol at every byte of the buffer; bytes past its end are 0."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


class Hasher:
    """64-bit hashes of byte spans of a buffer; with ``fold`` A-Z hash as a-z.

    Spans of up to ``LONG_SPAN`` bytes go through a finaliser symbol by symbol, all spans at
    once, starting from their size; longer ones through BLAKE2b.  Every step is a bijection of
    the state and none is linear, so that no family of texts collides by its form.
    """

    def __init__(self, fold=True):
        self.table = np.arange(256, dtype=np.uint8)
        if fold:
            self.table[65:91] = self.table[97:123]

    def many(self, data, starts, ends, block=BLOCK_BYTES):
        """Hashes of spans in order of their starts, over blocks of the buffer: a long text costs one block's memory."""
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(starts, low + block)))
            high = int(ends[at:to].max())
            out[at:to] = self._block(self.table[data[low:high]], starts[at:to] - low, ends[at:to] - low)
            at = to
        return out

    def _block(self, data, starts, ends):
        size = ends - starts
        view = symbols(data)
        out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
        for j in range(0, LONG_SPAN, 8):
            live = live[size[live] > j]
            if not len(live):
                break
            got = view[starts[live] + j] & MASKS[np.minimum(size[live] - j, 8)]
            out[live] = mix((out[live] ^ got) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(j + 1))
        for k in np.flatnonzero(size > LONG_SPAN).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].data, digest_size=8).digest(), "little")
        return out


def rolling(data, width):
    """Hash of the ``width``-byte string (8 at least) at every byte that starts one: halves are hashed, then joined by two."""
    h = symbols(data)[: len(data) - 7] * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(32)

    def join(a, b):
        out = a * np.uint64(0xD6E8FEB86659FD93)
        out += b
        out ^= out >> np.uint64(29)
        return out

    size = 8
    while size * 2 <= width:
        h = join(h[:-size], h[size:])
        size *= 2
    if width > size:
        h = join(h[: len(h) - (width - size)], h[width - size :])
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h


def word_hashes(data, offsets, hasher, sep=SPACE):
    """(hash of each word, starts, ends, first word of each text)."""
    starts, ends, first = word_spans(data, offsets, sep)
    return hasher.many(data, starts, ends), starts, ends, first


def ramp(counts):
    """0..c-1 for each count, concatenated."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(counts) - counts, counts)


def merge_spans(starts, ends):
    """Union of half-open spans as sorted, disjoint, non-touching spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    at = np.flatnonzero(new)
    return starts[at], np.r_[ends[at[1:] - 1], ends[-1]]
