"""Exact passage dedup with a sparse suffix array, sorted deep-shallow.

Removed is every byte under a ``length``-byte string that also starts anywhere else.
Sorting all suffixes of the corpus is not needed for that: each window of ``length`` bytes
has an anchor, the leftmost ``GRAM``-byte string of smallest hash inside it, which depends
on the window's bytes alone.  Equal windows have equal anchors at equal offsets, so windows
whose anchor's hash stands only once in the corpus are settled by a count.

For the rest, anchors come together by hash, each with the stretch of text that its windows
cover.  Two suffix arrays are built over the anchors: one of the suffixes that start there,
one of the prefixes that end there, read backwards.  Both are sorted deep-shallow: multikey
quicksort on 8-byte symbols to ``SHALLOW`` bytes, then a blind trie orders each group that
still has a common prefix.  With the LCPs of both arrays, a window of offset o recurs
exactly if another anchor is in the same LCP interval of depth ``length - o`` forwards and
of depth o backwards.

Equal stretches (by 128 bits of BLAKE2b) are one stretch with a count: all their windows
recur, and one of them goes into the sort for the others of its hash (a hash with a single
stretch needs no order).  Slices combine first, so that a passage in a third of all documents
reaches its partition once for each slice.

A gram of more than ``HOT_GRAM`` stretches - the edge of a very common passage, whose
surroundings all differ - is no group of one task: there the LCP intervals are named by what
they stand for, the 128-bit digest of each window, and windows recur by their digests' counts,
which are dealt by digest and combined before the exchange.

Spans are gathered by text, which bounds each group by its own text, and both joins with the
texts share one exchange.

Cases: null is an empty text; texts shorter than ``length`` lose nothing; equal texts (rows
that repeat included) of at least ``length`` bytes lose everything, and an empty table gives
none; null and repeated ids
are allowed; windows never cross texts; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window, functions as F

from .shared import discard, hot_keys, load, partitions, split_join, stored
from .textbuf import buffer, merge_spans, ramp, rolling, slices

LENGTH, GRAM, SHALLOW, CHUNK, WINDOWS, HOT_GRAM = 200, 64, 32, 60_000, 1 << 18, 500


def anchors(data, offsets, length=LENGTH, gram=GRAM, block=WINDOWS):
    """(hash, position, first window, number of windows, text) of each anchor, in order of position.

    The buffer is worked through in blocks of windows, so a long text costs one block's memory.
    """
    n, width = len(data), length - gram + 1
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    parts = []
    for lo in range(0, max(0, n - length + 1), block):
        seg = data[lo : lo + block + length - 1]
        grams = rolling(seg, gram)
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if width > step:
            low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
        where = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Windows of this block that lie within one text.
        first = np.clip(lo - offsets[:-1], 0, sizes)
        count = np.clip(lo + len(where) - offsets[:-1], 0, sizes) - first
        window = np.repeat(offsets[:-1] + first, count) + ramp(count)
        text = np.repeat(np.arange(len(sizes)), count)
        owner = where[window - lo]
        if len(owner):
            new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])
            parts.append((grams[owner[new]], owner[new] + lo, window[new], np.diff(np.r_[new, len(owner)]), text[new]))
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    h, pos, window, count, text = (np.concatenate(x) for x in zip(*parts))
    # An anchor whose windows lie on both sides of a block's edge is one anchor.
    new = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (text[1:] != text[:-1])])
    return h[new], pos[new], window[new], np.add.reduceat(count, new), text[new]


def shallow(keys, size):
    """Multikey quicksort on 8-byte symbols: (order, group of each place).

    All open segments are parted at once into less, equal and greater than their middle row's
    symbol; what is equal goes on with the next symbol, and segments of one row are done.
    """
    order = np.arange(size)
    start = np.zeros(size, np.int64)
    depth = np.zeros(size, np.int64)
    live = np.arange(size) if size > 1 else np.zeros(0, np.int64)
    while len(live):
        seg = start[live]
        head = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        count = np.diff(np.r_[head, len(seg)])
        own = keys[order[live], depth[live]]
        pivot = np.repeat(own[head + count // 2], count)
        part = (own > pivot).astype(np.int8) - (own < pivot)
        moved = np.lexsort((part, seg))
        order[live], part = order[live][moved], part[moved]
        fresh = np.r_[True, (seg[1:] != seg[:-1]) | (part[1:] != part[:-1])]
        start[live] = live[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        depth[live] += part == 0
        alone = fresh & np.r_[fresh[1:], True]
        live = live[~alone & (depth[live] < keys.shape[1])]
    return order, np.cumsum(np.r_[False, start[1:] != start[:-1]]) if size else start


def common(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Orders strings by branching bytes alone, with one full comparison for each insertion."""

    def __init__(self, strings):
        self.strings, self.root = strings, None

    def insert(self, k):
        s = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        other = self.strings[node[0]]
        if s == other:
            node.append(k)
            return
        lcp = common(s, other)
        up, node = None, self.root
        while isinstance(node, tuple) and node[0] < lcp:
            depth = node[0]
            up = (node[1], s[depth] if depth < len(s) else -1)
            node = node[1][up[1]]
        byte = s[lcp] if lcp < len(s) else -1
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][byte] = [k]
            return
        kept = other[lcp] if lcp < len(other) else -1
        fresh = (lcp, {kept: node, byte: [k]})
        if up is None:
            self.root = fresh
        else:
            up[0][up[1]] = fresh

    def ordered(self):
        """(string numbers in order, LCP of each with the one before; the first's is None)."""
        out, lcps, stack = [], [], [(self.root, None)]
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, tuple):
                depth, children = node
                keys = sorted(children)
                stack += [(children[c], depth) for c in reversed(keys[1:])]
                stack.append((children[keys[0]], lcp))
            else:
                out += node
                lcps += [lcp, *[len(self.strings[node[0]])] * (len(node) - 1)]
        return out, lcps


def suffix_order(strings, depth=SHALLOW):
    """(order, LCP of each place with the place before) of byte strings, sorted deep-shallow."""
    n = len(strings)
    flat = np.frombuffer(b"".join([s[:depth].ljust(depth, b"\0") for s in strings]), ">u8").reshape(n, depth // 8).astype(np.uint64)
    order, group = shallow(flat, n)
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    lcp = np.zeros(n, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            trie = BlindTrie(strings)
            for k in order[a:b].tolist():
                trie.insert(k)
            got, lcps = trie.ordered()
            order[a:b] = got
            lcp[a + 1 : b] = lcps[1:]
        if a:
            lcp[a] = common(strings[order[a - 1]][:depth], strings[order[a]][:depth])
    return order, lcp


def recurring(stretches, back, windows, times, length=LENGTH):
    """Windows that recur: (anchor number, window number within its stretch).  back: the anchor's offset in the
    stretch, which is that of its first window; times: how often the stretch itself stands."""
    n = len(stretches)
    fwd, fwd_lcp = suffix_order([s[b:] for s, b in zip(stretches, back.tolist())])
    bwd, bwd_lcp = suffix_order([s[:b][::-1] for s, b in zip(stretches, back.tolist())])
    one, two = [], []
    for o in range(int((back - windows + 1).min()), int(back.max()) + 1):
        rows = np.flatnonzero((back >= o) & (back - windows < o))
        if not len(rows):
            continue
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[fwd] = np.cumsum(fwd_lcp < length - o)
        left[bwd] = np.cumsum(bwd_lcp < o)
        key = right[rows] * (n + 1) + left[rows]
        order = np.argsort(key, kind="stable")
        got = key[order]
        same = got[1:] == got[:-1]
        hit = np.zeros(len(rows), bool)
        hit[order] = np.r_[False, same] | np.r_[same, False]
        rows = rows[hit | (times[rows] > 1)]
        one.append(rows)
        two.append(back[rows] - o)
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.int64),) * 2


def window_spans(text, first, length=LENGTH):
    """(text, start, end) of the union of windows that start at ``first``."""
    order = np.lexsort((first, text))
    text, first = text[order], first[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (first[1:] > first[:-1] + 1)]) if len(text) else np.zeros(0, np.int64)
    last = np.r_[new[1:] - 1, len(text) - 1] if len(new) else new
    return text[new], first[new], first[last] + length


SPAN = "k1 long, k2 long, start long, stop long"
STRETCH = "h long, stretch binary, back int, times int, windows int, w1 long, w2 long, k1 long, k2 long, at long, start long, stop long"


def digest(data, salt=b"") -> bytes:
    return hashlib.blake2b(data, digest_size=16, salt=salt).digest()


def stretch_digests(raw, first, windows, back, length):
    """128-bit digest of each anchor's stretch and of its place in it: (group numbers, two longs of each)."""
    got = [digest(raw[f : f + w - 1 + length], b.to_bytes(4, "little")) for f, w, b in zip(first.tolist(), windows.tolist(), back.tolist())]
    known: dict[bytes, int] = {}
    group = np.fromiter((known.setdefault(g, len(known)) for g in got), np.int64, len(got))
    return group, np.frombuffer(b"".join(got), np.int64).reshape(-1, 2)


def _marks(base: DataFrame, length) -> DataFrame:
    """(k1, k2, id, i, h, st, su, times, settled) of every row: its anchors, each stretch once for a slice.

    This is the combine before the exchange: whatever part of the documents holds a passage,
    a slice sends it once.  ``settled`` are the spans of stretches that stand twice in a slice.
    """

    def run(batches):
        for b in slices(batches, "text"):
            data, offsets = buffer(b.column(3))
            h, pos, first, windows, text = anchors(data, offsets, length)
            group, st = stretch_digests(data.data, first, windows, pos - first, length)
            begin = np.searchsorted(text, np.arange(b.num_rows + 1))
            index = np.arange(len(h)) - begin[text] if len(h) else first
            _, rep, count = np.unique(group, return_index=True, return_counts=True)
            twice = np.flatnonzero(count[group] > 1) if len(h) else first
            rep.sort()
            lists = lambda at, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(text[at], np.arange(b.num_rows + 1)).astype(np.int32)), pa.array(values))
            span = pa.StructArray.from_arrays([pa.array(first[twice] - offsets[text[twice]]), pa.array(first[twice] - offsets[text[twice]] + windows[twice] - 1 + length)], ["start", "stop"])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], lists(rep, index[rep].astype(np.int32)), lists(rep, h[rep].view(np.int64)), lists(rep, st[rep, 0]), lists(rep, st[rep, 1]), lists(rep, count[group[rep]].astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(text[twice], np.arange(b.num_rows + 1)).astype(np.int32)), span)],
                ["id", "k1", "k2", "i", "h", "st", "su", "times", "settled"])

    kind = base.schema["id"].dataType.simpleString()
    return base.select("id", "k1", "k2", "text").mapInArrow(run, f"id {kind}, k1 long, k2 long, i array<int>, h array<long>, st array<long>, su array<long>, times array<int>, settled array<struct<start:long,stop:long>>")


def _stretches(work: DataFrame, length) -> DataFrame:
    """What each text was asked for: spans of settled anchors, stretches that go into the sort, digests of the windows of hot grams."""

    def run(batches):
        for b in slices(batches, "text"):
            data, offsets = buffer(b.column(3))
            raw = data.tobytes()
            h, pos, first, windows, text = anchors(data, offsets, length)
            begin = np.searchsorted(text, np.arange(b.num_rows + 1))
            rows = []
            for d, (k1, k2, asked) in enumerate(zip(*[b.column(i).to_pylist() for i in range(3)])):
                base = int(offsets[d])
                for x in asked:
                    k = int(begin[d]) + x["i"]
                    f, n = int(first[k]), int(windows[k])
                    if x["settle"]:
                        rows.append((None, None, None, None, None, None, None, k1, k2, None, f - base, f - base + n - 1 + length))
                    if x["ship"] and not x["hot"]:
                        rows.append((int(h[k].view(np.int64)), raw[f : f + n - 1 + length], int(pos[k]) - f, x["times"], n, None, None, k1, k2, f - base, None, None))
                    elif x["ship"]:
                        for at in range(f, f + n):
                            w = digest(raw[at : at + length])
                            rows.append((None, None, None, x["times"], None, int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True), k1, k2, at - base, None, None))
            if rows:
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in STRETCH.split(", ")])

    return work.select("k1", "k2", "asked", "text").mapInArrow(run, STRETCH)


def _counted_spans(windows: DataFrame, length) -> DataFrame:
    """Spans of the windows (w1, w2, times, k1, k2, at) whose digest stands more than once.  A stretch that stands more than
    once was settled as a whole, so only those that stand once are told."""
    counts = windows.groupBy("w1", "w2").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1")
    counts = stored(counts, "window-counts")
    hot = hot_keys(counts, ["w1", "w2"], windows.count(), "rows")
    found = split_join(windows.where("times = 1").select("w1", "w2", "k1", "k2", "at"), counts.select("w1", "w2"), ["w1", "w2"], hot)
    return found.select("k1", "k2", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))


def _sorted_spans(stretches: DataFrame, length) -> DataFrame:
    """Spans of recurring windows; rows come sorted by h and whole groups are sorted together in chunks."""

    def spans(k1, k2, start, stop):
        return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["k1", "k2", "start", "stop"])

    def flush(held):
        _, s, back, times, windows, k1, k2, at = map(list, zip(*held))
        back, windows, times, at = np.array(back), np.array(windows), np.array(times), np.array(at, np.int64)
        rows, k = recurring(s, back, windows, times, length)
        # A stretch that stands more than once was settled as a whole where it stands.
        keep = times[rows] == 1
        rows, start, stop = window_spans(rows[keep], at[rows[keep]] + k[keep], length)
        return spans(np.array(k1, np.int64)[rows], np.array(k2, np.int64)[rows], start, stop)

    def run(batches):
        held: list = []
        for b in batches:
            for row in zip(*[b.column(k).to_pylist() for k in range(8)]):
                if len(held) >= CHUNK and held[-1][0] != row[0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    dealt = stretches.select("h", "stretch", "back", "times", "windows", "k1", "k2", "at").repartition(partitions(stretches.sparkSession), "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, SPAN)


def dedup_passages(docs: DataFrame, id_col="doc_id", text_col="text", length=LENGTH, keep_text=False) -> DataFrame:
    """Per row: id, n_bytes, spans array<struct<start,stop>> (maximal removed runs), kept_sha256[, kept binary]."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))
    marks = stored(_marks(base, length).withColumn("rid", F.monotonically_increasing_id()), "anchors")
    each = marks.select("rid", F.explode(F.arrays_zip("i", "h", "st", "su", "times")).alias("a")).select("rid", "a.*")
    # A gram that stands once has nothing to find; the others meet again by their stretches.
    grams = stored(each.groupBy("h").agg(F.min(F.struct("st", "su")).alias("lo"), F.max(F.struct("st", "su")).alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("h", "n", (F.col("lo") != F.col("hi")).alias("many")), "grams")
    total = marks.select(F.coalesce(F.sum(F.size("i")), F.lit(0))).first()[0]
    again = split_join(each, grams, ["h"], hot_keys(grams, ["h"], total))
    by_stretch = Window.partitionBy("h", "st", "su")
    seen = again.select("rid", "i", "times", "many", (F.col("n") > HOT_GRAM).alias("hot"), F.sum("times").over(by_stretch).alias("all"), F.row_number().over(by_stretch.orderBy("rid", "i")).alias("nth"))
    settle, ship = (F.col("all") > 1) & (F.col("times") == 1), F.col("many") & (F.col("nth") == 1)
    asked = seen.where(settle | ship).groupBy("rid").agg(F.collect_list(F.struct("i", settle.alias("settle"), ship.alias("ship"), "hot", F.least("all", F.lit(2)).cast("int").alias("times"))).alias("asked"))
    # Of equal texts one answers for all: its anchors are settled or shipped as those of any copy.
    asked = marks.select("rid", "k1", "k2", F.col("id").alias("of")).join(asked, "rid")
    asked = asked.groupBy("k1", "k2").agg(F.min_by(F.struct("of", "asked"), "rid").alias("p")).select("k1", "k2", "p.of", "p.asked")
    asked = stored(asked, "asked")
    # As a text the comparison is no join key, so the exchange below is by (k1, k2) and serves both joins.
    work = base.join(asked, ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("of")).cast("string") == "true")
    found = stored(_stretches(work, length), "stretches")
    discard(grams, asked)
    within = marks.select("k1", "k2", F.explode("settled").alias("s")).select("k1", "k2", "s.start", "s.stop")
    told = found.where("start is not null").select("k1", "k2", "start", "stop")
    spans = _sorted_spans(found.where("h is not null"), length).unionByName(told).unionByName(_counted_spans(found.where("w1 is not null"), length)).unionByName(within)
    known = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches):
        for b in slices(batches, "text"):
            out = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = t.encode()
                s, e = merge_spans(np.array([x["start"] for x in spans or ()], np.int64), np.array([x["stop"] for x in spans or ()], np.int64))
                kept, at = [], 0
                for x, y in zip(s.tolist(), e.tolist()):
                    kept.append(raw[at:x])
                    at = y
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), [{"start": x, "stop": y} for x, y in zip(s.tolist(), e.tolist())], hashlib.sha256(kept).hexdigest(), kept))
            n, spans, sha, kept = zip(*out)
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(spans, kinds), pa.array(sha), *([pa.array(kept, pa.binary())] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "spans", "kept_sha256", "kept"][: len(cols)])

    kind = base.schema["id"].dataType.simpleString()
    joined = base.join(known, ["k1", "k2"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept_sha256 string" + ", kept binary" * keep_text)


def op10_suffix_dedup(spark, sf_dir):
    found = dedup_passages(load(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
