"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of rows of one task.  Its words become symbols of the benchmark's own
vocabulary; words that no test phrase has end a run, and runs too short for any phrase are
left out, which loses no occurrence.  Over these runs stands an FM-index: the suffix array
by prefix doubling, the BWT in a wavelet matrix with rank directories, and every
``SAMPLE``-th suffix position.  All phrases are searched backward at once through the
wavelet ranks, their rows walk by LF steps to sampled positions, and hit words are merged
into removal spans.  Nothing is shuffled.

The test phrases are a stated query set: they are read in blocks of ``BLOCK_WORDS`` words
from a table whose size is checked, each block is broadcast and searched against all rows,
and the blocks' spans are merged per document.

Cases: null and empty texts have no words and no hits; an item with no words has no
window; an item of fewer than ten words is one window; repeated items count once each by
id; items with a null id are ignored; repeated document rows are searched alike; other
columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import apart, load
from .textbuf import NOT_ALNUM, Hasher, buffer, ramp, slices, word_hashes

WINDOW = 10
BLOCK_WORDS = 2_000_000
MAX_PHRASE_BYTES = 256 << 20
SAMPLE = 8
SHARD_BYTES = 6 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Phrases:
    """Windows of the test items as symbol rows (-1 pads on the left), and which items own them."""

    def __init__(self, items, window=WINDOW):
        hasher = Hasher()
        vocabulary: dict[bytes, int] = {}
        rows: dict[tuple, int] = {}
        self.owners: list[list[str]] = []
        for item, text in items:
            if item is None:
                continue
            ws = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            for at in range(max(1, len(ws) - window + 1)) if ws else ():
                k = rows.setdefault(tuple(ws[at : at + window]), len(rows))
                if k == len(self.owners):
                    self.owners.append([])
                if str(item) not in self.owners[k][-1:]:
                    self.owners[k].append(str(item))
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.full((len(rows), window), -1, np.int64)
        for k, r in enumerate(rows):
            self.rows[k, window - len(r) :] = r
        joined = b" ".join(vocabulary)
        data = np.frombuffer(joined, np.uint8)
        hashes = word_hashes(data, np.array([0, len(data)]), hasher, NOT_ALNUM)[0] if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.symbols = hashes[order], order
        self.shortest = int(self.lengths.min()) if len(rows) else 0
        self.sigma = len(vocabulary)

    def symbols_of(self, hashes):
        """Symbol of each word hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.symbols[at], -1)


def suffix_array(text):
    """Suffix order of an integer text by prefix doubling (vectorised)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        rank = fresh
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """Rank of a symbol before a position, for arrays of (symbol, position) at once."""

    def __init__(self, values, bits):
        self.bits, self.zeros, self.ranks = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            self.ranks.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(values) - int(self.ranks[-1][-1]))
            values = np.r_[values[~bit], values[bit]]

    def rank(self, symbol, at):
        lo = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ranks, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            r_lo, r_at = ones[lo], ones[at]
            lo = np.where(bit, zeros + r_lo, lo - r_lo)
            at = np.where(bit, zeros + r_at, at - r_at)
        return at - lo


class FMIndex:
    """Backward search and location over one shard; the text ends with the unique symbol 0."""

    def __init__(self, text, sample=SAMPLE):
        text = np.r_[text, 0].astype(np.int64)
        sa = suffix_array(text)
        self.bwt = text[sa - 1]
        counts = np.bincount(text)
        self.before = np.r_[0, np.cumsum(counts)]
        self.tree = WaveletMatrix(self.bwt, max(1, int(text.max()).bit_length()))
        marked = sa % sample == 0
        self.marked_rank = np.r_[0, np.cumsum(marked)]
        self.marked, self.positions = marked, sa[marked]
        self.n = len(text)

    def search(self, rows):
        """Row ranges [lo, hi) of the patterns; ``rows`` is padded with -1 on the left."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for col in range(rows.shape[1] - 1, -1, -1):
            c = rows[:, col]
            live = np.flatnonzero((c >= 0) & (lo < hi))
            known = c[live] < len(self.before) - 1
            hi[live[~known]] = lo[live[~known]]
            live = live[known]
            c = c[live]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows):
        """Text positions of the suffixes in these rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.marked[rows])
        while len(live):
            c = self.bwt[rows[live]]
            rows[live] = self.before[c] + self.tree.rank(c, rows[live])
            steps[live] += 1
            live = live[~self.marked[rows[live]]]
        return self.positions[self.marked_rank[rows]] + steps


def runs_of(symbols, first, shortest):
    """Kept word positions: maximal runs of known words within a text, of ``shortest`` words at least."""
    known = symbols >= 0
    cut = np.zeros(len(symbols) + 1, bool)
    cut[first] = True
    begin = np.flatnonzero(known & (cut[:-1] | ~np.r_[False, known[:-1]]))
    end = np.flatnonzero(known & (cut[1:] | ~np.r_[known[1:], False])) + 1
    long = end - begin >= shortest
    return begin[long], end[long]


def shard_hits(symbols, first, phrases):
    """(word position, length in words, phrase) of each occurrence in the shard."""
    begin, end = runs_of(symbols, first, phrases.shortest)
    none = np.zeros(0, np.int64)
    if not len(begin):
        return none, none, none
    size = end - begin
    words = np.repeat(begin, size) + ramp(size)
    # Symbols are shifted by 2: 0 ends the text, 1 stands between runs.
    text = np.insert(symbols[words] + 2, np.cumsum(size)[:-1], 1)
    where = np.insert(words, np.cumsum(size)[:-1], -1)
    index = FMIndex(text)
    lo, hi = index.search(np.where(phrases.rows >= 0, phrases.rows + 2, -1))
    count = hi - lo
    found = np.repeat(np.arange(len(count)), count)
    at = index.locate(np.repeat(lo, count) + ramp(count))
    return where[at], phrases.lengths[found], found


def phrase_blocks(items: DataFrame, item_col, text_col, max_bytes=MAX_PHRASE_BYTES, block_words=BLOCK_WORDS):
    """The test set in blocks; refuses one beyond ``max_bytes``, which belongs in several calls."""
    rows = items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    held = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if held > max_bytes:
        raise ValueError(f"test items hold {held} bytes, over {max_bytes}; search them in several calls")
    block, n = [], 0
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"]))
        n += len(r["t"] or "") // 5 + 1
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def find_passages(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window=WINDOW, keep_text=False) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (sorted array<string>), spans array<struct<start,end>> of
    bytes to remove[, cleaned string: the text without the spans]."""
    spark = docs.sparkSession
    blocks = [Phrases(b, window) for b in phrase_blocks(items, item_col, item_text_col)]
    blocks = [spark.sparkContext.broadcast(p) for p in blocks if len(p.rows)]

    def run(batches):
        hasher = Hasher()
        for b in slices(batches, "text", SHARD_BYTES):
            data, offsets = buffer(b.column(1))
            hashes, starts, ends, first = word_hashes(data, offsets, hasher, NOT_ALNUM)
            hit = np.zeros(len(hashes) + 1, np.int64)
            pairs = []
            for held in blocks:
                p = held.value
                at, size, found = shard_hits(p.symbols_of(hashes), first, p)
                np.add.at(hit, at, 1)
                np.add.at(hit, at + size, -1)
                doc = np.searchsorted(first, at, side="right") - 1
                key = np.unique(doc * len(p.rows) + found)
                pairs += [(int(k // len(p.rows)), p.owners[int(k % len(p.rows))]) for k in key]
            covered = np.cumsum(hit[:-1]) > 0
            n_hit = np.diff(np.r_[0, np.cumsum(covered)][first])
            owned = [set() for _ in range(b.num_rows)]
            for d, who in pairs:
                owned[d].update(who)
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            edge = np.zeros(len(covered) + 1, bool)
            edge[first] = True
            begin = np.flatnonzero(covered & (edge[:-1] | ~np.r_[False, covered[:-1]]))
            stop = np.flatnonzero(covered & (edge[1:] | ~np.r_[covered[1:], False]))
            for s, e in zip(begin, stop):
                d = int(np.searchsorted(first, s, side="right")) - 1
                spans[d].append({"start": int(starts[s] - offsets[d]), "end": int(ends[e] - offsets[d])})
            out = [b.column(0), pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()),
                   pa.array([sorted(x) for x in owned], pa.list_(pa.string())),
                   pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names = ["doc_id", "n_words", "n_hit", "items", "spans"]
            if keep_text:
                texts = b.column(1).to_pylist()
                for d, cut in enumerate(spans):
                    if cut:
                        raw, at, kept = texts[d].encode(), 0, []
                        for x in cut:
                            kept.append(raw[at : x["start"]])
                            at = x["end"]
                        texts[d] = b"".join([*kept, raw[at:]]).decode()
                out += [pa.array(texts, pa.string()), *b.columns[2:]]
                names += ["cleaned", *b.schema.names[2:]]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    rest = []
    if keep_text:
        others = [f for f in docs.schema if f.name not in (id_col, text_col)]
        schema += ", cleaned string" + "".join(f", x{k} {f.dataType.simpleString()}" for k, f in enumerate(others))
        rest = [F.col(f.name).alias(f"x{k}") for k, f in enumerate(others)]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *rest).mapInArrow(run, schema)
    if keep_text:
        out = out.withColumnsRenamed({f"x{k}": f.name for k, f in enumerate(others)})
    return out


def op8_decontamination(spark, sf_dir):
    found = find_passages(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark, docs, sf_dir):
    """Takes the hit spans out of the texts; rows and other columns stay, n_chars follows the text."""
    own, was = apart(docs)
    found = find_passages(own, load(spark, sf_dir, "benchmark"), keep_text=True)
    told = was | {"text": F.col("cleaned")} | ({"n_chars": F.char_length("cleaned").cast("long")} if "n_chars" in was else {})
    return found.select(*[told[c].alias(c) for c in docs.columns])
