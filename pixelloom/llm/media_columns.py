"""Media columns: interleaved document sequences.

HTML is parsed into one ordered array of items for each page: text blocks, and media
references with their captions and alternative texts.  References are digests
(``media:sha256:<hex>``); payloads live in a media store keyed by digest, and a digest join
resolves them.  Positions are the items' indexes, so sequences rebuilt after the join are
aligned with their captions whatever the join's order.

Bytes never pass through the join: each stored payload is read back where it lies, and what
is joined is one small row of features for each digest.  A payload that a third of all
documents share is one row there, and the items that refer to it are dealt to several
partitions.

The query makes a page of each document, its lines as paragraphs around a figure that refers
to the document's payload, so that texts and media are interleaved; ``parse`` takes any HTML.

The stored form of 8-bit payloads is a binary grey map (PGM) of 64 samples a line.

Cases: null or empty HTML has an empty sequence; references without a known digest stay in
place with null features; a null text is an empty payload of one line of zeros; equal texts
have equal digests; repeated rows keep their own sequences; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import hot_keys, load, new_path, passing, split_join, stored
from .textbuf import slices

LINE = 64
PREFIX = "media:sha256:"
# Elements that refer to media, and those that end a text block.
MEDIA = {"img", "video", "audio", "source", "embed", "object"}
BLOCKS = {"p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "hr", "blockquote", "pre", "figure", "figcaption", "body", "header", "footer", "nav", "main", "title"}
SKIPPED = {"script", "style", "template", "noscript"}
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string,alt:string>"


class Sequence(HTMLParser):
    """Collects a page's items in document order.

    A caption ends at its end tag, and where that is missing at the end of its figure, at the next
    block or media element, or with the page.  What an unclosed noscript or template holds counts
    as text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.skipped, self.figures, self.caption = [], [], [], [], None

    def block(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None, "alt": None})

    def end_caption(self):
        if self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if self.figures and text:
                self.figures[-1].append(text)

    def end_figure(self):
        self.end_caption()
        got = self.figures.pop()
        text = next((x for x in got if isinstance(x, str)), None)
        for k in got:
            if not isinstance(k, str):
                self.items[k]["caption"] = text

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipped.append((tag, []))
        elif tag in BLOCKS or tag in MEDIA:
            self.end_caption()
            self.block()
        if tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self.caption = [] if self.figures else None
        elif tag in MEDIA:
            held = dict(attrs)
            ref = held.get("src") or held.get("data")
            if ref:
                self.items.append({"kind": "media", "text": None, "ref": ref, "caption": None, "alt": held.get("alt")})
                if self.figures:
                    self.figures[-1].append(len(self.items) - 1)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            if any(tag == t for t, _ in self.skipped):
                while self.skipped.pop()[0] != tag:
                    pass
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        if tag in BLOCKS:
            self.block()

    def handle_data(self, data):
        if self.skipped:
            self.skipped[-1][1].append(data)
        else:
            (self.words if self.caption is None else self.caption).append(data)

    def finish(self):
        self.close()
        while self.figures:
            self.end_figure()
        for tag, held in self.skipped:
            if tag in ("noscript", "template"):
                self.words.append(" " + " ".join(held))
        self.block()
        return [{"position": k, **x} for k, x in enumerate(self.items)]


def sequence_of(html: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(html or "")
    return parser.finish()


def parse(pages: DataFrame, html_col="html", id_col="page_id") -> DataFrame:
    """(id, items array<struct<position,kind,text,ref,caption,alt>>) of every row."""
    kind = pages.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("position", pa.int32()), *[(c, pa.string()) for c in ("kind", "text", "ref", "caption", "alt")]]))

    def run(batches):
        for b in slices(batches, "html", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence_of(h) for h in b.column(1).to_pylist()], item)], ["id", "items"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, items array<{ITEM}>")


def to_media(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (LINE, len(payload) // LINE) + payload


def from_media(media: bytes) -> bytes:
    """The samples of a binary grey map; raises if sizes disagree."""
    magic, width, height, depth = (head := media.split(b"\n", 3))[0], *head[1].split(), head[2]
    samples = head[3]
    if magic != b"P5" or depth != b"255" or len(samples) != int(width) * int(height):
        raise ValueError("not a stored payload")
    return samples


def store_texts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Writes every text as media to the shared store and reads it back: (doc_id, n_bytes, digest, media)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "text"):
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            media = [to_media(x + b"\0" * (max(LINE, -len(x) % LINE + len(x)) - len(x))) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "digest", "media"])

    path = new_path(docs.sparkSession, "media-store")
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, digest string, media binary")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(passing(docs.sparkSession, path))


def measure(store: DataFrame) -> DataFrame:
    """One row for each digest: what reading the stored bytes back gives."""

    def run(batches):
        for b in slices(batches, "media"):
            rows, seen = [], set()
            for digest, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if media is None or digest in seen:
                    continue
                seen.add(digest)
                payload = from_media(media)
                x = np.frombuffer(payload, np.uint8)
                feature = f"{LINE}x{len(x) // LINE}:{x.mean():.4f}:{x.std():.4f}:{int(x.max())}:{len(np.unique(x))}"
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    out = store.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.dropDuplicates(["digest"])


def resolve(sequences: DataFrame, measured: DataFrame, media_only=False) -> DataFrame:
    """One row for each item: (id, n_items, position, kind, text, ref, caption, alt) and the features of its media, or nulls.

    Text items and references that are no digests meet in no join key; items of hot digests are dealt to several partitions.
    """
    items = sequences.select("id", F.size("items").cast("long").alias("n_items"), F.explode("items").alias("i")).select("id", "n_items", "i.*")
    if media_only:
        items = items.where("kind = 'media'")
    digest = F.when(F.col("kind") == "media", F.when(F.col("ref").startswith(PREFIX), F.substring("ref", len(PREFIX) + 1, 64)))
    items = stored(items.withColumn("digest", digest), "media-items")
    counts = items.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return split_join(items, measured, ["digest"], hot_keys(counts, ["digest"], items.count()), "left")


def pages_of(store: DataFrame) -> DataFrame:
    """(doc_id, html) of stored texts: each text's lines as paragraphs, and in their midst a figure that refers to its payload."""
    padded = F.greatest(F.lit(LINE), F.ceil(F.col("n_bytes") / LINE) * LINE).cast("int")
    payload = F.expr("substring(media, length(media) - padded + 1, int(n_bytes))")
    text = F.decode(payload, "UTF-8")
    for was, now in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(was), F.lit(now))
    figure = F.format_string(f'<figure><img src="{PREFIX}%s" alt="%d"><figcaption>document %s</figcaption></figure>', F.col("digest"), F.col("n_bytes"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    held = store.withColumn("padded", padded).select("doc_id", figure.alias("figure"), F.split(text, "\n").alias("lines"))
    half = F.ceil(F.size("lines") / 2).cast("int")
    told = lambda x: F.concat(F.lit("<p>"), F.array_join(x, "</p><p>"), F.lit("</p>"))
    return held.select("doc_id", F.concat(told(F.slice("lines", F.lit(1), half)), "figure", told(F.slice("lines", half + 1, F.size("lines")))).alias("html"))


def op5_media_columns(spark, sf_dir):
    store = store_texts(load(spark, sf_dir, "documents"))
    found = resolve(parse(pages_of(store), "html", "doc_id"), measure(store), media_only=True)
    return found.select(F.col("id").alias("doc_id"), F.col("alt").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_items", "position", "caption")
