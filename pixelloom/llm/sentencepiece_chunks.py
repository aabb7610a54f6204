"""SentencePiece encoding and decoding through a distinct-chunk table.

The normalised text is a row of chunks: a run of whitespace markers and the characters up
to the next marker.  If no piece has a marker after another character, no merge crosses a
chunk's start, so each distinct chunk is segmented once and its ids are joined back at
every position where the chunk stands.  The table lives in the task (a global one would
shuffle every word occurrence) and is emptied at ``TABLE_ENTRIES``, which bounds memory
without changing results.  Models whose pieces cross markers, or that normalise text, are
encoded text by text with the library.

Cases: null text counts as empty; an empty text has no ids and decodes to an empty text;
null or repeated ids pass through; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import load
from .textbuf import slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_ENTRIES = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunkable(sp) -> bool:
    """Whether chunks can be segmented alone: identity normalisation, dummy prefix, no crossing piece."""
    if any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        return False
    if sp.is_unknown(sp.piece_to_id(MARK)):
        return False
    probe = "  a  éｆ b\t\n "
    return sp.decode(sp.encode(probe)) == probe and sp.id_to_piece(sp.encode("a"))[0].startswith(MARK)


class ChunkTable:
    """Distinct chunk -> ids.  A chunk's key is the chunk without its first marker."""

    def __init__(self, model: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.chunked = chunkable(self.sp)
        self.lone = [self.sp.piece_to_id(MARK)]
        self.entries = entries
        self.clear()

    @staticmethod
    def keys(text: str) -> list[str]:
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]

    def _add(self, keys: list[str]) -> None:
        rows = [ids if key else self.lone for key, ids in zip(keys, self.sp.encode(keys, num_threads=1))]
        self.table.update(zip(keys, range(len(self.table), len(self.table) + len(keys))))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))]
        self.begins = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        if not self.chunked:
            rows = self.sp.encode(texts, num_threads=1)
            ids = np.fromiter(chain.from_iterable(rows), np.int32)
            return ids, np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)]
        rows = [self.keys(t) for t in texts]
        if len(self.table) > self.entries:
            self.clear()
        missing = list(set().union(*rows).difference(self.table))
        if missing:
            self._add(missing)
        words = np.fromiter(map(len, rows), np.int64, len(rows))
        codes = np.fromiter(map(self.table.__getitem__, chain.from_iterable(rows)), np.int64, int(words.sum()))
        sizes = self.sizes[codes]
        total = np.r_[0, np.cumsum(sizes)]
        ids = self.flat[np.repeat(self.begins[codes] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[np.r_[0, np.cumsum(words)]]

    def clear(self) -> None:
        self.table = {}
        self.sizes, self.begins, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def decode(self, rows: list[list[int]]) -> list[str]:
        return self.sp.decode(rows, num_threads=1) if rows else []


def encode_documents(docs: DataFrame, text_col="text", id_col="doc_id", model: str | None = None, decode=False) -> DataFrame:
    """(id, ids array<int>[, decoded string]) of every row; one narrow pass, no shuffle."""
    model = model or default_model()

    def run(batches):
        table = ChunkTable(model)
        for b in slices(batches, "text", 1 << 20):
            ids, at = table.encode([t or "" for t in b.column(1).to_pylist()])
            out = [b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
            if decode:
                rows = [x.tolist() for x in np.split(ids, at[1:-1])]
                out.append(pa.array(table.decode(rows), pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", decoded string" * decode
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ids_col="ids", id_col="doc_id", model: str | None = None) -> DataFrame:
    """(id, decoded string) from arrays of ids, with the library's decode(); null decodes to an empty text."""
    model = model or default_model()

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = [x or [] for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sp.decode(ids, num_threads=1) if ids else [], pa.string())], ["doc_id", "decoded"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_sentencepiece(spark, sf_dir):
    return digests(encode_documents(load(spark, sf_dir, "documents"), decode=True))


def stage(spark, docs, sf_dir):
    """The last stage: digests of the ids and of the decoded text of every row; null text counts as empty."""
    return digests(encode_documents(docs, decode=True))
