"""Token counts by a separator scan of flat, unindexed token files.

A token file is ids of fixed width, little endian, with an end-of-document id after each
document and nothing else.  Files are cut into blocks of ``BLOCK_BYTES``; each block is
read at its offset and searched for the separator with one vectorised comparison.  A block
yields its closed documents, the tokens before its first separator and those after its
last; a prefix scan over the blocks' summaries (windows in block order within a file) gives
every block the open tokens and the number of documents before it, which stitches
documents that cross blocks.

``write_tokens`` makes such files from texts.  Each task attempt writes files of its own in
the shared folder and returns what it wrote; only committed attempts' rows are kept, so a
lost executor leaves an unnamed file and no wrong row.

Cases: null and empty texts are documents of no tokens; tokens after the last separator are
a last open document; an empty file has no documents; text that spells the separator is
ordinary text; repeated rows and null ids are counted row by row; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import load, new_path, partitions, stored
from .textbuf import slices

BLOCK_BYTES = 4 << 20
FILE_BYTES = 256 << 20
SEPARATOR = 50256


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, folder: str, id_col="doc_id", text_col="text", ranks: str | None = None, separator=SEPARATOR, width=2, file_bytes=FILE_BYTES) -> DataFrame:
    """Writes token files (ids of ``width`` bytes; the separator is no id of the vocabulary) under ``folder``; (file, ordinal, doc_id, file_bytes: the file's size so far)."""
    ranks = ranks or default_ranks()
    enc = encoder(ranks)
    if separator < enc.n_vocab:
        raise ValueError(f"{separator} is an id of the vocabulary and cannot end documents")
    if separator >= 1 << 8 * width:
        raise ValueError(f"{separator} does not fit {width} bytes")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc, (store, base) = encoder(ranks), filesystem(folder)
        store.create_dir(base, recursive=True)
        out, name, ordinal, size = None, "", 0, 0
        for b in slices(batches, "text", 1 << 20):
            if out is None or size >= file_bytes:
                if out is not None:
                    out.close()
                name, ordinal, size = f"{base}/{uuid.uuid4().hex}.bin", 0, 0
                out = store.open_output_stream(name)
            sizes = []
            for ids in enc.encode_ordinary_batch([t or "" for t in b.column(1).to_pylist()], num_threads=1):
                ids.append(separator)
                out.write(np.array(ids, f"<u{width}").tobytes())
                size += width * len(ids)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * b.num_rows), pa.array(range(ordinal, ordinal + b.num_rows), pa.int64()), b.column(0), pa.array(sizes, pa.int64())],
                ["file", "ordinal", "doc_id", "file_bytes"])
            ordinal += b.num_rows
        if out is not None:
            out.close()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"file string, ordinal long, doc_id {kind}, file_bytes long")


def scan_block(ids, separator):
    """(lengths of the documents closed within the block, tokens before the first separator, after the last)."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return at, 0, len(ids)
    return np.diff(at) - 1, int(at[0]), len(ids) - int(at[-1]) - 1


def count_tokens(files: DataFrame, folder: str, separator=SEPARATOR, width=2, block_bytes=BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in files(file, bytes); folder names their file system."""
    spark, block_bytes = files.sparkSession, block_bytes // width * width
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block_bytes).cast("long"))
    blocks = files.where("bytes > 0").select("file", "bytes", F.posexplode(starts).alias("block", "at"))
    blocks = blocks.repartition(partitions(spark), "file", "block")

    def run(batches):
        store, _ = filesystem(folder)
        for b in batches:
            for name, total, block, at in zip(*[c.to_pylist() for c in b.columns]):
                with store.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, total - at), at), f"<u{width}")
                inner, head, tail = scan_block(ids, separator)
                closed = bool((ids == separator).any())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int32()), pa.array([closed]), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([inner.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "closed", "head", "tail", "inner"])

    seen = stored(blocks.mapInArrow(run, "file string, block int, closed boolean, head long, tail long, inner array<long>"), "token-blocks")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # open: tokens of the open document at the block's start = all tails before, less those before the last closing block.
    scan = seen.select("file", "block", "closed", "tail", (F.size("inner") + 1).alias("n")).select(
        "file", "block", F.coalesce(F.sum(F.when(F.col("closed"), F.col("n")).otherwise(0)).over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("tails"), "closed", F.row_number().over(order.orderBy(F.desc("block"))).alias("from_end"))
    scan = scan.withColumn("open", F.col("tails") - F.coalesce(F.last(F.when(F.col("closed"), F.col("tails")), ignorenulls=True).over(before), F.lit(0)))
    joined = seen.join(scan.select("file", "block", "base", "open", "from_end"), ["file", "block"])
    lengths = F.when(F.col("closed"), F.concat(F.array(F.col("open") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    last = F.when(F.col("closed"), F.col("tail")).otherwise(F.col("open") + F.col("tail"))
    lengths = F.when((F.col("from_end") == 1) & (last > 0), F.concat(lengths, F.array(last))).otherwise(lengths)
    return joined.select("file", "base", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir):
    folder = new_path(spark, "tokens")
    names = stored(write_tokens(load(spark, sf_dir, "documents"), folder), "token-names")
    files = names.groupBy("file").agg(F.max("file_bytes").alias("bytes"))
    return names.join(count_tokens(files, folder), ["file", "ordinal"]).select("doc_id", "n_tokens")
