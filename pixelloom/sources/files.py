"""Loading and saving images with Spark.

``load`` reads files as binary rows (any Hadoop file system), decodes each in a narrow pass
and gives a pixel relation keyed by ``img``; ``headers`` gives one row for each file without
pixels.  ``save`` encodes each image of a stack in one task and writes it beside the others
through the file system of the target folder.  ``PixelSource`` is the same as a Python data
source: ``spark.read.format("pixels")``.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..raster import STORAGE, Raster, common_format
from . import codecs

ROWS = 1 << 16


def pixel_table(a: np.ndarray, bands: int) -> pa.Table:
    h, w, _ = a.shape
    y, x = np.divmod(np.arange(h * w, dtype=np.int64), w)
    flat = a.reshape(-1, a.shape[2])
    cols = {"x": x.astype(np.int32), "y": y.astype(np.int32)} | {f"b{k}": flat[:, min(k, flat.shape[1] - 1)].astype(np.float64) for k in range(bands)}
    return pa.table(cols)


def binaries(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def headers(spark: SparkSession, path, loader: str | None = None, **options) -> DataFrame:
    """(img, loader, width, height, bands, format) of each file."""

    def run(batches):
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codec = loader or codecs.find_load(data, name)
                if codec == "jpeg" and not options.get("autorotate"):
                    w, h, n = codecs.jpeg.header(data)
                    shrink = options.get("shrink", 1)
                    rows.append((name, codec, -(-w // shrink), -(-h // shrink), n, "uchar"))
                    continue
                a = codecs.CODECS[codec][1](data, **options)
                rows.append((name, codec, a.shape[1], a.shape[0], a.shape[2], codecs.format_of(a)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()])], ["img", "loader", "width", "height", "bands", "format"])

    return binaries(spark, path).select("path", "content").mapInArrow(run, "img string, loader string, width int, height int, bands int, format string")


def load(spark: SparkSession, path, loader: str | None = None, **options) -> Raster:
    """A stack of equally shaped images; the header comes from a pass that returns one row a file.

    Files of different sizes or numbers of bands are refused; different formats meet in their common format.
    """
    shapes = headers(spark, path, loader, **options).groupBy("width", "height", "bands", "format").count().limit(100).collect()
    if len({(s["width"], s["height"], s["bands"]) for s in shapes}) != 1:
        raise ValueError(f"{path} holds {'no image' if not shapes else 'images of several shapes: load each shape alone'}")
    (width, height, bands), fmt = shapes[0][:3], functools.reduce(common_format, sorted({s["format"] for s in shapes}))

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codec = loader or codecs.find_load(data, name)
                table = pixel_table(codecs.CODECS[codec][1](data, **options), bands)
                for part in table.to_batches(ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows), *part.columns], ["img", *part.schema.names])

    schema = "img string, x int, y int" + "".join(f", b{k} double" for k in range(bands))
    df = binaries(spark, path).select("path", "content").mapInArrow(run, schema)
    cast = [F.col(f"b{k}").cast(STORAGE[fmt]).alias(f"b{k}") for k in range(bands)]
    return Raster(df.select("img", "x", "y", *cast), width, height, bands, fmt, "srgb" if bands >= 3 else "b_w", ("img",))


def thumbnail(spark: SparkSession, path, width: int, height: int | None = None, size="both", crop="none", **options) -> Raster:
    """Thumbnails of equally shaped files; JPEG is shrunk by 2, 4 or 8 while it is decoded, the rest is resampled.

    The shrink never goes below the target, so the last step always reduces.
    """
    from ..operators import resample

    found = headers(spark, path, **options).select("loader", "width", "height").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} holds {'no image' if not found else 'images of several shapes or formats: load each alone'}")
    one = found[0]
    fx, fy = one["width"] / width, one["height"] / (height or width)
    whole = min(fx, fy) if crop != "none" or size == "force" else max(fx, fy)
    shrink = next(k for k in (8, 4, 2, 1) if k <= max(whole, 1)) if one["loader"] == "jpeg" and size != "up" else 1
    r = load(spark, path, **({**options, "shrink": shrink} if shrink > 1 else options))
    return resample.thumbnail(r, width, height, size, crop)


def save(r: Raster, folder: str, codec: str, **options) -> DataFrame:
    """Writes one file for each image; (img, file, bytes).  Images are whole in one task, as their encoders need."""
    suffix = {"ppm": ".ppm" if r.bands >= 3 else ".pgm"}.get(codec, codecs.CODECS[codec][3][0])
    keys, w, h, bands, dtype = list(r.keys), r.width, r.height, r.bands, codecs.DTYPES[r.format]
    encode = codecs.CODECS[codec][2]

    def one(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        a = np.zeros((h, w, bands), dtype)
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        for k in range(bands):
            a[y, x, k] = table[f"b{k}"].to_numpy()
        data = encode(a, **options)
        store, base = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(base, recursive=True)
        img = "/".join(str(table[k][0].as_py()) for k in keys) if keys else "image"
        # The digest of the whole key keeps apart what has one base name.
        apart = f"-{hashlib.md5(img.encode()).hexdigest()[:8]}" if "/" in img else ""
        name = f"{base}/{img.rstrip('/').rsplit('/', 1)[-1]}{apart}{suffix}"
        with store.open_output_stream(name) as f:
            f.write(data)
        return pa.table({"img": [img], "file": [name], "bytes": pa.array([len(data)], pa.int64())})

    df = r.df if keys else r.df.withColumn("_image", F.lit(1))
    return df.groupBy(*(keys or ["_image"])).applyInArrow(one, "img string, file string, bytes long")


class PixelSource(DataSource):
    """``spark.read.format("pixels").option("path", file).load()``: pixels of image files on a path that workers share."""

    @classmethod
    def name(cls):
        return "pixels"

    def schema(self):
        return "img string, x int, y int, band int, v double"

    def reader(self, schema):
        return PixelReader(self.options)


class PixelReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        from pyarrow import fs

        path = self.options["path"]
        store, base = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        info = store.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base))
        return [InputPartition(f.path) for f in found if f.type == fs.FileType.File]

    def read(self, partition):
        from pyarrow import fs

        path = self.options["path"]
        store, _ = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        with store.open_input_file(partition.value) as f:
            data = f.read()
        a = codecs.CODECS[self.options.get("loader") or codecs.find_load(data, partition.value)][1](data)
        h, w, bands = a.shape
        y, x = np.divmod(np.arange(h * w), w)
        for k in range(bands):
            yield pa.RecordBatch.from_arrays([pa.array([partition.value] * (h * w)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(np.full(h * w, k, np.int32)), pa.array(a[:, :, k].reshape(-1).astype(float))], ["img", "x", "y", "band", "v"])


def dzsave(r: Raster, folder: str, tile=256, overlap=1) -> list[DataFrame]:
    """A pyramid of tiles: levels halve by box shrink, each tile is cut by key and encoded in its own task."""
    from ..operators.resample import shrink

    out, level, one = [], 0, r
    while True:
        places = F.explode(F.array(*[F.struct((F.expr(f"x div {tile}") + i).alias("tx"), (F.expr(f"y div {tile}") + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        cut = one.df.select("*", places.alias("t"))
        inside = lambda c, t: (F.col(c) >= F.col(t) * tile - overlap) & (F.col(c) < (F.col(t) + 1) * tile + overlap) & (F.col(t) >= 0)
        cut = cut.where(inside("x", "t.tx") & inside("y", "t.ty") & (F.col("t.tx") * tile < one.width) & (F.col("t.ty") * tile < one.height))
        cut = cut.select(F.format_string(f"{level}_%d_%d", F.col("t.tx").cast("int"), F.col("t.ty").cast("int")).alias("img"), (F.col("x") - F.greatest(F.lit(0), F.col("t.tx") * tile - overlap)).cast("int").alias("x"),
                         (F.col("y") - F.greatest(F.lit(0), F.col("t.ty") * tile - overlap)).cast("int").alias("y"), *one.names)
        side = tile + 2 * overlap
        out.append(save(Raster(cut, side, side, one.bands, one.format, one.interpretation, ("img",)), folder, "png"))
        if max(one.width, one.height) <= tile:
            return out
        one, level = shrink(one, 2, 2, ceil=True), level + 1


def system(spark: SparkSession, command: str, rows: DataFrame, allow=False) -> DataFrame:
    """Runs an external command once for each row's text on standard input.  Off unless allowed by the caller."""
    if not allow:
        raise PermissionError("external commands are off; pass allow=True")
    import shlex
    import subprocess

    def run(batches):
        for b in batches:
            outs = [subprocess.run(shlex.split(command), input=t or "", capture_output=True, text=True, timeout=600).stdout for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(outs, pa.string())], ["log"])

    return rows.select(rows.columns[0]).mapInArrow(run, "log string")
