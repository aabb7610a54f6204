"""JPEG against the decoder and the encoder of the Java platform."""

import io

import numpy as np
import pytest

from pixelloom.sources import codecs, files, jpeg


def picture(h, w, bands):
    y, x = np.mgrid[:h, :w]
    planes = [128 + 90 * np.sin((x + 7 * k) / 9.0) * np.cos(y / (6.0 + k)) for k in range(bands)]
    return np.stack(planes, 2).clip(0, 255).astype(np.uint8)


def java_encode(spark, a, quality=0.8, progressive=False):
    jvm = spark._jvm
    h, w, n = a.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if n == 1 else 1)
    for y in range(h):
        for x in range(w):
            v = [int(c) for c in a[y, x]] * (1 if n == 3 else 3)
            if n == 1:
                image.getRaster().setSample(x, y, 0, v[0])
            else:
                image.setRGB(x, y, v[0] << 16 | v[1] << 8 | v[2])
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    param.setProgressiveMode(1 if progressive else 0)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()
    return bytes(out.toByteArray())


def java_decode(spark, data, folder):
    file = folder / "one.jpg"
    file.write_bytes(data)
    row = spark.read.format("image").load(str(file)).select("image.*").first()
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])[:, :, ::-1]


@pytest.mark.parametrize("bands", [1, 3])
@pytest.mark.parametrize("progressive", [False, True])
def test_reads_what_java_writes(spark, tmp_path, bands, progressive):
    data = java_encode(spark, picture(37, 45, bands), progressive=progressive)
    assert (data.find(b"\xff\xc2") > 0) == progressive
    mine, theirs = jpeg.decode(data), java_decode(spark, data, tmp_path)
    assert mine.shape == (37, 45, bands) and jpeg.header(data) == (45, 37, bands)
    assert np.abs(mine.astype(int) - theirs).max() <= 3


@pytest.mark.parametrize("bands", [1, 3])
@pytest.mark.parametrize("Q", [1, 50, 75, 95, 100])
def test_java_reads_what_is_written(spark, tmp_path, bands, Q):
    a = picture(41, 35, bands)
    data = jpeg.encode(a, Q=Q)
    assert np.abs(jpeg.decode(data).astype(int) - java_decode(spark, data, tmp_path)).max() <= 3
    if Q == 100:
        assert np.abs(jpeg.decode(data).astype(int) - a).max() <= 4


def test_many_symbols_keep_to_16_bits():
    counts = np.zeros(256, int)
    counts[:40] = [int(1.7**k) for k in range(40)]
    sizes = jpeg.code_sizes(counts)
    assert sizes.max() <= 16 and (sizes[:40] > 0).all() and sum(2.0 ** -sizes[:40]) < 1


def test_shrink_is_close_to_means():
    a = picture(64, 96, 3)
    data = jpeg.encode(a, Q=95)
    for s in (2, 4, 8):
        means = a.reshape(64 // s, s, 96 // s, s, 3).mean((1, 3))
        assert np.abs(jpeg.decode(data, shrink=s) - means).mean() < 6
    assert jpeg.decode(jpeg.encode(a[:63, :95]), shrink=8).shape == (8, 12, 3)


def test_truncated_odd_and_refused():
    a = picture(64, 64, 3)
    data = jpeg.encode(a)
    half = jpeg.decode(data[: len(data) * 2 // 3])
    assert half.shape == a.shape and (half[:8] == jpeg.decode(data)[:8]).all()
    assert jpeg.decode(jpeg.encode(a[:1, :1])).shape == (1, 1, 3)
    assert codecs.find_load(data) == "jpeg" and codecs.find_save("x.JPEG") == "jpeg"
    with pytest.raises(codecs.Unsupported):
        jpeg.decode(data.replace(b"\xff\xc0", b"\xff\xc9", 1))
    with pytest.raises(ValueError):
        jpeg.decode(data, shrink=3)


def test_orientation():
    a = picture(24, 40, 1)
    data = jpeg.encode(a, Q=95)
    tag = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    turned = data[:2] + jpeg.segment(0xE1, tag) + data[2:]
    assert (jpeg.decode(turned, autorotate=True) == np.rot90(jpeg.decode(data), -1)).all()
    assert (jpeg.decode(turned) == jpeg.decode(data)).all()


def test_files_and_thumbnail(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.jpg").write_bytes(jpeg.encode(picture(80, 120, 3), Q=90))
    r = files.load(spark, str(tmp_path / "*.jpg"))
    assert (r.width, r.height, r.bands, r.format) == (120, 80, 3, "uchar") and r.df.count() == 2 * 9600
    small = files.thumbnail(spark, str(tmp_path / "*.jpg"), 20)
    assert (small.width, small.height) == (20, 13) and small.df.count() == 2 * 260
    got = files.save(r, f"file://{tmp_path}/out", "jpeg", Q=80).collect()
    assert len(got) == 2 and all(g["file"].endswith(".jpg") for g in got)
