import hashlib
import zlib

import numpy as np
import pytest

from lumenframe.llm import media_columns as M
from tests.llm.util import ODD, SF, empty_documents, odd_documents

TEXTS = [b"", b"abc", b"hello world " * 50, bytes(range(256)) * 20, b"\x80" * 3000, "naïve ’quotes’ 😀 ".encode() * 200, b"\x80" * 190 + b"ab" * 700, b"\x7f\x81" * 500]


def test_files_give_payloads_back_alone_and_together():
    payloads = [M.padded(t) for t in TEXTS]
    files = M.encode(payloads)
    assert files == [M.encode([p])[0] for p in payloads]
    batch = M.Batch(files)
    for p, f, i in zip(payloads, files, batch.images, strict=True):
        assert batch.payload(i) == p and batch.rgb(i).shape == (i.height, i.width, 3)
        alone = M.Batch([f])
        assert np.array_equal(alone.rgb(alone.images[0]), batch.rgb(i))


def test_long_texts_take_several_turns(monkeypatch):
    payload = M.padded(np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes())
    file = M.encode([payload])[0]
    monkeypatch.setattr(M, "STREAMS", 3)
    monkeypatch.setattr(M, "STREAM_BYTES", 1000)
    assert M.encode([payload])[0] == file
    batch = M.Batch([file, M.encode([M.padded(b"x")])[0]])
    assert batch.payload(batch.images[0]) == payload


def pixels(height, width):
    """Smooth colours with an edge."""
    y, x = np.mgrid[:height, :width]
    out = np.stack([128 + 90 * np.sin(x / 17), 128 + 80 * np.cos(y / 13), 60 + (x + y) * 120 / (height + width)], 2)
    out[height // 2 :, : width // 3] += 40
    return np.clip(out, 0, 255).astype(np.uint8)


def java_file(spark, rgb, progressive=True, quality=0.9):
    """The picture as the JVM's own encoder writes it."""
    jvm, gate = spark._jvm, spark.sparkContext._gateway
    h, w, _ = rgb.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    flat = (rgb[:, :, 0].astype(int) << 16 | rgb[:, :, 1].astype(int) << 8 | rgb[:, :, 2]).ravel().tolist()
    data = gate.new_array(jvm.int, len(flat))
    for i, v in enumerate(flat):
        data[i] = v
    image.setRGB(0, 0, w, h, data, 0, w)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(1)
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.flush()
    return bytes(out.toByteArray())


def java_luma(spark, data):
    """The first band of a file as the JVM's own decoder reads it."""
    jvm = spark._jvm
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("jpeg").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(data)))
    raster = reader.readRaster(0, None)
    h, w = raster.getHeight(), raster.getWidth()
    return np.array(list(raster.getSamples(0, 0, w, h, 0, spark.sparkContext._gateway.new_array(jvm.int, h * w)))).reshape(h, w)


def luma(batch, image):
    p = next(iter(image.planes.values()))
    s = batch.samples[p.first : p.first + p.stride * p.lines].reshape(p.lines, p.stride, 8, 8)
    return s.transpose(0, 2, 1, 3).reshape(8 * p.lines, 8 * p.stride)[: image.height, : image.width].astype(int)


def test_files_of_another_encoder_are_read(spark):
    """Ten scans of the usual script: runs of empty blocks, refinements of all bands, no restarts, sides that fill no macroblock."""
    pictures = [pixels(61, 83), pixels(8, 8), pixels(33, 17)]
    files = [java_file(spark, p, quality=q) for p, q in zip(pictures, (0.95, 0.8, 0.4), strict=True)]
    batch = M.Batch(files)
    for picture, data, image in zip(pictures, files, batch.images, strict=True):
        assert image.error is None and data.count(b"\xff\xda") > 5
        assert np.abs(luma(batch, image) - java_luma(spark, data)).max() <= 1
        got = batch.rgb(image).astype(int)
        assert got.shape == picture.shape and np.abs(got - picture).mean() < 7


def test_another_decoder_reads_our_files(spark):
    payload = M.padded(b"The quick brown fox jumps over the lazy dog. " * 60)
    data = M.encode([payload])[0]
    batch = M.Batch([data])
    assert np.abs(luma(batch, batch.images[0]) - java_luma(spark, data)).max() <= 1


def test_other_files_get_an_error_not_a_crash(spark):
    good = M.encode([M.padded(b"fox " * 300)])[0]
    bad = [None, b"", b"GIF89a", good[:40], good[: len(good) // 2], java_file(spark, pixels(16, 16), progressive=False), good[:300] + bytes(200) + good[500:]]
    rows = [(i, x, "r", 1) for i, x in enumerate([good, *bad])]
    out = {r["key"]: r for r in M.load(spark.createDataFrame(rows, "id int, file binary, rgb string, height int"), "id", "file").collect()}
    assert out[0]["error"] is None and len(out[0]["rgb"]) == 3 * out[0]["height"] * out[0]["width"]
    assert all(out[i]["error"] and out[i]["rgb"] is None for i in range(1, 7)) and len(out) == 8


def expected(text):
    data = (text or "").encode()
    payload = data + b" " * (-len(data) % 192 if data else 192)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])


@pytest.mark.parametrize("together", [2 << 20, 1])
def test_odd_rows(spark, monkeypatch, together):
    monkeypatch.setattr(M, "TOGETHER", together)
    out = M.digests(M.store(odd_documents(spark), "doc_id", "text")).collect()
    assert len(out) == len(ODD)
    got = sorted((str(r["key"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out)
    assert got == sorted((str(i), *expected(t)) for i, t, _ in ODD)
    by = {}
    for r in out:
        by.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in by.values())
    assert M.digests(M.store(empty_documents(spark), "doc_id", "text")).isEmpty()


def test_query_holds_every_text(spark):
    out = {r["doc_id"]: r for r in M.op13_media_columns(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert {i: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for i, r in out.items()} == {d["doc_id"]: expected(d["text"]) for d in docs}
    stored = M.store(spark.createDataFrame(docs), "doc_id", "text")
    tensors = {r["key"]: r for r in M.load(stored, "key", "media").collect()}
    for i, r in out.items():
        assert r["feature"].startswith(f"{tensors[i]['height']}x{tensors[i]['width']} ") and r["feature"].endswith(f"{zlib.crc32(tensors[i]['rgb']):08x}")
