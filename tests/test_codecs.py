"""Bytes decoded in Arrow batches against Spark's image source (Java's decoders)."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import codecs as C
from tessera.sources.images import raster_fixture, scan_images, write_image_files


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def plain_filter(rows, step, kinds):
    """Rows with filter bytes, byte by byte."""
    out, above = [], [0] * len(rows[0])
    for row, kind in zip(rows, kinds, strict=True):
        line = [kind]
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append(bytes(line))
        above = row
    return b"".join(out)


def png(px, color, depth=8, kinds=None, interlaced=False, palette=None, alpha=None):
    """``px``: (height, width, channels) samples."""
    h, w, c = px.shape

    def packed(part):
        if depth == 16:
            return [b"".join(struct.pack(">H", int(v)) for v in row.reshape(-1)) for row in part]
        bits = ((part.reshape(len(part), -1)[..., None] >> np.arange(depth)[::-1]) & 1).astype(np.uint8)
        return [np.packbits(r.reshape(-1)).tobytes() for r in bits]
    body, deal = b"", np.random.default_rng(1)
    for x, y, dx, dy in C.ADAM7 if interlaced else ((0, 0, 1, 1),):
        part = px[y::dy, x::dx]
        if part.size:
            body += plain_filter(packed(part), max(1, c * depth // 8), kinds or deal.integers(0, 5, len(part)).tolist())
    out = C.PNG_SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, int(interlaced)))
    if palette is not None:
        out += chunk(b"PLTE", palette.tobytes())
    if alpha is not None:
        out += chunk(b"tRNS", bytes(alpha))
    return out + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def java_image(spark, px, kind, fmt):
    """Bytes that Java's encoder writes for (height, width, 3) RGB samples."""
    jvm = spark._jvm
    h, w, _ = px.shape
    image = jvm.java.awt.image.BufferedImage(w, h, getattr(jvm.java.awt.image.BufferedImage, kind))
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in px[y, x])
            image.setRGB(x, y, ((200 << 24 | r << 16 | g << 8 | b) + (1 << 31)) % (1 << 32) - (1 << 31))
    stream = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, fmt, stream)
    return bytes(stream.toByteArray())


def scenes():
    rng = np.random.default_rng(2)
    y, x = np.mgrid[:37, :29]
    smooth = np.stack([x * 8, y * 6, (x + y) * 3], axis=2)
    return {"smooth": smooth, "noise": rng.integers(0, 256, (18, 23, 3)), "small": rng.integers(0, 256, (1, 1, 3)), "wide": smooth[:3, :20], "tall": smooth[:20, :3]}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    out, rng = {}, np.random.default_rng(3)
    for name, px in scenes().items():
        for kind, fmt in (("TYPE_INT_RGB", "png"), ("TYPE_INT_ARGB", "png"), ("TYPE_BYTE_GRAY", "png"), ("TYPE_BYTE_INDEXED", "png"), ("TYPE_INT_RGB", "bmp"),
                          ("TYPE_BYTE_INDEXED", "bmp"), ("TYPE_INT_RGB", "jpg"), ("TYPE_BYTE_GRAY", "jpg")):
            out[f"{name}_{kind}.{fmt}"] = java_image(spark, px, kind, fmt)
    palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    for interlaced in (False, True):
        for h, w in ((7, 9), (1, 1), (2, 5), (13, 3)):
            for color, c in ((0, 1), (2, 3), (4, 2), (6, 4)):
                out[f"own_{interlaced}_{h}_{w}_{color}.png"] = png(rng.integers(0, 256, (h, w, c)), color, interlaced=interlaced)
            out[f"own_{interlaced}_{h}_{w}_3.png"] = png(rng.integers(0, 16, (h, w, 1)), 3, 4, interlaced=interlaced, palette=palette)
            out[f"own_{interlaced}_{h}_{w}_3a.png"] = png(rng.integers(0, 4, (h, w, 1)), 3, 2, interlaced=interlaced, palette=palette, alpha=[0, 9, 200])
            out[f"own_{interlaced}_{h}_{w}_bits.png"] = png(rng.integers(0, 2, (h, w, 1)), 0, 1, interlaced=interlaced)
    root = tmp_path_factory.mktemp("images")
    for name, data in out.items():
        (root / name).write_bytes(data)
    return str(root), out


def test_equal_to_the_image_source(spark, files):
    root, made = files
    want = {r.file.rsplit("/", 1)[1]: r for r in scan_images(spark, root, drop_invalid=False).collect()}
    assert want.keys() == made.keys()
    got = {r.name: r for r in C.decode_bytes(spark.createDataFrame([(n, bytearray(b)) for n, b in made.items()], "name string, content binary")).collect()}
    for name, w in want.items():
        g = got[name]
        assert g.reject_reason is None and (g.height, g.width, g.nChannels) == (w.height, w.width, w.nChannels), name
        far = np.abs(np.frombuffer(g.data, np.uint8).astype(int) - np.frombuffer(w.data, np.uint8).astype(int)).max()
        assert far <= (2 if name.endswith("jpg") else 0), (name, far)


def test_sixteen_bits(spark):
    px = np.random.default_rng(4).integers(0, 1 << 16, (4, 5, 3))
    assert (C.decode_png(png(px, 2, 16)) == (px >> 8)[..., ::-1]).all() and (C.decode_png(png(px[..., :1], 0, 16)) == (px >> 8)[..., :1]).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3, 4]), st.data())
def test_filters(h, w, c, data):
    px = np.array(data.draw(st.lists(st.integers(0, 255), min_size=h * w * c, max_size=h * w * c))).reshape(h, w, c)
    kinds = data.draw(st.lists(st.integers(0, 4), min_size=h, max_size=h))
    got = C.decode_png(png(px, {1: 0, 3: 2, 4: 6}[c], kinds=kinds))
    assert (got == (px if c == 1 else np.concatenate([px[..., 2::-1], px[..., 3:]], axis=2))).all()


def test_damaged_bytes_are_rows_with_a_reason(spark, files):
    _, made = files
    rows = [("none", None, None), ("empty", bytearray(), None), ("junk", bytearray(b"not an image"), None), ("known", bytearray(b"x"), "too_large")]
    rng = np.random.default_rng(5)
    for name, data in list(made.items())[::3]:
        rows.append(("cut " + name, bytearray(data[:len(data) // 2]), None))
        hit = bytearray(data)
        for at in rng.integers(0, len(hit), 6):
            hit[at] ^= int(rng.integers(1, 256))
        rows.append(("hit " + name, hit, None))
    df = spark.createDataFrame(rows, "name string, content binary, reject_reason string")
    got = {r.name: r for r in C.decode_bytes(df).collect()}
    assert got.keys() == {r[0] for r in rows}
    assert (got["none"].reject_reason, got["empty"].reject_reason, got["junk"].reject_reason, got["known"].reject_reason) == (
        "empty_image", "empty_image", "undecodable_image", "too_large")
    assert all((r.data is None) == (r.reject_reason is not None) for r in got.values())
    assert all(got[n].reject_reason == "undecodable_image" for n in got if n.startswith("cut ") and n.endswith(("png", "bmp")))
    bomb = C.PNG_SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"")) + chunk(b"IEND", b"")
    assert C.decode_image(bomb) == (None, "undecodable_image")
    assert C.decode_bytes(df.limit(0)).collect() == [] and C.decode_bytes(df, keep_content=True).columns[:2] == ["name", "content"]


def test_fixture_files_equal_the_image_source(spark, tmp_path):
    index = write_image_files(raster_fixture(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")), str(tmp_path / "files"))
    want = {r.file: bytes(r.data) for r in scan_images(spark, str(tmp_path / "files")).collect()}
    content = spark.read.format("binaryFile").load(str(tmp_path / "files")).selectExpr("replace(path, 'file:', '') AS file", "content")
    got = {r.file: r for r in C.decode_bytes(content).collect()}
    assert {f: bytes(r.data) for f, r in got.items() if r.data is not None} == {f.replace("file:", ""): d for f, d in want.items()} and index.count() > len(want) > 0
