"""Image geometry, size limits, pixel conversions and the file round trip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import images as I
from tessera.sources.images import _bmp, _png


@pytest.mark.parametrize("w,h,mw,mh,ew,eh", [
    (500, 400, 1024, 1024, 500, 400),
    (2000, 1000, 1024, 1024, 1024, 512),
    (1000, 2000, 1024, 1024, 512, 1024),
    (2000, 2000, 500, 500, 500, 500),
    (1000, 800, 200, 200, 200, 160),
    (2000, 1500, 800, 800, 800, 600),
])
def test_resize_dims(spark, w, h, mw, mh, ew, eh):
    nw, nh = I.resize_dims(F.lit(w), F.lit(h), mw, mh)
    r = spark.range(1).select(nw.alias("w"), nh.alias("h")).first()
    assert (r.w, r.h) == (ew, eh)


def test_resize_keeps_ratio(spark):
    nw, nh = I.resize_dims(F.lit(3000), F.lit(2000), 1024, 1024)
    r = spark.range(1).select(nw.alias("w"), nh.alias("h")).first()
    assert r.w <= 1024 and r.h <= 1024 and abs(r.w / r.h - 1.5) < 0.01


def test_decoded_size_limits(spark):
    r = spark.range(1).select(
        I.within_decoded_limit(F.lit(2000), F.lit(2000), F.lit(3), 1.0).alias("big"),
        I.within_decoded_limit(F.lit(1000), F.lit(1000), F.lit(3), 5.0).alias("ok"),
        I.within_decoded_limit(F.lit(1024), F.lit(1024), F.lit(1), 1.0).alias("equal")).first()
    assert (r.big, r.ok, r.equal) == (False, True, True)


def test_lanczos_properties():
    flat = np.full((40, 30, 3), 77, dtype=np.uint8)
    assert (I.lanczos_resize(flat, 10, 7) == 77).all()
    img = np.random.default_rng(0).integers(0, 255, (8, 8, 1), dtype=np.uint8)
    assert (I.lanczos_resize(img, 8, 8) == img).all()


def test_rgb_conversion():
    gray = bytes([10, 20, 30, 40])
    assert I.rgb_array(gray, 2, 2, 1).reshape(-1, 3).tolist()[0] == [10, 10, 10]
    bgr = bytes([1, 2, 3])
    assert I.rgb_array(bgr, 1, 1, 3).tolist() == [[[3, 2, 1]]]
    bgra = bytes([1, 2, 3, 4])
    assert I.rgb_array(bgra, 1, 1, 4).tolist() == [[[3, 2, 1]]]


def test_written_files_decode_through_spark(spark, tmp_path):
    px3 = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    px4 = np.arange(4 * 5 * 4, dtype=np.uint8).reshape(4, 5, 4)
    px1 = np.arange(4 * 5, dtype=np.uint8).reshape(4, 5, 1)
    (tmp_path / "a.png").write_bytes(_png(px3))
    (tmp_path / "b.bmp").write_bytes(_bmp(px3))
    (tmp_path / "c.png").write_bytes(_png(px4))
    (tmp_path / "d.png").write_bytes(_png(px1))
    (tmp_path / "e.png").write_bytes(b"not an image")
    (tmp_path / "f.png").write_bytes(_png(px3)[:30])
    rows = {r.origin.rsplit("/", 1)[-1]: r for r in
            spark.read.format("image").option("dropInvalid", "true").load(str(tmp_path))
                 .select("image.*").collect()}
    assert set(rows) == {"a.png", "b.bmp", "c.png", "d.png"}
    assert bytes(rows["a.png"].data) == px3.tobytes() == bytes(rows["b.bmp"].data)
    assert bytes(rows["c.png"].data) == px4.tobytes() and rows["c.png"].nChannels == 4
    assert rows["d.png"].nChannels == 1
    fmt = spark.read.format("binaryFile").load(str(tmp_path)).select(
        F.regexp_extract("path", r"[^/]+$", 0).alias("n"), I.format_name("content").alias("f")).collect()
    got = {r.n: r.f for r in fmt}
    assert got["a.png"] == "PNG" and got["b.bmp"] == "BMP" and got["e.png"] is None


def test_fetch_by_url_statuses(spark, tmp_path):
    from tessera.sources.images import fetch_by_url
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "e.bin").write_bytes(b"")
    rows = [("ok", str(tmp_path / "a.bin")), ("uri", "file://" + str(tmp_path / "a.bin")),
            ("empty", str(tmp_path / "e.bin")), ("missing", str(tmp_path / "nope.bin")),
            ("http", "http://example.invalid/x.png"), ("none", None)]
    got = {r.k: (r.fetch_status, r.content) for r in
           fetch_by_url(spark.createDataFrame(rows, "k string, url string")).collect()}
    assert got["ok"] == ("ok", bytearray(b"abc")) and got["uri"][0] == "ok"
    assert got["empty"][0] == "empty" and got["missing"][0] == "not_found"
    assert got["http"][0] == "unsupported_scheme" and got["none"][0] == "unsupported_scheme"


def test_image_job_with_hot_url(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.models.base import EncoderSpec
    from tessera.models.builtin import PixelGridEncoder
    from tessera.plans.embed_job import embed_image_dataset
    imgs = tmp_path / "imgs"
    imgs.mkdir()
    (imgs / "hot.png").write_bytes(_png(np.full((4, 4, 3), 100, dtype=np.uint8)))
    (imgs / "bad.png").write_bytes(b"not an image")
    rows = [(str(imgs / "hot.png"), f"h{i}") for i in range(50)] + \
           [(str(imgs / "bad.png"), "b0"), (str(imgs / "gone.png"), "g0")]
    samples = spark.createDataFrame(rows, "url string, key string").withColumn("src", F.lit("t"))
    res = embed_image_dataset(spark, samples, str(imgs), str(tmp_path / "out"),
                              EncoderSpec.of(PixelGridEncoder, grid=2), hot_threshold=10)
    assert res.num_samples == 50
    allrows = spark.read.parquet(str(tmp_path / "out/samples.parquet")).collect()
    rej = {r.key: r.reject_reason for r in allrows if r.status == "rejected"}
    assert rej == {"b0": "undecodable_image", "g0": "unresolved_url"}
    acc = [r for r in allrows if r.status == "accepted"]
    assert len(acc) == 50 and all(r.meta_src == "t" and len(r.embedding) == 4 for r in acc)
