"""Image job by URL: fetched, decoded and encoded in the task; cap on accepted samples; encoder spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.models.base import EncoderSpec
from tessera.models.builtin import MultimodalClassifier, PixelGridEncoder
from tessera.operators.encode import MOST_SPREAD, TASK_BYTES, apply_encoder, spread_tasks
from tessera.plans.embed_job import embed_image_dataset, main
from tessera.sources.dataset import scan_dataset
from tessera.sources.images import _bmp, _png, deal_by_bytes, fetched_images, url_sizes

GRID = EncoderSpec.of(PixelGridEncoder, grid=2)


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    """Files in two folders and what each should come to."""
    a, b = tmp_path_factory.mktemp("first"), tmp_path_factory.mktemp("second")
    rng = np.random.default_rng(1)
    reasons = {}
    for i in range(12):
        px = rng.integers(0, 256, (4, 4, 3)).astype(np.uint8)
        path = (a if i % 2 else b) / f"im{i}.{'bmp' if i % 3 else 'png'}"
        path.write_bytes(_bmp(px) if i % 3 else _png(px))
        reasons[str(path) if i % 4 else f"file://{path}"] = None
    (a / "empty.png").write_bytes(b"")
    (b / "bad.png").write_bytes(b"not an image")
    (b / "big.png").write_bytes(_png(rng.integers(0, 256, (300, 300, 3)).astype(np.uint8)))
    reasons |= {str(a / "empty.png"): "empty_image", str(b / "bad.png"): "undecodable_image", str(b / "big.png"): "image_too_large",
                str(a / "gone.png"): "unresolved_url", "http://x/y.png": "unsupported_scheme", str(a): "unresolved_url"}
    return reasons


def job(spark, tmp_path, samples, images_root=None, **options):
    res = embed_image_dataset(spark, samples, images_root, str(tmp_path / "out"), GRID, max_decoded_mb=0.2, **options)
    rows = spark.read.parquet(str(tmp_path / "out/samples.parquet")).collect()
    assert res.num_samples == sum(r.status == "accepted" for r in rows)
    return rows


@pytest.mark.parametrize("folder", [False, True])
def test_urls_of_two_folders(spark, tmp_path, world, folder):
    urls = list(world)
    samples = spark.createDataFrame([(u, f"k{i}", i) for i, u in enumerate(urls)] + [(urls[1], "again", 99)] * 30, "url string, key string, n int")
    root = next(u for u in urls if "first" in u).replace("file://", "").rsplit("/", 1)[0] if folder else None
    rows = job(spark, tmp_path, samples, root, hot_threshold=7)
    assert len(rows) == len(urls) + 30
    assert {r.key: r.reject_reason for r in rows if r.key != "again"} == {f"k{i}": world[u] for i, u in enumerate(urls)}
    assert all((r.embedding is None) == (r.reject_reason is not None) and (r.embedding is None or len(r.embedding) == 4) for r in rows)
    one = next(r.embedding for r in rows if r.key == "k1")
    assert all(r.embedding == one for r in rows if r.key == "again")


@pytest.mark.parametrize("cap", [1, 5, 8, 100])
def test_cap_on_accepted_samples(spark, tmp_path, world, cap):
    order = [u for pair in zip(list(world), list(world)[::-1], strict=True) for u in pair]
    src = str(tmp_path / "shards")
    rows = [(u, f"k{i:03d}", i) for i, u in enumerate(order)]
    spark.createDataFrame(rows, "url string, key string, n int").repartitionByRange(3, "n").sortWithinPartitions("n").write.parquet(src)
    got = job(spark, tmp_path, scan_dataset(spark, src), max_samples=cap)
    want, taken = [], 0
    for u, k, _ in rows:
        if taken == cap:
            break
        taken += world[u] is None
        want.append((k, world[u]))
    assert sorted((r.key, r.reject_reason) for r in got) == want


def test_cap_needs_positions(spark, tmp_path, world):
    with pytest.raises(ValueError, match="position"):
        job(spark, tmp_path, spark.createDataFrame([("u", "k")], "url string, key string"), max_samples=3)


def test_captions_and_limits(spark, tmp_path, world):
    urls = list(world)[:4]
    samples = spark.createDataFrame([(u, f"word{i}", f"k{i}") for i, u in enumerate(urls)] + [(urls[0], "other words", "more")], "url string, caption string, key string")
    spec = EncoderSpec.of(MultimodalClassifier, n_classes=3, text_dim=64, grid=2)
    embed_image_dataset(spark, samples, None, str(tmp_path / "c"), spec, with_captions=True)
    rows = {r.key: r.embedding for r in spark.read.parquet(str(tmp_path / "c/samples.parquet")).collect()}
    assert len(rows) == 5 and rows["more"] != rows["k0"] and all(len(v) == 3 for v in rows.values())
    big = next(u for u in world if u.endswith("big.png"))
    got = fetched_images(spark.createDataFrame([(big,), (urls[0],)], "url string"), max_bytes=1000)
    assert {r.url: r.reject_reason for r in got.collect()} == {big: "file_too_large", urls[0]: None}
    assert fetched_images(spark.createDataFrame([], "url string")).collect() == []


def test_command_line_by_url_with_cap(spark, tmp_path, world, monkeypatch):
    src = str(tmp_path / "shards")
    good = [u for u, r in world.items() if r is None]
    spark.createDataFrame([(u, f"k{i}") for i, u in enumerate(good)], "url string, key string").coalesce(1).write.parquet(src)
    monkeypatch.setattr("tessera.models.loader.register", lambda spark, uri: (None, GRID))
    main(["--input_dir", src, "--output_dir", str(tmp_path / "o"), "--model", "plug-in", "--images", "--max_samples", "5", "--master", "local[4]"])
    assert spark.read.parquet(str(tmp_path / "o/samples.parquet")).where("status = 'accepted'").count() == 5


def test_files_are_dealt_by_bytes(spark, tmp_path):
    rows = []
    for i in range(40):
        (tmp_path / f"f{i:02d}").write_bytes(b"x" * (400_000 if i % 10 == 0 else 100))
        rows.append((str(tmp_path / f"f{i:02d}"),))
    sized = url_sizes(spark.createDataFrame(rows, "url string"))
    assert {(r.length, r.fetch_status) for r in sized.collect()} == {(400_000, "ok"), (100, "ok")}
    dealt = deal_by_bytes(sized, task_bytes=1 << 20).withColumn("p", F.spark_partition_id()).collect()
    assert len(dealt) == 40
    load = {}
    for r in dealt:
        load[r.p] = load.get(r.p, 0) + r.length + (64 << 10)
    assert len(load) >= 4 and max(load.values()) <= (1 << 20) + 400_000 + (64 << 10)


def test_very_many_small_files_make_tasks_of_many_files(spark):
    sized = spark.range(70_000).selectExpr("concat('/none/', lpad(cast(id AS string), 6, '0')) AS url", "300L AS length")
    load = [r["count"] for r in deal_by_bytes(sized, task_bytes=1 << 20).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(load) == 70_000 and len(load) <= 70_000 // 512 + 40 and max(load) <= 600


def test_one_row_group_is_spread_over_tasks(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("id", "concat(md5(cast(id as string)), sha2(cast(id as string), 256)) AS text").coalesce(1)
    rows.write.option("parquet.block.size", 1 << 30).parquet(str(tmp_path / "one"))
    table = spark.read.parquet(str(tmp_path / "one"))
    n = spread_tasks(table)
    assert 2 <= n <= MOST_SPREAD
    spec = EncoderSpec(target="tessera.models.builtin:ConstantEncoder")
    tasks = apply_encoder(table, spec, text_col="text", batch_size=16).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) == n and max(r["count"] for r in tasks) < 2 * 60_000 / n
    assert spread_tasks(spark.read.parquet("/root/testdata/sf0.001/nation.parquet")) == 0 and spread_tasks(spark.range(10)) == 0 and TASK_BYTES > 0
    same = apply_encoder(table, spec, text_col="text", partitions=0)
    assert same.groupBy(F.spark_partition_id()).count().count() == 1


def test_encoder_stage_gets_its_own_resources(spark):
    from tessera.operators.encode import encoder_resources

    profile = encoder_resources(task_cpus=2, executor_cores=4, executor_memory="6g")
    assert profile.taskResources["cpus"].amount == 2 and {"cores", "memory"} <= set(profile.executorResources)
    spec = EncoderSpec(target="tessera.models.builtin:ConstantEncoder")
    rows = spark.createDataFrame([("a",)], "text string")
    plain, own = (apply_encoder(rows, spec, text_col="text", resources=r) for r in (None, profile))
    node = lambda df: df._jdf.queryExecution().analyzed()
    assert node(plain).profile().isEmpty() and node(own).profile().get().id() == profile.id and own.schema == plain.schema


def test_very_many_small_files_are_as_the_image_source_gives_them(spark, tmp_path, monkeypatch):
    from pyspark.testing import assertDataFrameEqual

    from tessera.sources import images

    rng = np.random.default_rng(4)
    made = {"junk.png": b"not an image", "short": b"B", "zero": b"\0", "wbmp": b"\0\0\x08\x01\xaa", "gif": b"GIF89a, no more", "jpg": b"\xff\xd8\xff", "tif": b"II*\0",
            "in side/a b%20c.png": _png(rng.integers(0, 256, (5, 3, 4)).astype(np.uint8)),
            "big.png": _png(rng.integers(0, 256, (40, 40, 3)).astype(np.uint8)), "empty.png": b""}
    for c in (1, 3, 4):
        px = rng.integers(0, 256, (4, 3, c)).astype(np.uint8)
        whole = _png(px)
        made |= {f"cut_{c}_{n}.png": whole[:n] for n in range(1, len(whole) + 1)}
        made |= {f"hit_{c}_{n}.png": whole[:n] + bytes([whole[n] ^ 5]) + whole[n + 1:] for n in range(0, len(whole), 2)}
    bmp = _bmp(rng.integers(0, 256, (4, 3, 3)).astype(np.uint8))
    made |= {f"cut_{n}.bmp": bmp[:n] for n in range(2, len(bmp) + 1, 5)} | {"long.bmp": bmp + b"x", "plain.bmp": bmp}
    (tmp_path / "in side").mkdir()
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    want = {drop: images.scan_images(spark, str(tmp_path), drop).collect() for drop in (True, False)}
    assert len(want[False]) == len(made) - 1 > len(want[True]) > 10
    monkeypatch.setattr(images, "MANY_FILES", 0)
    for drop, rows in want.items():
        got, names = images.folder_images(spark, str(tmp_path), drop)
        assertDataFrameEqual(got.collect(), rows)
        assert sorted(r.file for r in names.collect()) == sorted(r.file for r in images.scan_bytes(spark, str(tmp_path)).collect())
    # of the plain files and those that are surely none, none is left to the image source, a setup of some milliseconds each
    seen = images._plain_or_copied(spark.createDataFrame([(n, n, bytearray(made[n])) for n in ("junk.png", "plain.bmp", "cut_3_70.png", "big.png")],
                                                         "listed string, file string, content binary"), str(tmp_path / "copies"), True)
    assert {r.file: (r.height, r.copy is None) for r in seen.collect()} == {
        "junk.png": (-1, True), "plain.bmp": (4, True), "cut_3_70.png": (-1, True), "big.png": (None, False)}
    everything = images._plain_or_copied(spark.createDataFrame([("j", "j", bytearray(b"junk"))], "listed string, file string, content binary"), str(tmp_path / "more"), False)
    assert everything.first().copy is not None


def test_a_row_group_of_rasters_is_spread_over_tasks(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id AS vec_id", "0 AS label", "transform(sequence(1, 64), k -> cast(rand() - 0.5 AS float)) AS embedding").coalesce(1)
    rows.write.option("parquet.block.size", 1 << 30).parquet(str(tmp_path / "one"))
    from tessera.sources.images import raster_fixture

    load = raster_fixture(spark.read.parquet(str(tmp_path / "one"))).groupBy(F.spark_partition_id()).count().collect()
    assert len(load) > 2 and sum(r["count"] for r in load) == 20_000
