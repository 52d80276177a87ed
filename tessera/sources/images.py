"""Image sources: bytes by file, decoded images, and raster fixtures.

``scan_bytes`` / ``scan_images`` are Spark's ``binaryFile`` and ``image``
sources; of folders with very many small files, the plain ones among them are
decoded in Arrow batches. ``write_image_files`` writes PNG / BMP files (plus
junk, truncated and empty files) from rasters through each executor's
Hadoop-compatible filesystem handle, so test images are derived from the given
tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codecs import JAVA_FORMATS, decode_bytes, decode_plain, no_java_image
from ..functions.urls import normalize_file_uri
from ..operators.encode import spread_tasks
from ..operators.scan import running_sums
from ..session import scratch_path

RASTER_SIDE = 8
# Fixed value: bytes of an undecodable "image".
JUNK = b"not an image"


def scan_bytes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).withColumn("file", normalize_file_uri("path"))


def scan_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    return folder_images(spark, path, drop_invalid)[0]


def _image_source(spark: SparkSession, path: str, drop_invalid: bool) -> DataFrame:
    df = (spark.read.format("image").option("dropInvalid", str(drop_invalid).lower())
          .option("recursiveFileLookup", "true").load(path))
    return df.select(normalize_file_uri("image.origin").alias("file"), "image.height", "image.width",
                     "image.nChannels", "image.mode", "image.data")


#: files of a folder beyond which, and their mean size up to which, plain files are decoded in batches
MANY_FILES, SMALL_FILE = 1 << 12, 64 << 10
# Spark's mode (OpenCV type) by number of channels, and its height, width, channels and mode of what is no image.
MODE_OF = {1: 0, 3: 16, 4: 24}
NO_IMAGE = (-1, -1, -1, -1)


def folder_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(images, names)`` of a folder: the rows of Spark's image source, and the ``file`` of each file that ``scan_bytes`` lists.

    The image source sets up an encoder for every file, some milliseconds each. Of
    very many small files, one pass decodes those that every decoder reads alike
    (``decode_plain``), knows those that no decoder of Java reads (``no_java_image``)
    and copies the others to a scratch folder, which the image source then judges and
    decodes. Other folders go to the image source as they are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    n = len(files._jdf.inputFiles())
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n <= MANY_FILES or size > n * SMALL_FILE:
        return _image_source(spark, path, drop_invalid), scan_bytes(spark, path).select("file")

    def tasks(n_files: int) -> int:
        return max(FEW_TASKS, -(-size // TASK_BYTES) + -(-n_files // TASK_FILES))

    root = scratch_path(spark, "other_files")
    java_only = {str(f).lower() for f in spark._jvm.javax.imageio.ImageIO.getReaderFormatNames()} <= JAVA_FORMATS
    named = files.select(normalize_file_uri("path").alias("listed"), normalize_file_uri("_metadata.file_path").alias("file"), "content")
    seen = checkpointed(_plain_or_copied(named.coalesce(tasks(n)), root, java_only))
    plain = seen.where("copy is null and height > 0" if drop_invalid else "copy is null").select("file", "height", "width", "nChannels", "mode", "data")
    names = seen.select(F.col("listed").alias("file"))
    others = seen.where("copy is not null").select("copy", F.col("file").alias("_of"))
    n_others = others.count()
    if not n_others:
        return plain, names
    judged = _image_source(spark, root, drop_invalid).coalesce(tasks(n_others)).withColumn("copy", F.substring_index("file", "/", -1))
    return plain.unionByName(judged.join(others, "copy").select(F.col("_of").alias("file"), *plain.columns[1:])), names


def _plain_or_copied(named: DataFrame, root: str, java_only: bool) -> DataFrame:
    """``(listed, file, height, width, nChannels, mode, data, copy)``: the pixels of a plain file, those of no image, or the name of its copy below ``root``.

    Unless the JVM has no decoders but Java's own (``java_only``), all but plain files are copied.
    """
    kept = [named.schema[c] for c in ("listed", "file")]
    sides = ("height", "width", "nChannels", "mode")
    fields = [*kept, *(T.StructField(c, T.IntegerType()) for c in sides), T.StructField("data", T.BinaryType()), T.StructField("copy", T.StringType())]

    def run(batches):
        filesystem = base = None
        for batch in batches:
            shapes, data, copies = [], [], []
            for i, file in enumerate(batch.column("file").to_pylist()):
                content = batch.column("content")[i].as_py()
                image, copy = decode_plain(content), None
                refused = image is None and java_only and no_java_image(content)
                if image is None and not refused:
                    if filesystem is None:
                        filesystem, base = _fs_for(root)
                        filesystem.create_dir(base, recursive=True)
                    copy = hashlib.sha256(file.encode()).hexdigest()
                    with filesystem.open_output_stream(f"{base}/{copy}") as f:
                        f.write(content)
                shapes.append((*image.shape, MODE_OF[image.shape[2]]) if image is not None else NO_IMAGE if refused else (None,) * 4)
                data.append(image.tobytes() if image is not None else b"" if refused else None)
                copies.append(copy)
            yield pa.RecordBatch.from_arrays([*(batch.column(c.name) for c in kept), *(pa.array([s[k] for s in shapes], pa.int32()) for k in range(4)),
                                              pa.array(data, pa.binary()), pa.array(copies, pa.string())], [f.name for f in fields])

    return named.mapInArrow(run, T.StructType(fields))


# ---------------------------------------------------------------- fixtures
def channels_rule(label) -> F.Column:
    """1, 3 or 4 channels by ``label % 3``."""
    l3 = F.pmod(F.col(label) if isinstance(label, str) else label, F.lit(3))
    return F.when(l3 == 0, 1).when(l3 == 1, 3).otherwise(4)


@F.pandas_udf(T.BinaryType())
def _raster_bytes(emb: pd.Series, channels: pd.Series) -> pd.Series:
    out = []
    for e, c in zip(emb, channels):
        p = np.clip(np.floor((np.asarray(e, dtype=np.float64) + 1.0) * 127.5), 0, 255).astype(np.int64)
        planes = [(p + 40 * s) % 256 for s in range(int(c))]
        out.append(np.stack(planes, axis=1).astype(np.uint8).tobytes())
    return pd.Series(out)


def raster_fixture(embeddings: DataFrame) -> DataFrame:
    """64-d vectors -> 8x8 images; stored channel ``s`` = (pixel + 40 s) mod 256,
    pixel = clamp(floor((x + 1) * 127.5), 0, 255)."""
    c = channels_rule("label")
    tasks = spread_tasks(embeddings)
    if tasks:                                       # a row group is one task's otherwise, and each row becomes a file
        embeddings = embeddings.select("vec_id", "label", "embedding").repartition(tasks, "vec_id")
    return embeddings.select("vec_id", "label", F.lit(RASTER_SIDE).alias("height"),
                             F.lit(RASTER_SIDE).alias("width"), c.alias("nChannels"),
                             _raster_bytes("embedding", c).alias("data"))


def file_kind(vec_id, channels) -> F.Column:
    """junk / truncated / empty files for some ids; BMP for odd 3-channel ids; else PNG."""
    v = F.col(vec_id) if isinstance(vec_id, str) else vec_id
    c = F.col(channels) if isinstance(channels, str) else channels
    d = F.pmod(v, F.lit(10))
    return (F.when(d == 7, "junk").when(d == 8, "truncated").when(d == 9, "empty")
            .when((c == 3) & (F.pmod(v, F.lit(2)) == 1), "bmp").otherwise("png"))


def _png(px: np.ndarray) -> bytes:
    h, w, c = px.shape
    ctype = {1: 0, 3: 2, 4: 6}[c]
    if c >= 3:  # stored BGR(A) -> RGB(A)
        px = np.concatenate([px[:, :, 2::-1], px[:, :, 3:]], axis=2)
    raw = b"".join(b"\x00" + px[y].tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, ctype, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def _bmp(px: np.ndarray) -> bytes:
    h, w, _ = px.shape
    row = w * 3
    pad = (4 - row % 4) % 4
    body = b"".join(px[y].tobytes() + b"\x00" * pad for y in range(h - 1, -1, -1))
    header = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    return header + info + body


def _fs_for(uri: str):
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_image_files(rasters: DataFrame, out_dir: str) -> DataFrame:
    """Write one file per raster; returns (vec_id, file, kind, n_bytes), materialised."""
    spark = rasters.sparkSession
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("file", T.StringType()),
                           T.StructField("kind", T.StringType()), T.StructField("n_bytes", T.LongType())])
    src = rasters.select("vec_id", "height", "width", "nChannels", "data",
                         file_kind("vec_id", "nChannels").alias("kind"))

    def fn(it):
        filesystem, base = _fs_for(out_dir)
        filesystem.create_dir(base, recursive=True)
        for pdf in it:
            rows = []
            for vid, h, w, c, data, kind in zip(pdf.vec_id, pdf.height, pdf.width, pdf.nChannels, pdf.data, pdf.kind):
                px = np.frombuffer(data, dtype=np.uint8).reshape(int(h), int(w), int(c))
                if kind == "bmp":
                    payload, ext = _bmp(px), "bmp"
                elif kind == "junk":
                    payload, ext = JUNK, "png"
                elif kind == "empty":
                    payload, ext = b"", "png"
                else:
                    payload, ext = _png(px), "png"
                    if kind == "truncated":
                        payload = payload[: len(payload) // 2]
                name = f"{base}/img_{int(vid):05d}.{ext}"
                with filesystem.open_output_stream(name) as f:
                    f.write(payload)
                rows.append((int(vid), name, kind, len(payload)))
            yield pd.DataFrame(rows, columns=["vec_id", "file", "kind", "n_bytes"])

    listing = src.mapInPandas(fn, schema)
    index_path = out_dir.rstrip("/") + "_index"
    listing.write.mode("overwrite").parquet(index_path)
    return spark.read.parquet(index_path)


# ---------------------------------------------------------------- fetch by URL
def checkpointed(df: DataFrame) -> DataFrame:
    """Written below the shared folder and read back, so that URLs are looked up once."""
    path = scratch_path(df.sparkSession, "urls")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# URL schemes that have a Hadoop-compatible filesystem here.
FETCHABLE = ("file:", "/", "s3://", "s3a://", "hdfs://", "gs://")


def _resolve(url: str, cache: dict):
    from pyarrow import fs
    if url.startswith("/") or url.startswith("file:"):
        if "local" not in cache:
            cache["local"] = fs.LocalFileSystem()
        return cache["local"], "/" + url.split(":", 1)[1].lstrip("/") if url.startswith("file:") else url
    u = "s3://" + url[len("s3a://"):] if url.startswith("s3a://") else url
    root = u.split("/", 3)[:3]
    key = "/".join(root)
    if key not in cache:
        cache[key] = fs.FileSystem.from_uri(key)[0]
    return cache[key], u.split("://", 1)[1]


#: bytes of contents a task gathers before it hands them on
FETCH_BATCH_BYTES = 32 << 20


def _stat(url: str | None, cache: dict):
    """(length, status) of one URL."""
    if url is None or not url.startswith(FETCHABLE):
        return None, "unsupported_scheme"
    try:
        filesystem, path = _resolve(url, cache)
        info = filesystem.get_file_info(path)
        if not info.is_file:
            return None, "not_found"
        return info.size, "ok" if info.size else "empty"
    except Exception:  # noqa: BLE001 - recorded per row, the job goes on
        return None, "fetch_error"


def _look(url: str | None, cache: dict, max_bytes: int | None):
    """(content, status) of one URL; its size is checked before anything is read."""
    if url is None or not url.startswith(FETCHABLE):
        return None, "unsupported_scheme"
    try:
        filesystem, path = _resolve(url, cache)
        with filesystem.open_input_file(path) as f:
            size = f.size()
            if size == 0:
                return b"", "empty"
            if max_bytes is not None and size > max_bytes:
                return None, "too_large"
            return f.read(), "ok"
    except FileNotFoundError:
        return None, "not_found"
    except Exception:  # noqa: BLE001 - recorded per row, the job goes on
        return None, "fetch_error"


def fetch_by_url(df: DataFrame, url_col: str = "url", out_col: str = "content", max_bytes: int | None = None) -> DataFrame:
    """Read each row's bytes by URL (one filesystem handle per scheme/bucket and
    task). Adds ``content`` and ``fetch_status`` (ok / empty / too_large /
    not_found / unsupported_scheme / fetch_error); nothing is dropped, so a
    caller routes non-ok rows to its reject table.

    Files over ``max_bytes`` are not read. Rows leave the task whenever
    ``FETCH_BATCH_BYTES`` have gathered; other columns pass through as they are.
    """
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.BinaryType()),
                                                     T.StructField("fetch_status", T.StringType())])

    def run(batches):
        cache: dict = {}
        for batch in batches:
            urls, start, size, contents, states = batch.column(url_col).to_pylist(), 0, 0, [], []
            for i, url in enumerate(urls):
                content, status = _look(url, cache, max_bytes)
                contents.append(content)
                states.append(status)
                size += len(content or b"")
                if size >= FETCH_BATCH_BYTES or i == len(urls) - 1:
                    rows = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(contents, pa.binary()), pa.array(states, pa.string())], schema.fieldNames())
                    start, size, contents, states = i + 1, 0, [], []

    return df.mapInArrow(run, schema)


def url_sizes(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` plus ``length`` (null if the URL names no readable file) and ``fetch_status``; nothing is read."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField("length", T.LongType()), T.StructField("fetch_status", T.StringType())])

    def run(batches):
        cache: dict = {}
        for batch in batches:
            found = [_stat(u, cache) for u in batch.column(url_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.string())],
                                             schema.fieldNames())

    return df.mapInArrow(run, schema)


#: bytes of files, and files, that a task fetches
TASK_BYTES = 64 << 20
FILE_COST = 64 << 10
#: beyond so many tasks, one has at least so many small files
FEW_TASKS, TASK_FILES = 64, 512


def deal_by_bytes(sized: DataFrame, url_col: str = "url", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows with a ``length`` dealt to tasks of about ``task_bytes`` each, in URL order.

    Running sums of the lengths (``FILE_COST`` added for each file) name the
    task, so a few huge files and many tiny ones make tasks of equal work. Very
    many tiny ones make no more than ``FEW_TASKS`` tasks, or one per ``TASK_FILES``
    files, so that what a task costs besides its files stays a small share.
    """
    length = F.coalesce("length", F.lit(0))
    cost = length + FILE_COST
    total, size, files = sized.agg(F.sum(cost), F.sum(length), F.count(F.lit(1))).first()
    enough = max(FEW_TASKS, -(-(size or 0) // task_bytes) + -(-files // TASK_FILES))
    tasks = min(max(1, -(-(total or 0) // task_bytes)), enough)
    share = max(task_bytes, -(-(total or 0) // tasks))
    placed = running_sums(sized, [], [url_col], {"_upto": cost})
    task = F.least(F.floor((F.col("_upto") - 1) / share), F.lit(tasks - 1)).cast("int")
    return placed.withColumn("_task", task).repartitionById(tasks, F.col("_task")).drop("_upto", "_task")


#: reject reasons of what could not be fetched
FETCH_REASONS = {"empty": "empty_image", "too_large": "file_too_large", "not_found": "unresolved_url", "fetch_error": "unresolved_url",
                 "unsupported_scheme": "unsupported_scheme"}


def fetched_images(urls: DataFrame, url_col: str = "url", max_bytes: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``(url, data, height, width, nChannels, reject_reason)`` of distinct URLs: looked up, dealt to tasks by bytes, fetched and decoded there.

    Bytes and pixels never leave the task that fetched them unless the caller shuffles them.
    """
    sized = checkpointed(url_sizes(urls.select(url_col), url_col))
    status = F.when((F.col("fetch_status") == "ok") & (F.col("length") > (1 << 62 if max_bytes is None else max_bytes)), "too_large").otherwise(F.col("fetch_status"))
    known = F.create_map(*[F.lit(x) for kv in FETCH_REASONS.items() for x in kv])
    good = deal_by_bytes(sized.where(status == "ok").select(url_col, "length"), url_col, task_bytes).select(url_col)
    got = fetch_by_url(good, url_col, max_bytes=max_bytes)
    images = decode_bytes(got.withColumn("reject_reason", F.try_element_at(known, F.col("fetch_status"))).drop("fetch_status"))
    bad = sized.where(status != "ok").select(url_col, F.try_element_at(known, status).alias("reject_reason"))
    return images.unionByName(bad, allowMissingColumns=True)
