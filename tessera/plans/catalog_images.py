"""Registered queries: validation, payload joins and image operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import images as I
from ..models.base import EncoderSpec
from ..models.builtin import PixelGridEncoder
from ..operators.encode import apply_encoder
from ..operators.validate import resolve_payloads, split_valid, validate
from ..session import prepare, scratch_path, table
from ..sources.dataset import document_samples, page_samples
from ..sources.images import raster_fixture, scan_bytes, scan_images, write_image_files
from .embed_job import explode_vectors

UPLOAD_MAX_MB = 0.01
HOT_URL_ROWS = 100_000  # samples per URL above which the URL is salted
GRID = 4

PART_DIMS_SQL = """
SELECT p_partkey, p_size * 40 AS width, p_size * 30 AS height,
       CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS channels
FROM part"""


def _part_dims(spark, sf_dir):
    prepare(spark)
    p = table(spark, sf_dir, "part")
    m = F.pmod(F.col("p_partkey"), F.lit(3))
    return p.select("p_partkey", (F.col("p_size") * 40).alias("width"), (F.col("p_size") * 30).alias("height"),
                    F.when(m == 0, 1).when(m == 1, 3).otherwise(4).alias("channels"), "p_type", "p_brand",
                    "p_size", "p_retailprice")


@register("decoded_size_filter", f"""
SELECT p_partkey, width, height, channels, round(width::BIGINT * height * channels / 1048576.0, 6) AS size_mb
FROM ({PART_DIMS_SQL}) WHERE NOT (width::BIGINT * height * channels / 1048576.0 > 10.0)""")
def decoded_size_filter(spark, sf_dir):
    """Images whose decoded size (w*h*channels) is within 10 MB (equality passes)."""
    d = _part_dims(spark, sf_dir)
    ok = d.where(I.within_decoded_limit("width", "height", "channels", I.DEFAULT_MAX_MB))
    return ok.select("p_partkey", "width", "height", "channels",
                     F.round(I.decoded_size_mb("width", "height", "channels"), 6).alias("size_mb"))


@register("resize_dims", f"""
SELECT p_partkey,
       CASE WHEN width <= 1024 AND height <= 1024 THEN width
            ELSE greatest(1, CAST(trunc(width * least(1024.0 / width, 1024.0 / height)) AS INTEGER)) END AS new_width,
       CASE WHEN width <= 1024 AND height <= 1024 THEN height
            ELSE greatest(1, CAST(trunc(height * least(1024.0 / width, 1024.0 / height)) AS INTEGER)) END AS new_height
FROM ({PART_DIMS_SQL})""")
def resize_dims(spark, sf_dir):
    """Fit-inside-1024 target sizes (aspect kept, truncated to ints)."""
    d = _part_dims(spark, sf_dir)
    nw, nh = I.resize_dims("width", "height", 1024, 1024)
    return d.select("p_partkey", nw.alias("new_width"), nh.alias("new_height"))


@register("upload_size_filter", f"""
SELECT page_id, CAST(strlen(html) AS BIGINT) AS size_bytes FROM pages
WHERE NOT (strlen(html) / 1048576.0 > {UPLOAD_MAX_MB})""")
def upload_size_filter(spark, sf_dir):
    """Payloads (page bytes) within the upload limit."""
    p = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size_bytes"))
    return p.where(~(I.raw_size_mb("size_bytes") > F.lit(UPLOAD_MAX_MB)))


REQ_SQL = """
SELECT p_partkey AS request_id,
       CASE p_type WHEN 'PROMO' THEN 'application/octet-stream' WHEN 'ECONOMY' THEN NULL ELSE 'image/png' END AS content_type,
       CASE WHEN p_size = 1 THEN 0 ELSE CAST(p_retailprice * 11000 AS BIGINT) END AS n_bytes,
       p_brand <> 'Brand#13' AS decoded_ok,
       p_size * 40 AS width, CASE WHEN p_size = 2 THEN 0 ELSE p_size * 30 END AS height,
       CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS channels
FROM part"""


def _requests(spark, sf_dir):
    d = _part_dims(spark, sf_dir)
    return d.select(
        F.col("p_partkey").alias("request_id"),
        F.when(F.col("p_type") == "PROMO", "application/octet-stream")
         .when(F.col("p_type") == "ECONOMY", F.lit(None)).otherwise("image/png").alias("content_type"),
        F.when(F.col("p_size") == 1, F.lit(0).cast("long"))
         .otherwise((F.col("p_retailprice") * 11000).cast("long")).alias("n_bytes"),
        (F.col("p_brand") != "Brand#13").alias("decoded_ok"), "width",
        F.when(F.col("p_size") == 2, 0).otherwise(F.col("height")).alias("height"), "channels")


@register("validate_requests", f"""
SELECT request_id,
  CASE WHEN content_type IS NULL OR NOT starts_with(content_type, 'image/') THEN 'invalid_content_type'
       WHEN n_bytes / 1048576.0 > 10.0 THEN 'file_too_large'
       WHEN n_bytes = 0 THEN 'empty_image'
       WHEN NOT coalesce(decoded_ok, false) THEN 'undecodable_image'
       WHEN width <= 0 OR height <= 0 THEN 'invalid_dimensions'
       WHEN width::BIGINT * height * channels / 1048576.0 > 10.0 THEN 'image_too_large' END AS reject_reason,
  CASE WHEN content_type IS NOT NULL AND starts_with(content_type, 'image/') AND NOT n_bytes / 1048576.0 > 10.0
        AND n_bytes <> 0 AND coalesce(decoded_ok, false) AND width > 0 AND height > 0
        AND NOT width::BIGINT * height * channels / 1048576.0 > 10.0 THEN 200 ELSE 400 END AS http_status
FROM ({REQ_SQL})""")
def validate_requests(spark, sf_dir):
    """Every request with its first failing rule (or none) and status class."""
    v = validate(_requests(spark, sf_dir), content_type="content_type", n_bytes="n_bytes", decoded_ok="decoded_ok",
                 width="width", height="height", channels="channels")
    acc, rej = split_valid(v)
    return acc.unionByName(rej).select("request_id", "reject_reason", "http_status")


SAMPLE_URLS_SQL = """
SELECT url, 'page_' || CAST(page_id AS VARCHAR) AS key FROM pages
UNION ALL SELECT 'doc://' || source || '/' || CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR) FROM documents"""


def _samples_and_payloads(spark, sf_dir):
    prepare(spark)
    pages = table(spark, sf_dir, "pages")
    samples = page_samples(pages).select("url", "key").unionByName(
        document_samples(table(spark, sf_dir, "documents")).select("url", "key"))
    payloads = pages.select("url", F.encode("html", "UTF-8").alias("content"))
    return samples, payloads


@register("url_payload_join", f"""
SELECT s.key, s.url, CAST(strlen(p.html) AS BIGINT) AS n_bytes, md5(p.html) AS content_md5
FROM ({SAMPLE_URLS_SQL}) s JOIN pages p ON s.url = p.url""")
def url_payload_join(spark, sf_dir):
    """Samples joined to their payload bytes by URL (misses dropped)."""
    samples, payloads = _samples_and_payloads(spark, sf_dir)
    resolved, _ = resolve_payloads(samples, payloads, hot_threshold=HOT_URL_ROWS)
    return resolved.select("key", "url", F.octet_length("content").cast("long").alias("n_bytes"),
                           F.md5("content").alias("content_md5"))


@register("unresolved_urls", f"""
SELECT s.key, s.url, 'unresolved_url' AS reject_reason
FROM ({SAMPLE_URLS_SQL}) s WHERE s.url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)""")
def unresolved_urls(spark, sf_dir):
    """Samples whose URL has no payload go to the reject table."""
    samples, payloads = _samples_and_payloads(spark, sf_dir)
    _, unresolved = resolve_payloads(samples, payloads, hot_threshold=HOT_URL_ROWS)
    return unresolved.select("key", "url", "reject_reason")


# ---------------------------------------------------------------- image files
_IMAGES: dict = {}


def _image_dir(spark, sf_dir):
    key = (sf_dir, scratch_path(spark, unique=False))
    if key not in _IMAGES:
        out = scratch_path(spark, "images")
        index = write_image_files(raster_fixture(table(spark, sf_dir, "embeddings")), out)
        _IMAGES[key] = (out, index)
    return _IMAGES[key]


IMG_RULES_SQL = """
SELECT vec_id, label, CASE label % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS c,
       CASE WHEN vec_id % 10 = 7 THEN 'junk' WHEN vec_id % 10 = 8 THEN 'truncated' WHEN vec_id % 10 = 9 THEN 'empty'
            WHEN label % 3 = 1 AND vec_id % 2 = 1 THEN 'bmp' ELSE 'png' END AS kind, embedding
FROM embeddings"""


@register("image_scan", f"""
SELECT printf('img_%05d.', vec_id) || CASE kind WHEN 'bmp' THEN 'bmp' ELSE 'png' END AS name,
       8 AS height, 8 AS width, c AS nChannels,
       CASE c WHEN 1 THEN 'L' WHEN 3 THEN 'RGB' ELSE 'RGBA' END AS mode_name
FROM ({IMG_RULES_SQL}) WHERE kind IN ('png', 'bmp')""")
def image_scan(spark, sf_dir):
    """Decoded-image scan of PNG/BMP files written from the vectors; junk and
    truncated files are dropped, empty files are not listed."""
    out, _ = _image_dir(spark, sf_dir)
    img = scan_images(spark, out)
    return img.select(F.regexp_extract("file", r"[^/]+$", 0).alias("name"), "height", "width", "nChannels",
                      I.mode_name("nChannels").alias("mode_name"))


@register("image_info", f"""
SELECT printf('img_%05d.', vec_id) || CASE kind WHEN 'bmp' THEN 'bmp' ELSE 'png' END AS name,
       8 AS width, 8 AS height, CASE c WHEN 1 THEN 'L' WHEN 3 THEN 'RGB' ELSE 'RGBA' END AS mode,
       CASE kind WHEN 'bmp' THEN 'BMP' ELSE 'PNG' END AS format, c AS channels
FROM ({IMG_RULES_SQL}) WHERE kind IN ('png', 'bmp')""")
def image_info(spark, sf_dir):
    """width / height / mode / format / channels of the source images."""
    out, _ = _image_dir(spark, sf_dir)
    img = scan_images(spark, out).select("file", "width", "height", "nChannels")
    raw = scan_bytes(spark, out).select("file", I.format_name("content").alias("format"))
    j = img.join(raw, "file")
    return j.select(F.regexp_extract("file", r"[^/]+$", 0).alias("name"), "width", "height",
                    I.mode_name("nChannels").alias("mode"), "format", F.col("nChannels").alias("channels"))


@register("image_bytes", f"""
SELECT vec_id, printf('img_%05d.', vec_id) || CASE kind WHEN 'bmp' THEN 'bmp' ELSE 'png' END AS name,
       CAST(CASE kind WHEN 'junk' THEN 12 WHEN 'bmp' THEN 246 END AS BIGINT) AS length
FROM ({IMG_RULES_SQL}) WHERE kind <> 'empty'""")
def image_bytes(spark, sf_dir):
    """Bytes by file URL: samples (every vector's file URL, missing ones too) joined
    to the binary-file scan; lengths of files whose size the rules fix (PNG sizes depend on compression;
    the scan lists no empty files)."""
    out, index = _image_dir(spark, sf_dir)
    raw = scan_bytes(spark, out).select("file", "length")
    samples = index.select("vec_id", "file")
    resolved, _ = resolve_payloads(samples, raw, "file", "file")
    name = F.regexp_extract("file", r"[^/]+$", 0)
    fixed = name.endswith(".bmp") | (F.col("vec_id") % 10 == 7)
    return resolved.select("vec_id", name.alias("name"), F.when(fixed, F.col("length")).alias("length"))


PIXELS_SQL = f"""
px AS (
  SELECT vec_id, c, kind, generate_subscripts(embedding, 1) - 1 AS i,
         CAST(least(greatest(floor((unnest(CAST(embedding AS DOUBLE[])) + 1) * 127.5), 0), 255) AS INTEGER) AS p
  FROM ({IMG_RULES_SQL}))"""


@register("to_rgb", f"""
WITH {PIXELS_SQL},
rgb AS (
  SELECT vec_id, i,
         CASE c WHEN 1 THEN printf('%02X%02X%02X', p, p, p)
                ELSE printf('%02X%02X%02X', (p + 80) % 256, (p + 40) % 256, p) END AS h
  FROM px WHERE kind IN ('png', 'bmp'))
SELECT vec_id, string_agg(h, '' ORDER BY i) AS rgb_hex FROM rgb GROUP BY vec_id""")
def to_rgb(spark, sf_dir):
    """Decoded images converted to RGB bytes (gray replicated, BGR reversed, alpha dropped)."""
    out, _ = _image_dir(spark, sf_dir)
    img = scan_images(spark, out)
    vid = F.regexp_extract("file", r"img_([0-9]+)\.", 1).cast("long")
    return img.select(vid.alias("vec_id"),
                      F.hex(I.to_rgb_bytes("data", "height", "width", "nChannels")).alias("rgb_hex"))


@register("encode_image", f"""
WITH {PIXELS_SQL},
g AS (
  SELECT vec_id, (i // 8 // 2) * 4 + (i % 8) // 2 AS cell,
         CASE c WHEN 1 THEN p ELSE (p + (p + 40) % 256 + (p + 80) % 256) / 3.0 END / 255.0 AS v
  FROM px WHERE kind IN ('png', 'bmp')),
f AS (SELECT vec_id, cell, avg(v) AS x FROM g GROUP BY vec_id, cell),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM f GROUP BY vec_id)
SELECT CAST(f.vec_id AS VARCHAR) AS key, CAST(cell AS INTEGER) AS dim, round(x / nrm, 6) AS value
FROM f JOIN n USING (vec_id) WHERE x <> 0""")
def encode_image(spark, sf_dir):
    """Pixel-grid image encoder over decoded files, through the batched model UDF."""
    out, _ = _image_dir(spark, sf_dir)
    img = scan_images(spark, out)
    key = F.regexp_extract("file", r"img_([0-9]+)\.", 1).cast("long").cast("string")
    src = img.select(key.alias("key"), "data", "height", "width", "nChannels")
    enc = apply_encoder(src, EncoderSpec.of(PixelGridEncoder, grid=GRID),
                        image_cols=("data", "height", "width", "nChannels"))
    return explode_vectors(enc, "key")


@register("resize_pixels", f"""
SELECT printf('img_%05d.', vec_id) || CASE kind WHEN 'bmp' THEN 'bmp' ELSE 'png' END AS name,
       4 AS width, 4 AS height, c AS nChannels, 16 * c AS n_bytes
FROM ({IMG_RULES_SQL}) WHERE kind IN ('png', 'bmp')""")
def resize_pixels(spark, sf_dir):
    """Lanczos-3 resize of decoded images to fit 4x4 (pixels in a pandas UDF): sizes; pixels are checked by property tests."""
    out, _ = _image_dir(spark, sf_dir)
    img = scan_images(spark, out)
    r = img.select("file", I.resize_pixels(4, 4)("data", "height", "width", "nChannels").alias("img"))
    return r.select(F.regexp_extract("file", r"[^/]+$", 0).alias("name"), "img.width", "img.height",
                    "img.nChannels", F.octet_length("img.data").alias("n_bytes"))


# ---------------------------------------------------------------- multimodal classifier
from ..models.builtin import MultimodalClassifier  # noqa: E402

N_CLASSES = 10
CLS_TEXT_DIM = 16


@register("classify_logits", f"""
WITH {PIXELS_SQL},
g AS (
  SELECT vec_id, (i // 8 // 2) * 4 + (i % 8) // 2 AS cell,
         CASE c WHEN 1 THEN p ELSE (p + (p + 40) % 256 + (p + 80) % 256) / 3.0 END / 255.0 AS v
  FROM px WHERE kind IN ('png', 'bmp')),
f AS (SELECT vec_id, cell, avg(v) AS x FROM g GROUP BY vec_id, cell),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM f GROUP BY vec_id),
imgf AS (SELECT f.vec_id, {CLS_TEXT_DIM} + cell AS j, x / nrm AS x FROM f JOIN n USING (vec_id)),
ids AS (SELECT DISTINCT vec_id FROM imgf),
toks AS (SELECT doc_id AS vec_id, lower(t) AS tok
         FROM documents, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS u(t)
         WHERE t <> '' AND doc_id IN (SELECT vec_id FROM ids)),
tb AS (SELECT vec_id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {CLS_TEXT_DIM} AS j,
              CAST(count(*) AS DOUBLE) AS c FROM toks GROUP BY ALL),
tn AS (SELECT vec_id, sqrt(sum(c * c)) AS nrm FROM tb GROUP BY vec_id),
feat AS (SELECT * FROM imgf UNION ALL SELECT tb.vec_id, tb.j, c / nrm FROM tb JOIN tn USING (vec_id))
SELECT vec_id, CAST(k AS INTEGER) AS class,
       round(coalesce(sum(x * ((((31 * k + 17 * j) % 101) - 50) / 50.0)), 0.0), 4) + 0.0 AS logit
FROM ids CROSS JOIN range({N_CLASSES}) AS r(k) LEFT JOIN feat USING (vec_id) GROUP BY vec_id, k""")
def classify_logits(spark, sf_dir):
    """Text (document with the same id) + image features -> fixed linear head -> 10 logits."""
    out, _ = _image_dir(spark, sf_dir)
    img = scan_images(spark, out)
    vid = F.regexp_extract("file", r"img_([0-9]+)\.", 1).cast("long")
    imgs = img.select(vid.alias("vec_id"), "data", "height", "width", "nChannels")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    src = imgs.join(docs, "vec_id", "left")
    spec = EncoderSpec.of(MultimodalClassifier, n_classes=N_CLASSES, text_dim=CLS_TEXT_DIM, grid=GRID)
    enc = apply_encoder(src, spec, text_col="text", image_cols=("data", "height", "width", "nChannels"),
                        output_col="logits")
    return enc.select("vec_id", F.posexplode("logits").alias("class", "logit")).select(
        "vec_id", F.col("class").cast("int").alias("class"), F.round("logit", 4).alias("logit"))


# ---------------------------------------------------------------- image embedding job
from .embed_job import embed_image_dataset  # noqa: E402

_IMAGE_JOBS: dict = {}


def _image_job(spark, sf_dir):
    key = (sf_dir, scratch_path(spark, unique=False))
    if key not in _IMAGE_JOBS:
        out, index = _image_dir(spark, sf_dir)
        emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
        samples = index.join(emb, "vec_id").select(
            F.col("file").alias("url"), F.col("vec_id").cast("string").alias("key"), "label")
        dest = scratch_path(spark, "image_job")
        embed_image_dataset(spark, samples, out, dest, EncoderSpec.of(PixelGridEncoder, grid=GRID),
                            hot_threshold=HOT_URL_ROWS)
        _IMAGE_JOBS[key] = dest
    return _IMAGE_JOBS[key]


@register("image_embed_job", f"""
WITH {PIXELS_SQL},
g AS (
  SELECT vec_id, (i // 8 // 2) * 4 + (i % 8) // 2 AS cell,
         CASE c WHEN 1 THEN p ELSE (p + (p + 40) % 256 + (p + 80) % 256) / 3.0 END / 255.0 AS v
  FROM px WHERE kind IN ('png', 'bmp')),
f AS (SELECT vec_id, cell, avg(v) AS x FROM g GROUP BY vec_id, cell),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM f GROUP BY vec_id)
SELECT CAST(f.vec_id AS VARCHAR) AS key, CAST(cell AS INTEGER) AS dim, round(x / nrm, 6) AS value,
       e.label AS meta_label
FROM f JOIN n USING (vec_id) JOIN embeddings e ON e.vec_id = f.vec_id WHERE x <> 0""")
def image_embed_job(spark, sf_dir):
    """Image dataset job: samples -> decoded images by URL -> validation -> encoder -> parquet (read back)."""
    df = spark.read.parquet(_image_job(spark, sf_dir) + "/samples.parquet").where(F.col("status") == "accepted")
    ex = df.select("key", "meta_label", F.posexplode("embedding").alias("dim", "value")).where(F.col("value") != 0)
    return ex.select("key", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"), "meta_label")


@register("image_reject_table", f"""
SELECT CAST(vec_id AS VARCHAR) AS key,
       CASE kind WHEN 'empty' THEN 'empty_image' ELSE 'undecodable_image' END AS reject_reason
FROM ({IMG_RULES_SQL}) WHERE kind IN ('junk', 'truncated', 'empty')""")
def image_reject_table(spark, sf_dir):
    """Reject table of the image job: undecodable and empty files (and URLs with no file)."""
    df = spark.read.parquet(_image_job(spark, sf_dir) + "/samples.parquet").where(F.col("status") == "rejected")
    return df.select("key", "reject_reason")


@register("image_run_totals", f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE kind IN ('png', 'bmp')) AS BIGINT) AS processed,
       CAST(count(*) FILTER (WHERE kind NOT IN ('png', 'bmp')) AS BIGINT) AS skipped
FROM ({IMG_RULES_SQL})""")
def image_run_totals(spark, sf_dir):
    """Samples of the image job: all, processed, skipped."""
    df = spark.read.parquet(_image_job(spark, sf_dir) + "/samples.parquet")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "accepted").alias("processed"),
                  F.count_if(F.col("status") == "rejected").alias("skipped"))


from ..sources.images import fetch_by_url  # noqa: E402


@register("url_fetch", f"""
SELECT CAST(vec_id AS VARCHAR) AS key, CASE kind WHEN 'empty' THEN 'empty' ELSE 'ok' END AS fetch_status,
       kind <> 'empty' AS has_bytes FROM ({IMG_RULES_SQL})
UNION ALL
SELECT 'bak_' || CAST(vec_id AS VARCHAR), 'not_found', false FROM embeddings WHERE label = 0
UNION ALL
SELECT 'doc_' || CAST(doc_id AS VARCHAR), 'unsupported_scheme', false FROM documents""")
def url_fetch(spark, sf_dir):
    """Bytes fetched per URL (image files, missing backups, non-fetchable doc:// URLs)."""
    _, index = _image_dir(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    files = index.select(F.col("vec_id").cast("string").alias("key"), F.col("file").alias("url"))
    baks = index.join(emb.where(F.col("label") == 0), "vec_id").select(
        F.concat(F.lit("bak_"), F.col("vec_id").cast("string")).alias("key"),
        F.concat(F.col("file"), F.lit(".bak")).alias("url"))
    docs = document_samples(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("doc_"), F.col("key")).alias("key"), "url")
    got = fetch_by_url(files.unionByName(baks).unionByName(docs))
    return got.select("key", "fetch_status",
                      F.coalesce(F.octet_length("content") > 0, F.lit(False)).alias("has_bytes"))


# ---------------------------------------------------------------- bytes and URLs
from ..functions.codecs import decode_bytes as decode_column  # noqa: E402
from ..sources.dataset import scan_dataset  # noqa: E402


@register("decode_bytes", f"""
WITH {PIXELS_SQL},
hx AS (SELECT vec_id, i, c, CASE c WHEN 1 THEN printf('%02X', p) WHEN 3 THEN printf('%02X%02X%02X', p, (p + 40) % 256, (p + 80) % 256)
              ELSE printf('%02X%02X%02X%02X', p, (p + 40) % 256, (p + 80) % 256, (p + 120) % 256) END AS h
       FROM px WHERE kind IN ('png', 'bmp'))
SELECT vec_id, 8 AS height, 8 AS width, any_value(c) AS channels, string_agg(h, '' ORDER BY i) AS pixels_hex, CAST(NULL AS VARCHAR) AS reject_reason
FROM hx GROUP BY vec_id
UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, 'undecodable_image' FROM ({IMG_RULES_SQL}) WHERE kind IN ('junk', 'truncated')""")
def decode_bytes(spark, sf_dir):
    """A bytes column decoded in Arrow batches (the files' contents): pixels, or the reason for none."""
    out, _ = _image_dir(spark, sf_dir)
    content = scan_bytes(spark, out).select(F.regexp_extract("file", r"img_([0-9]+)\.", 1).cast("long").alias("vec_id"), "content")
    return decode_column(content).select("vec_id", "height", "width", F.col("nChannels").alias("channels"), F.hex("data").alias("pixels_hex"), "reject_reason")


_URL_JOBS: dict = {}
URL_CAP = 100
URL_TASK_BYTES = 1 << 20

URL_RULES_SQL = f"""
SELECT *, CASE WHEN vec_id % 17 = 3 THEN 'unsupported_scheme' WHEN vec_id % 13 = 5 THEN 'unresolved_url'
               WHEN kind = 'empty' THEN 'empty_image' WHEN kind IN ('junk', 'truncated') THEN 'undecodable_image' END AS reason
FROM ({IMG_RULES_SQL})"""


def _url_samples(spark, sf_dir):
    """A dataset whose image URLs lie in two folders; some name no file, some another scheme."""
    key = (sf_dir, scratch_path(spark, unique=False), "samples")
    if key not in _URL_JOBS:
        emb = table(spark, sf_dir, "embeddings")
        parts = [write_image_files(raster_fixture(emb.where(F.pmod("vec_id", F.lit(2)) == k)), scratch_path(spark, f"images_{k}")) for k in (0, 1)]
        files = parts[0].unionByName(parts[1]).join(emb.select("vec_id", "label"), "vec_id")
        url = (F.when(F.pmod("vec_id", F.lit(17)) == 3, F.concat(F.lit("ftp://host"), F.col("file")))
               .when(F.pmod("vec_id", F.lit(13)) == 5, F.concat(F.col("file"), F.lit(".bak"))).otherwise(F.col("file")))
        root = scratch_path(spark, "url_dataset")
        (files.select(url.alias("url"), F.col("vec_id").cast("string").alias("key"), "label", "vec_id")
         .repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").drop("vec_id").write.parquet(root))
        _URL_JOBS[key] = root
    return scan_dataset(spark, _URL_JOBS[key])


def _url_job(spark, sf_dir, cap=None):
    key = (sf_dir, scratch_path(spark, unique=False), cap)
    if key not in _URL_JOBS:
        dest = scratch_path(spark, "url_job")
        embed_image_dataset(spark, _url_samples(spark, sf_dir), None, dest, EncoderSpec.of(PixelGridEncoder, grid=GRID),
                            max_samples=cap, task_bytes=URL_TASK_BYTES)
        _URL_JOBS[key] = dest
    return spark.read.parquet(_URL_JOBS[key] + "/samples.parquet")


@register("image_url_job", f"""
WITH {PIXELS_SQL},
g AS (
  SELECT vec_id, (i // 8 // 2) * 4 + (i % 8) // 2 AS cell,
         CASE c WHEN 1 THEN p ELSE (p + (p + 40) % 256 + (p + 80) % 256) / 3.0 END / 255.0 AS v
  FROM px WHERE vec_id IN (SELECT vec_id FROM ({URL_RULES_SQL}) WHERE reason IS NULL)),
f AS (SELECT vec_id, cell, avg(v) AS x FROM g GROUP BY vec_id, cell),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM f GROUP BY vec_id)
SELECT CAST(f.vec_id AS VARCHAR) AS key, CAST(cell AS INTEGER) AS dim, round(x / nrm, 6) AS value, e.label AS meta_label
FROM f JOIN n USING (vec_id) JOIN embeddings e ON e.vec_id = f.vec_id WHERE x <> 0""")
def image_url_job(spark, sf_dir):
    """Image job by URL: files of two folders fetched, decoded and encoded in the task they are dealt to."""
    df = _url_job(spark, sf_dir).where(F.col("status") == "accepted")
    ex = df.select("key", "meta_label", F.posexplode("embedding").alias("dim", "value")).where(F.col("value") != 0)
    return ex.select("key", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"), "meta_label")


@register("image_url_rejects", f"""
SELECT CAST(vec_id AS VARCHAR) AS key, reason AS reject_reason FROM ({URL_RULES_SQL}) WHERE reason IS NOT NULL""")
def image_url_rejects(spark, sf_dir):
    """Reject table of the image job by URL."""
    return _url_job(spark, sf_dir).where(F.col("status") == "rejected").select("key", "reject_reason")


@register("image_url_capped", f"""
SELECT CAST(vec_id AS VARCHAR) AS key, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason AS reject_reason
FROM (SELECT *, count(*) FILTER (WHERE reason IS NULL) OVER (ORDER BY vec_id) - (reason IS NULL)::INT AS before FROM ({URL_RULES_SQL})) WHERE before < {URL_CAP}""")
def image_url_capped(spark, sf_dir):
    """The same job with a cap on accepted samples, in (shard, row) order."""
    return _url_job(spark, sf_dir, URL_CAP).select("key", "status", "reject_reason")
