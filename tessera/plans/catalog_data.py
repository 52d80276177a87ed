"""Registered queries: dataset scan, projections, encoders, sinks, ordinals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..catalog import register
from ..models.base import EncoderSpec
from ..models.builtin import ConstantEncoder, HashTextEncoder
from ..operators.encode import apply_encoder
from ..session import prepare, scratch_path, table
from ..sources.dataset import document_samples
from .embed_job import explode_vectors

TEXT_DIM = 64
HASH_TEXT = EncoderSpec.of(HashTextEncoder, dim=TEXT_DIM)

# DuckDB form of the hashing text encoder: (key, dim, value) of non-zero buckets.
HASH_TEXT_SQL = """
WITH toks AS (
  SELECT CAST(doc_id AS VARCHAR) AS key, lower(t) AS tok
  FROM documents, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS u(t)
  WHERE t <> ''
), b AS (
  SELECT key, CAST(CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {dim} AS INTEGER) AS dim,
         CAST(count(*) AS DOUBLE) AS c
  FROM toks GROUP BY key, dim
), n AS (SELECT key, sqrt(sum(c * c)) AS nrm FROM b GROUP BY key)
SELECT b.key, b.dim, round(b.c / n.nrm, 6) AS value FROM b JOIN n USING (key)
"""


@register("encode_text", HASH_TEXT_SQL.format(dim=TEXT_DIM))
def encode_text(spark, sf_dir):
    """Hashing text encoder applied to every document through the batched model UDF."""
    prepare(spark)
    samples = document_samples(table(spark, sf_dir, "documents")).select("key", "caption")
    enc = apply_encoder(samples, HASH_TEXT, text_col="caption")
    return explode_vectors(enc, "key")


@register("encode_constant", """
SELECT CAST(doc_id AS VARCHAR) AS key, '[0.1,0.2,0.3]' AS embedding_json FROM documents
""")
def encode_constant(spark, sf_dir):
    """The test-mock encoder ([0.1, 0.2, 0.3] per row) through the same wrapper."""
    prepare(spark)
    samples = document_samples(table(spark, sf_dir, "documents")).select("key", "caption")
    enc = apply_encoder(samples, EncoderSpec.of(ConstantEncoder), text_col="caption")
    return enc.select("key", F.to_json("embedding").alias("embedding_json"))


# ---------------------------------------------------------------- sources
from ..functions import urls  # noqa: E402
from ..operators.samples import (assign_workers, first_samples, fixed_batches, flatten_metadata,  # noqa: E402
                                 pack_metadata, sample_projection, scan_ordinal)
from ..operators.scan import ordinal  # noqa: E402
from ..sinks.files import write_dataset_manifest  # noqa: E402
from ..sources.dataset import (SHARD_COL, list_shards, sample_dataset,  # noqa: E402
                               scan_dataset, scan_shards, write_shards)
from .embed_job import embed_dataset  # noqa: E402

SHARD_ROWS = 250
DATA_COLS = ["url", "caption", "key", "lang", "source", "n_chars", "doc_id", "n_bytes"]

# The two-shape dataset in DuckDB: documents (with caption) and pages (without).
SAMPLES_SQL = """
SELECT 'doc://' || source || '/' || CAST(doc_id AS VARCHAR) AS url, text AS caption,
       CAST(doc_id AS VARCHAR) AS key, lang, source, n_chars, doc_id,
       CAST(NULL AS BIGINT) AS n_bytes, 0 AS grp, doc_id AS id
FROM documents
UNION ALL
SELECT url, CAST(NULL AS VARCHAR), 'page_' || CAST(page_id AS VARCHAR), CAST(NULL AS VARCHAR),
       CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), page_id, CAST(strlen(html) AS BIGINT), 1, page_id
FROM pages
"""


def _dataset(spark, sf_dir):
    return scan_dataset(spark, sample_dataset(spark, sf_dir, SHARD_ROWS))


TABLE_NAMES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders",
               "pages", "part", "region", "supplier")


@register("shard_inventory", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS shard, (SELECT count(*) FROM {t}) AS n_rows, CAST({i} AS BIGINT) AS shard_index" for i, t in enumerate(TABLE_NAMES)))
def shard_inventory(spark, sf_dir):
    """Recursive ``*.parquet`` discovery in lexicographic order, with the rows of each shard.

    Tables stored as a folder of files count as one shard.
    """
    name = F.regexp_extract("path", r"([^/]+\.parquet)(/[^/]+)?$", 1)
    files = list_shards(spark, sf_dir).select(name.alias("shard")).distinct()
    names = [r.shard for r in files.collect()]      # one per table
    rows = reduce(lambda a, b: a.unionByName(b), [
        spark.read.parquet(f"{sf_dir}/{n}").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("shard", F.lit(n)) for n in names])
    return ordinal(rows, [], ["shard"], "shard_index").select("shard", "n_rows", "shard_index")


@register("dataset_scan", f"SELECT {', '.join(DATA_COLS)} FROM ({SAMPLES_SQL})")
def dataset_scan(spark, sf_dir):
    """Merged-schema scan over two differently shaped shard groups."""
    return _dataset(spark, sf_dir).select(*DATA_COLS)


@register("shard_subset", f"""
SELECT key, doc_id FROM ({SAMPLES_SQL}) WHERE id // {SHARD_ROWS} IN (1, 3)
""")
def shard_subset(spark, sf_dir):
    """Only the shards named ``shard=00001`` and ``shard=00003`` (file pruning by path)."""
    root = sample_dataset(spark, sf_dir, SHARD_ROWS)
    return scan_shards(spark, root, ["shard=00001", "shard=00003"]).select("key", "doc_id")


@register("sample_projection", f"SELECT url, caption, key FROM ({SAMPLES_SQL})")
def sample_projection_q(spark, sf_dir):
    return sample_projection(_dataset(spark, sf_dir)).select("url", "caption", "key")


META_JSON_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS key,
       '{"lang":"' || lang || '","source":"' || source || '","n_chars":' || CAST(n_chars AS VARCHAR)
       || ',"doc_id":' || CAST(doc_id AS VARCHAR) || '}' AS metadata_json
FROM documents
UNION ALL
SELECT 'page_' || CAST(page_id AS VARCHAR),
       '{"doc_id":' || CAST(page_id AS VARCHAR) || ',"n_bytes":' || CAST(strlen(html) AS VARCHAR) || '}'
FROM pages
"""


@register("metadata_pack", META_JSON_SQL)
def metadata_pack(spark, sf_dir):
    """Non-core columns packed into a struct (shown as JSON; absent fields omitted)."""
    packed = pack_metadata(sample_projection(_dataset(spark, sf_dir)))
    return packed.select("key", F.to_json("metadata").alias("metadata_json"))


@register("metadata_flatten", f"""
SELECT key, lang AS meta_lang, source AS meta_source, n_chars AS meta_n_chars,
       doc_id AS meta_doc_id, n_bytes AS meta_n_bytes FROM ({SAMPLES_SQL})
""")
def metadata_flatten(spark, sf_dir):
    packed = pack_metadata(sample_projection(_dataset(spark, sf_dir)))
    flat = flatten_metadata(packed)
    return flat.select("key", *[c for c in flat.columns if c.startswith("meta_")])


# URL and key patterns, sizes and source name of the sample dataset's rows.
SYNTH_SQL = """
SELECT printf('s3://sample-bucket/images/img_%05d.jpg', doc_id) AS url,
       printf('Sample image %d: A test image for batch processing', doc_id) AS caption,
       printf('img_%05d', doc_id) AS key, 512 AS width, 512 AS height, 'synthetic' AS source
FROM documents
"""


def _synthetic(spark, sf_dir, out):
    """One synthetic image-dataset row per document id, written as shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.select(
        F.format_string("s3://sample-bucket/images/img_%05d.jpg", "doc_id").alias("url"),
        F.format_string("Sample image %d: A test image for batch processing", "doc_id").alias("caption"),
        F.format_string("img_%05d", "doc_id").alias("key"),
        F.lit(512).alias("width"), F.lit(512).alias("height"), F.lit("synthetic").alias("source"),
        "doc_id")
    write_shards(rows, out, "doc_id", SHARD_ROWS)
    return scan_dataset(spark, out)


@register("synthetic_dataset", SYNTH_SQL)
def synthetic_dataset(spark, sf_dir):
    """Image-dataset generator (url/caption/key/size/source), one row per document id."""
    df = _synthetic(spark, sf_dir, scratch_path(spark, "synthetic"))
    return df.select("url", "caption", "key", "width", "height", "source")


@register("dataset_manifest", f"""
SELECT CAST(count(DISTINCT doc_id // {SHARD_ROWS}) AS BIGINT) AS num_shards,
       CAST(count(*) AS BIGINT) AS num_samples, 'img2dataset' AS format,
       '["url","caption","key","width","height","source","doc_id"]' AS columns_json
FROM documents
""")
def dataset_manifest_q(spark, sf_dir):
    """num_shards / num_samples / format / columns of the generated dataset, written as JSON."""
    out = scratch_path(spark, "synthetic_manifest")
    df = _synthetic(spark, sf_dir, out + "/data")
    m = write_dataset_manifest(df, out + "/metadata.json")
    return m.select("num_shards", "num_samples", "format", F.to_json("columns").alias("columns_json"))


def _embedded(spark, sf_dir):
    out = scratch_path(spark, "embed_job")
    res = embed_dataset(spark, sample_dataset(spark, sf_dir, SHARD_ROWS), out, HASH_TEXT)
    return res


EMBED_SQL = f"""
WITH s AS ({SAMPLES_SQL}),
toks AS (
  SELECT key, lower(t) AS tok FROM s, unnest(regexp_split_to_array(caption, '[^A-Za-z0-9]+')) AS u(t)
  WHERE t <> ''
), b AS (
  SELECT key, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {TEXT_DIM} AS dim, CAST(count(*) AS DOUBLE) AS c
  FROM toks GROUP BY key, dim
), v AS (
  SELECT key, sqrt(sum(c * c)) AS nrm, sum(c * (dim + 1)) AS wsum FROM b GROUP BY key
)
SELECT s.key, s.url, md5(s.caption) AS caption_md5, {TEXT_DIM} AS n_dims,
       CAST(CASE WHEN v.nrm > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS norm,
       round(coalesce(v.wsum / v.nrm, 0.0), 4) AS checksum,
       s.lang AS meta_lang, s.source AS meta_source, s.n_chars AS meta_n_chars,
       s.doc_id AS meta_doc_id, s.n_bytes AS meta_n_bytes
FROM s LEFT JOIN v USING (key)
"""


@register("embeddings_output", EMBED_SQL)
def embeddings_output(spark, sf_dir):
    """Flagship: scan -> project -> encode -> flatten -> parquet sink, read back."""
    return _embedding_rows(spark.read.parquet(_embedded(spark, sf_dir).table))


def _embedding_rows(df):
    e = F.col("embedding")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
    checksum = F.aggregate(F.transform(e, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select("key", "url", F.md5("caption").alias("caption_md5"),
                     F.size(e).alias("n_dims"), F.round(norm, 6).alias("norm"),
                     F.round(checksum, 4).alias("checksum"),
                     "meta_lang", "meta_source", "meta_n_chars", "meta_doc_id", "meta_n_bytes")


@register("run_manifest", f"""
SELECT CAST((SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS BIGINT) AS num_samples,
       '{HASH_TEXT.describe()}' AS model
""")
def run_manifest(spark, sf_dir):
    """Manifest of the embedding job (row count observed during the write)."""
    res = _embedded(spark, sf_dir)
    return spark.read.schema("num_samples long, model string, timestamp double") \
        .json(res.manifest).select("num_samples", "model")


ORDINAL_SQL = f"SELECT key, CAST(row_number() OVER (ORDER BY grp, id) - 1 AS BIGINT) AS ordinal FROM ({SAMPLES_SQL})"


@register("sample_ordinal", ORDINAL_SQL)
def sample_ordinal_q(spark, sf_dir):
    """Position in (shard path, row in shard) order: rows of earlier shards plus the row index."""
    return scan_ordinal(_dataset(spark, sf_dir)).select("key", "ordinal")


MAX_SAMPLES = 500


@register("sample_cap", f"""
SELECT key, ordinal FROM (
  SELECT key, CAST(row_number() OVER (ORDER BY grp, id) - 1 AS BIGINT) AS ordinal
  FROM ({SAMPLES_SQL}) WHERE caption IS NOT NULL)
WHERE ordinal < {MAX_SAMPLES}
""")
def sample_cap(spark, sf_dir):
    """``max_samples`` survivors (rows with a caption) in shard order."""
    survivors = _dataset(spark, sf_dir).where(F.col("caption").isNotNull())
    return first_samples(survivors, MAX_SAMPLES).select("key", "ordinal")


BATCH = 16
WORKERS = 4


@register("fixed_batches", f"""
SELECT CAST(ordinal // {BATCH} AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS batch_size,
       min(key) AS first_key_min
FROM ({ORDINAL_SQL}) GROUP BY 1
""")
def fixed_batches_q(spark, sf_dir):
    b = fixed_batches(scan_ordinal(_dataset(spark, sf_dir)), BATCH)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_size"), F.min("key").alias("first_key_min"))


@register("worker_assignment", f"""
SELECT CAST((ordinal // {BATCH}) % {WORKERS} AS INTEGER) AS worker_id,
       CAST(count(DISTINCT ordinal // {BATCH}) AS BIGINT) AS n_batches, CAST(count(*) AS BIGINT) AS n_samples
FROM ({ORDINAL_SQL}) GROUP BY 1
""")
def worker_assignment(spark, sf_dir):
    w = assign_workers(fixed_batches(scan_ordinal(_dataset(spark, sf_dir)), BATCH), WORKERS)
    return w.groupBy("worker_id").agg(F.countDistinct("batch_id").alias("n_batches"),
                                      F.count(F.lit(1)).alias("n_samples"))


@register("run_totals", f"""
SELECT CASE grp WHEN 0 THEN 'docs' ELSE 'pages' END || '/shard=' || lpad(CAST(id // {SHARD_ROWS} AS VARCHAR), greatest(5, length(CAST((SELECT max(id) FROM ({SAMPLES_SQL})) // {SHARD_ROWS} AS VARCHAR)))::INT, '0') AS shard,
       CAST(count(*) AS BIGINT) AS rows_loaded,
       CAST(count(caption) AS BIGINT) AS rows_with_caption
FROM ({SAMPLES_SQL}) GROUP BY 1
""")
def run_totals(spark, sf_dir):
    """Rows per shard (and rows with a caption) from the file-path metadata column."""
    df = _dataset(spark, sf_dir)
    shard = F.regexp_extract(SHARD_COL, r"(docs|pages)/(shard=[0-9]+)/", 0)
    return df.groupBy(F.rtrim(shard, F.lit("/")).alias("shard")).agg(
        F.count(F.lit(1)).alias("rows_loaded"), F.count("caption").alias("rows_with_caption"))


URL_SQL = """
WITH u AS (
  SELECT url FROM pages
  UNION ALL SELECT 'doc://' || source || '/' || CAST(doc_id AS VARCHAR) FROM documents
  UNION ALL SELECT printf('s3://sample-bucket/images/img_%05d.jpg', doc_id) FROM documents
)
SELECT url,
       regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS bucket,
       ltrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS object_key,
       starts_with(url, 's3://') AS is_s3,
       CASE WHEN starts_with(url, 's3://') THEN 's3a://' || substr(url, 6) ELSE url END AS hadoop_uri,
       ltrim('out/' || regexp_extract(url, '[^/]*$'), '/') AS out_path
FROM u
"""


@register("url_parts", URL_SQL)
def url_parts(spark, sf_dir):
    """Scheme / bucket / key split, S3A rewrite and output-path join of every URL."""
    docs = table(spark, sf_dir, "documents")
    u = (table(spark, sf_dir, "pages").select("url")
         .unionByName(docs.select(F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url")))
         .unionByName(docs.select(F.format_string("s3://sample-bucket/images/img_%05d.jpg", "doc_id").alias("url"))))
    return u.select("url", urls.scheme("url").alias("scheme"), urls.host("url").alias("bucket"),
                    urls.object_key("url").alias("object_key"), urls.is_s3("url").alias("is_s3"),
                    urls.to_hadoop_uri("url").alias("hadoop_uri"),
                    urls.join_path(F.lit("out"), F.regexp_extract("url", r"[^/]*$", 0)).alias("out_path"))


# ---------------------------------------------------------------- model UDF surface
FAIL_MARK = "@"
FANOUT_BATCH = 16


@register("batch_failure_fanout", f"""
WITH d AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) // {FANOUT_BATCH} AS batch_id FROM documents),
b AS (SELECT batch_id, coalesce(bool_or(contains(text, '{FAIL_MARK}')), false) AS bad FROM d GROUP BY batch_id)
SELECT CAST(doc_id AS VARCHAR) AS key, CAST(batch_id AS BIGINT) AS batch_id,
       CASE WHEN bad THEN 'processing_error' END AS error_type,
       CASE WHEN bad THEN NULL ELSE {TEXT_DIM} END AS n_dims
FROM d JOIN b USING (batch_id)""")
def batch_failure_fanout(spark, sf_dir):
    """An encoder that refuses texts with '@' fails its whole batch (16 rows in id
    order); every member is marked ``processing_error`` and the job goes on."""
    prepare(spark)
    docs = document_samples(table(spark, sf_dir, "documents")).select("key", "caption", "doc_id")
    b = fixed_batches(ordinal(docs, [], ["doc_id"], "ordinal"), FANOUT_BATCH)
    P = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clustered = b.repartitionByRange(P, "batch_id").sortWithinPartitions("batch_id", "ordinal")
    spec = EncoderSpec.of(HashTextEncoder, dim=TEXT_DIM, fail_on=FAIL_MARK)
    enc = apply_encoder(clustered, spec, text_col="caption", on_error="mark", batch_col="batch_id")
    n_dims = F.when(F.col("embedding").isNull(), F.lit(None)).otherwise(F.size("embedding"))
    return enc.select("key", "batch_id", "error_type", n_dims.cast("int").alias("n_dims"))


# ---------------------------------------------------------------- model records
import json  # noqa: E402

from ..models.base import DEFAULT_MODEL_BATCH_SIZE, DEFAULT_MODEL_BATCH_WAIT_S  # noqa: E402

MODEL_CONFIGS = (
    {"name": HASH_TEXT.describe(), "version": "1.0", "description": "hashed bag of tokens",
     "batch_size": 64, "metadata": {"embedding_dim": TEXT_DIM}},
    {"name": "ConstantEncoder()"},
)
MODEL_SCHEMA = ("name string, version string, description string, batch_size int, batch_wait_s double, "
                "metadata map<string,string>")


def write_model_dirs(spark, root: str) -> list[str]:
    """One directory with ``config.json`` per built-in encoder (driver-side, tiny)."""
    from pyspark.sql import Row
    dirs = []
    for i, cfg in enumerate(MODEL_CONFIGS):
        d = f"{root}/model_{i}"
        spark.createDataFrame([Row(value=json.dumps(cfg))]).coalesce(1).write.mode("overwrite").text(d)
        dirs.append(d)
    return dirs


def model_registry_frame(spark, dirs: list[str]):
    m = spark.read.schema(MODEL_SCHEMA).option("multiLine", "true").json(dirs)
    return m.select("name", "version", "description",
                    F.coalesce("batch_size", F.lit(DEFAULT_MODEL_BATCH_SIZE)).alias("batch_size"),
                    F.coalesce("batch_wait_s", F.lit(DEFAULT_MODEL_BATCH_WAIT_S)).alias("batch_wait_s"),
                    F.to_json(F.coalesce("metadata", F.create_map().cast("map<string,string>"))).alias("metadata_json"))


@register("model_registry", f"""
SELECT '{HASH_TEXT.describe()}' AS name, '1.0' AS version, 'hashed bag of tokens' AS description,
       64 AS batch_size, CAST(0.003 AS DOUBLE) AS batch_wait_s, '{{"embedding_dim":"{TEXT_DIM}"}}' AS metadata_json,
       CAST((SELECT count(*) FROM documents) + (SELECT count(*) FROM pages) AS BIGINT) AS num_samples
UNION ALL
SELECT 'ConstantEncoder()', NULL, NULL, 16, CAST(0.003 AS DOUBLE), '{{}}', NULL""")
def model_registry(spark, sf_dir):
    """Model records (config.json with defaults) joined to the runs that used them."""
    root = scratch_path(spark, "models")
    reg = model_registry_frame(spark, write_model_dirs(spark, root))
    runs = spark.read.schema("num_samples long, model string, timestamp double") \
        .json(_embedded(spark, sf_dir).manifest).select(F.col("model").alias("name"), "num_samples")
    return reg.join(runs, "name", "left")


# ---------------------------------------------------------------- incremental job
from ..sources.dataset import page_samples, write_shards  # noqa: E402
from .incremental import embed_incrementally, read_embeddings  # noqa: E402

_INCREMENTAL: dict = {}


@register("incremental_embeddings", EMBED_SQL)
def incremental_embeddings(spark, sf_dir):
    """The embedding job in two runs: shards of documents first, then those that came since; rows of all, none twice."""
    key = (sf_dir, scratch_path(spark, unique=False))
    if key not in _INCREMENTAL:
        src, out = scratch_path(spark, "growing"), scratch_path(spark, "incremental")
        write_shards(document_samples(table(spark, sf_dir, "documents")), f"{src}/docs", "doc_id", SHARD_ROWS)
        embed_incrementally(spark, src, out, HASH_TEXT)
        write_shards(page_samples(table(spark, sf_dir, "pages")), f"{src}/pages", "doc_id", SHARD_ROWS)
        embed_incrementally(spark, src, out, HASH_TEXT)
        _INCREMENTAL[key] = out
    return _embedding_rows(read_embeddings(spark, _INCREMENTAL[key]))


# ---------------------------------------------------------------- sink with a manifest of its tasks
from ..sinks.manifest import read_with_manifest, write_with_manifest  # noqa: E402


@register("task_manifest", f"""
SELECT CAST(count(*) AS BIGINT) AS rows, min(key) AS low, max(key) AS high, CAST(count(*) AS BIGINT) AS rows_read FROM ({SAMPLES_SQL})""")
def task_manifest(spark, sf_dir):
    """Embeddings written by the sink whose manifest is made of the tasks' commit messages: rows and key range, and the rows read back by it."""
    encoded = apply_encoder(_dataset(spark, sf_dir).select("url", "caption", "key"), HASH_TEXT, text_col="caption").drop("caption")
    out = scratch_path(spark, "with_manifest")
    m = write_with_manifest(encoded, out, "key")
    read = read_with_manifest(spark, out, encoded.schema).agg(F.count(F.lit(1)).alias("rows_read"))
    return read.select(F.lit(m["rows"]).cast("long").alias("rows"), F.lit(m["low"]).alias("low"), F.lit(m["high"]).alias("high"), "rows_read")
