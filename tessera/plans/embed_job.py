"""Dataset embedding job: scan -> project -> (cap) -> encode -> flatten -> write.

Spark form of the batch embedding service: nothing is collected on the
driver; the encoder runs inside ``mapInPandas`` once per row; the row count
for the manifest is observed during the write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.base import EncoderSpec
from ..operators.encode import apply_encoder
from ..operators.samples import CORE, first_samples, flatten_metadata, pack_metadata, sample_ordinal, sample_projection
from ..operators.scan import running_sums
from ..operators.validate import HOT_ROWS
from ..session import scratch_path
from ..sinks.files import write_results, write_run_manifest
from ..sources.dataset import ROW_COL, SHARD_COL, scan_dataset


@dataclass
class EmbedResult:
    table: str
    manifest: str
    num_samples: int


def encode_samples(samples: DataFrame, spec: EncoderSpec, batch_size: int | None = None,
                   max_samples: int | None = None, on_error: str = "raise") -> DataFrame:
    """Samples (url, caption, key, metadata…) -> url, key, caption, embedding, meta_*."""
    if max_samples:
        samples = first_samples(samples, max_samples).drop("ordinal")
    packed = pack_metadata(samples).drop(SHARD_COL, ROW_COL)
    encoded = apply_encoder(packed, spec, text_col="caption", batch_size=batch_size, on_error=on_error)
    flat = flatten_metadata(encoded)
    meta = [c for c in flat.columns if c.startswith("meta_")]
    extra = ["error_type"] if on_error == "mark" else []
    return flat.select("url", "key", "caption", "embedding", *extra, *meta)


def embed_dataset(spark: SparkSession, input_dir: str, output_dir: str, spec: EncoderSpec,
                  batch_size: int | None = None, max_samples: int | None = None,
                  max_records_per_file: int | None = None) -> EmbedResult:
    samples = sample_projection(scan_dataset(spark, input_dir))
    result = encode_samples(samples, spec, batch_size, max_samples)
    table = f"{output_dir}/embeddings.parquet"
    n = write_results(result, table, max_records_per_file)
    manifest = f"{output_dir}/metadata.json"
    write_run_manifest(spark, manifest, n, spec.describe())
    return EmbedResult(table, manifest, n)


def explode_vectors(df: DataFrame, id_col: str, vec_col: str = "embedding", digits: int = 6,
                    keep_zero: bool = False) -> DataFrame:
    """(id, dim, value) rows of a vector column, rounded for comparison."""
    out = df.select(id_col, F.posexplode(vec_col).alias("dim", "value"))
    if not keep_zero:
        out = out.where(F.col("value") != 0)
    return out.select(id_col, F.col("dim").cast("int").alias("dim"),
                      F.round("value", digits).alias("value"))


BUILTIN = {
    "hash-text": ("tessera.models.builtin", "HashTextEncoder"),
    "constant": ("tessera.models.builtin", "ConstantEncoder"),
}


def main(argv=None) -> None:
    """``spark-submit -m tessera.plans.embed_job --input_dir … --output_dir … --model …``"""
    import argparse

    from ..models.loader import register
    from ..session import build_session, prepare, ship_package

    ap = argparse.ArgumentParser(description="Embed every sample of a parquet dataset")
    ap.add_argument("--input_dir", required=True)
    ap.add_argument("--output_dir", required=True)
    ap.add_argument("--model", default="hash-text", help="built-in name or a model directory")
    ap.add_argument("--images", nargs="?", const="", default=None,
                    help="image job: the dataset names images by url; a folder given here is scanned as a whole, other URLs are fetched")
    ap.add_argument("--with_captions", action="store_true", help="the image encoder reads the caption, too")
    ap.add_argument("--batch_size", type=int, default=None)
    ap.add_argument("--max_samples", type=int, default=None)
    ap.add_argument("--master", default=None, help="only for local runs; spark-submit sets it otherwise")
    a = ap.parse_args(argv)
    spark = build_session(master=a.master) if a.master else prepare(SparkSession.builder.getOrCreate())
    ship_package(spark)
    if a.model in BUILTIN:
        mod, cls = BUILTIN[a.model]
        spec = EncoderSpec(target=f"{mod}:{cls}")
    else:
        _, spec = register(spark, a.model)  # checked here, then sent to the executors
    if a.images is not None:
        samples = scan_dataset(spark, a.input_dir)
        res = embed_image_dataset(spark, samples, a.images or None, a.output_dir, spec, a.batch_size, with_captions=a.with_captions, max_samples=a.max_samples)
    else:
        res = embed_dataset(spark, a.input_dir, a.output_dir, spec, a.batch_size, a.max_samples)
    print(f"wrote {res.num_samples} rows to {res.table}; manifest {res.manifest}")


# ---------------------------------------------------------------- image datasets
def image_reason(max_decoded_mb: float):
    """Why a row of the image scan (``dropInvalid`` off) cannot be encoded, or null."""
    from ..functions.images import decoded_size_mb

    return (F.when((F.col("width") < 0) | (F.col("nChannels") < 0), "undecodable_image")
            .when((F.col("width") == 0) | (F.col("height") == 0), "invalid_dimensions")
            .when(decoded_size_mb("width", "height", "nChannels") > F.lit(float(max_decoded_mb)), "image_too_large"))


#: columns of a decoded image
PIXELS = ("data", "height", "width", "nChannels")


def image_pixels(spark: SparkSession, urls: DataFrame, images_root: str | None = None, max_decoded_mb: float | None = None,
                 max_upload_mb: float | None = None, task_bytes: int | None = None) -> DataFrame:
    """``(file, data, height, width, nChannels, reject_reason)`` of distinct ``urls(file)``.

    With ``images_root`` files below that folder come from one scan of it;
    every other URL, wherever it lies, is fetched by the task it is dealt to.
    """
    from ..functions.images import DEFAULT_MAX_MB, MIB
    from ..sources.images import TASK_BYTES, fetched_images, folder_images

    limit = DEFAULT_MAX_MB if max_decoded_mb is None else max_decoded_mb
    rest, scanned = urls, None
    if images_root is not None:
        found, names = folder_images(spark, images_root, drop_invalid=False)
        rest = urls.join(names, "file", "left_anti")
        scanned = found.select("file", *PIXELS, image_reason(limit).alias("reject_reason"))
    got = fetched_images(rest, "file", None if max_upload_mb is None else int(max_upload_mb * MIB), task_bytes or TASK_BYTES)
    got = got.select("file", *PIXELS, F.coalesce("reject_reason", image_reason(limit)).alias("reject_reason"))
    return got if scanned is None else scanned.unionByName(got)


def _embed_slice(samples: DataFrame, meta: list[str], encode: dict, hot_threshold, with_captions: bool, pixels) -> DataFrame:
    """Samples (with ``_file``) -> samples with ``embedding`` or ``reject_reason``."""
    from ..operators.validate import lookup_payloads

    kept = [*CORE, *[F.col(f"`{c}`") for c in meta], "_file"]
    missing = F.when(F.col("_purl").isNull(), "unresolved_url").otherwise(F.col("reject_reason")).alias("reject_reason")
    images = pixels(samples.select(F.col("_file").alias("file")).where("file is not null").distinct())
    if with_captions:
        j = lookup_payloads(samples, images, "_file", "file", hot_threshold).select(*kept, *PIXELS, missing)
        return apply_encoder(j, text_col="caption", **encode).drop(*PIXELS, "_file")
    vectors = apply_encoder(images, **encode).select("file", "reject_reason", "embedding")
    return lookup_payloads(samples, vectors, "_file", "file", hot_threshold).select(*kept, "embedding", missing).drop("_file")


def embed_image_dataset(spark: SparkSession, samples: DataFrame, images_root: str | None, output_dir: str,
                        spec: EncoderSpec, batch_size: int | None = None,
                        max_decoded_mb: float | None = None, hot_threshold: int | None = HOT_ROWS,
                        with_captions: bool = False, max_samples: int | None = None, max_upload_mb: float | None = None,
                        task_bytes: int | None = None) -> EmbedResult:
    """Image samples (url, key, caption, metadata…) -> embeddings + reject table.

    The distinct URLs are the job's input. They are dealt to tasks by bytes, and a
    task fetches, decodes, checks and encodes its images, once each however many
    samples name them (``images_root`` names a folder that is cheaper to scan as a
    whole; URLs outside it are fetched). What travels to the samples is the
    embedding (or the reason for having none), never pixels; URLs that many
    samples share are salted. An encoder that also reads the caption
    (``with_captions``) needs one run per sample: then pixels are joined to the
    samples first.

    Samples get a reason or none: unsupported scheme, unresolved URL, file too
    large, empty file, undecodable image, bad dimensions, oversized image. A write
    partitioned by ``status`` produces ``samples.parquet/status=accepted`` (the
    embeddings, metadata flattened) and ``status=rejected`` (with ``reject_reason``).

    ``max_samples`` keeps the first so many *accepted* samples in (shard, row)
    order, and the rejected ones before the last of them. Slices of samples, each
    twice the one before, are embedded until enough are accepted, so a small cap
    does not read the whole dataset. ``None`` or ``0`` keeps all.
    """
    from pyspark.sql import Observation

    from ..functions.urls import normalize_file_uri

    s = sample_projection(samples)
    meta = [c for c in s.columns if c not in CORE and c not in (SHARD_COL, ROW_COL)]
    if max_samples and not {SHARD_COL, ROW_COL} <= set(s.columns):
        raise ValueError("max_samples needs the position of each sample: scan_dataset(..., with_position=True)")
    encode = {"spec": spec, "image_cols": PIXELS, "batch_size": batch_size, "skip_col": "reject_reason"}

    def pixels(urls: DataFrame) -> DataFrame:
        return image_pixels(spark, urls, images_root, max_decoded_mb, max_upload_mb, task_bytes)
    file = normalize_file_uri("url").alias("_file")
    metadata = [F.col(f"`{c}`").alias(f"meta_{c}") for c in meta]
    named = [f"meta_{c}" for c in meta]
    if not max_samples:
        done = _embed_slice(s.select(*CORE, *metadata, file), named, encode, hot_threshold, with_captions, pixels)
    else:
        done = _first_accepted(spark, s.select(*CORE, *metadata, file, SHARD_COL, ROW_COL), max_samples, lambda part: _embed_slice(
            part, [*named, "_ordinal"], encode, hot_threshold, with_captions, pixels))
    out = done.select("url", "key", "caption", "embedding", "reject_reason", *[F.col(f"`{c}`") for c in named],
                      F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected").alias("status"))
    obs = Observation("tessera_image_job")
    (out.observe(obs, F.count_if(F.col("status") == "accepted").alias("accepted"))
        .write.mode("overwrite").partitionBy("status").parquet(f"{output_dir}/samples.parquet"))
    n = int(obs.get["accepted"])
    manifest = f"{output_dir}/metadata.json"
    write_run_manifest(spark, manifest, n, spec.describe())
    return EmbedResult(f"{output_dir}/samples.parquet/status=accepted", manifest, n)


def _first_accepted(spark: SparkSession, samples: DataFrame, max_samples: int, embed) -> DataFrame:
    """``embed`` of the samples up to the ``max_samples``-th accepted one, in (shard, row) order."""
    numbered = sample_ordinal(samples, "_ordinal").drop(SHARD_COL, ROW_COL)
    path = scratch_path(spark, "numbered")
    numbered.write.parquet(path)                      # narrow rows: no pixels yet
    numbered = spark.read.schema(numbered.schema).parquet(path)
    total = numbered.count()
    done, begin, size, accepted = None, 0, int(max_samples), 0
    while done is None or (accepted < max_samples and begin < total):
        part = embed(numbered.where((F.col("_ordinal") >= begin) & (F.col("_ordinal") < begin + size)))
        path = scratch_path(spark, "slice")
        part.write.parquet(path)
        part = spark.read.schema(part.schema).parquet(path)
        accepted += part.where("reject_reason is null").count()
        done = part if done is None else done.unionByName(part)
        begin, size = begin + size, 2 * size
    taken = F.col("reject_reason").isNull().cast("int")
    before = running_sums(done, [], ["_ordinal"], {"_upto": taken}).where(F.col("_upto") - taken < max_samples)
    return before.drop("_upto", "_ordinal")


if __name__ == "__main__":
    main()
