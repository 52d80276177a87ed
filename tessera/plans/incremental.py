"""Incremental embedding job: a ledger of shards and an idempotent commit per batch.

Layout below ``output_dir``:

* ``plans/<batch>``: the shards of a batch that has begun (path, length, time);
* ``embeddings/batch=<batch>``: its rows, with the shard they come from;
* ``ledger/batch=<batch>``: its shards, written when its rows are complete.

A run first finishes batches that have a plan and no ledger entry: they write
their folders anew, so an attempt that was cut off leaves nothing behind. Then the
shards that no ledger entry names with this length and time are cut into
batches. A batch's name comes from its shards alone, so planning twice is planning
once. ``read_embeddings`` takes each shard's rows from the last batch that has it: a
shard that was changed replaces its rows, one that was removed keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..models.base import EncoderSpec
from ..operators.samples import sample_projection
from ..session import scratch_path
from ..sources.dataset import SHARD_COL, list_shards, scan_dataset
from .embed_job import encode_samples

SHARD = "path string, length long, modificationTime timestamp"
BATCH_SHARDS = 1000     # shards of a batch: their paths reach the driver, batch by batch
BATCH_BYTES = 64 << 30


@dataclass
class IncrementalResult:
    embeddings: str
    batches: list[str]      # committed by this run
    shards: int             # read by this run


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, output_dir: str, kind: str = "ledger") -> DataFrame:
    """``(batch, path, length, modificationTime)`` of committed (or, ``plans``, of begun) batches."""
    path = f"{output_dir}/{kind}"
    schema = f"{SHARD}, committed timestamp, batch string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def _write_shards(shards: DataFrame, path: str) -> None:
    # an exchange, not coalesce: one task would do the sorts of all partitions before it, with the memory of all
    shards.select("path", "length", "modificationTime", F.current_timestamp().alias("committed")).repartition(1).write.mode("overwrite").parquet(path)


def pending_shards(spark: SparkSession, input_dir: str, output_dir: str) -> DataFrame:
    """Shards that no committed batch has with this length and time."""
    done = ledger(spark, output_dir).select("path", "length", "modificationTime")
    return list_shards(spark, input_dir).join(done, ["path", "length", "modificationTime"], "left_anti")


def plan_batches(spark: SparkSession, input_dir: str, output_dir: str, batch_shards: int = BATCH_SHARDS, batch_bytes: int = BATCH_BYTES) -> list[str]:
    """Cuts the pending shards into batches, writes their plans and returns their names, in path order."""
    from ..operators.scan import running_sums

    found = running_sums(pending_shards(spark, input_dir, output_dir), [], ["path"], {"_n": F.lit(1), "_bytes": F.col("length")})
    # numbered once, not once a batch
    path = scratch_path(spark, "pending")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    cut = F.greatest(F.floor((F.col("_n") - 1) / batch_shards), F.floor((F.col("_bytes") - F.col("length")) / batch_bytes)).cast("long")
    # the name of a batch is a hash of its shards, whatever their order in it
    one = F.xxhash64("path", "length", "modificationTime")
    cuts = found.groupBy(cut.alias("cut")).agg(F.bit_xor(one).alias("a"), F.count("*").alias("n"), F.min("path").alias("first")).orderBy("cut").collect()
    names = []
    for r in cuts:
        name = f"{r.a & (1 << 64) - 1:016x}-{r.n}"
        _write_shards(found.where(cut == r.cut), f"{output_dir}/plans/batch={name}")
        names.append(name)
    return names


def run_batch(spark: SparkSession, output_dir: str, batch: str, spec: EncoderSpec, batch_size: int | None = None) -> int:
    """Embeds the shards of a planned batch and commits it; returns their number. Running it again replaces its rows."""
    shards = ledger(spark, output_dir, "plans").where(F.col("batch") == batch)
    paths = [r.path for r in shards.select("path").orderBy("path").collect()]      # at most BATCH_SHARDS
    found = scan_dataset(spark, paths)
    if "caption" not in found.columns:      # others may have one: a batch must not decide for the dataset
        found = found.withColumn("caption", F.lit(None).cast("string"))
    samples = sample_projection(found)
    # the shard travels as metadata and comes out under its own name
    rows = encode_samples(samples.withColumn("shard", F.col(SHARD_COL)), spec, batch_size)
    rows.withColumnRenamed("meta_shard", "shard").write.mode("overwrite").parquet(f"{output_dir}/embeddings/batch={batch}")
    _write_shards(shards, f"{output_dir}/ledger/batch={batch}")
    return len(paths)


def embed_incrementally(spark: SparkSession, input_dir: str, output_dir: str, spec: EncoderSpec, batch_size: int | None = None,
                        batch_shards: int = BATCH_SHARDS, batch_bytes: int = BATCH_BYTES) -> IncrementalResult:
    """Embeds every shard below ``input_dir`` that is new or changed since the last run; see the module's text."""
    done = ledger(spark, output_dir).select("batch").distinct()
    begun = [r.batch for r in ledger(spark, output_dir, "plans").select("batch").distinct().join(done, "batch", "left_anti").orderBy("batch").collect()]
    batches, shards = [], 0
    for batch in begun:
        shards += run_batch(spark, output_dir, batch, spec, batch_size)
        batches.append(batch)
    for batch in plan_batches(spark, input_dir, output_dir, batch_shards, batch_bytes):
        shards += run_batch(spark, output_dir, batch, spec, batch_size)
        batches.append(batch)
    return IncrementalResult(f"{output_dir}/embeddings", batches, shards)


def read_embeddings(spark: SparkSession, output_dir: str) -> DataFrame:
    """The rows of committed batches, each shard's from the last batch that has it."""
    # paths are written as the file listing and as the scan name them
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.col("committed").desc(), F.col("modificationTime").desc(), "batch"))
    current = ledger(spark, output_dir).withColumn("rank", last).where("rank = 1").select("batch", plain("path").alias("_path"))
    table = spark.read.option("mergeSchema", "true").option("basePath", f"{output_dir}/embeddings").parquet(f"{output_dir}/embeddings")
    rows = table.withColumn("_path", plain("shard"))
    return rows.join(current, ["batch", "_path"], "left_semi").drop("_path")
