"""Result table and manifests."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the dataset-manifest format tag.
DATASET_FORMAT = "img2dataset"

RUN_MANIFEST_SCHEMA = T.StructType([
    T.StructField("num_samples", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
])


def write_lines(lines: DataFrame, out: str, column: str = "line") -> DataFrame:
    """Write a string column as text files (metric exposition, log records) and read it back."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(out)
    return lines.sparkSession.read.text(out).select(F.col("value").alias(column))


def write_results(df: DataFrame, out: str, max_records_per_file: int | None = None) -> int:
    """Write the result table (a directory of parquet files) and return its row count.

    The count comes from an ``Observation`` on the same write, so the
    upstream model is run exactly once.
    """
    obs = Observation("tessera_results")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    w.parquet(out)
    return int(obs.get["rows"])


def write_run_manifest(spark: SparkSession, out: str, num_samples: int, model: str,
                       timestamp: float | None = None) -> DataFrame:
    row = [(int(num_samples), model, float(time.time() if timestamp is None else timestamp))]
    m = spark.createDataFrame(row, RUN_MANIFEST_SCHEMA)
    m.coalesce(1).write.mode("overwrite").json(out)
    return spark.read.schema(RUN_MANIFEST_SCHEMA).json(out)


def dataset_manifest(df: DataFrame, shard_col: str = "_shard") -> DataFrame:
    """num_shards, num_samples, format, columns of a scanned dataset (one row)."""
    cols = [c for c in df.columns if not c.startswith("_")]
    return df.agg(F.countDistinct(shard_col).alias("num_shards"),
                  F.count(F.lit(1)).alias("num_samples")).select(
        "num_shards", "num_samples", F.lit(DATASET_FORMAT).alias("format"),
        F.array(*[F.lit(c) for c in cols]).alias("columns"))


def write_dataset_manifest(df: DataFrame, out: str) -> DataFrame:
    m = dataset_manifest(df)
    m.coalesce(1).write.mode("overwrite").json(out)
    return df.sparkSession.read.schema(m.schema).json(out)
