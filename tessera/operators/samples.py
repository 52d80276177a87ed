"""Sample-shaped projections, ordinals, caps and fixed-size batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dataset import ROW_COL, SHARD_COL
from .scan import ordinal, running_sums

# The three core columns of a sample; metadata keys that would
# clash with result columns are written with the ``meta_`` prefix like all others.
CORE = ("url", "caption", "key")
POSITION = (SHARD_COL, ROW_COL)


def sample_projection(df: DataFrame) -> DataFrame:
    """url / caption / key with ``""`` for columns absent from every shard.

    An explicit null stays null for caption; url and key fall back to ``""``.
    """
    cols = set(df.columns)
    url = F.coalesce(F.col("url"), F.lit("")) if "url" in cols else F.lit("")
    key = F.coalesce(F.col("key"), F.lit("")) if "key" in cols else F.lit("")
    cap = F.col("caption") if "caption" in cols else F.lit("")
    keep = [c for c in df.columns if c not in CORE]
    return df.select(url.alias("url"), cap.alias("caption"), key.alias("key"), *keep)


def metadata_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in CORE and c not in POSITION]


def pack_metadata(df: DataFrame) -> DataFrame:
    """Every non-core column moves into one ``metadata`` struct."""
    meta = metadata_columns(df)
    others = [c for c in df.columns if c in CORE or c in POSITION]
    return df.select(*others, F.struct(*meta).alias("metadata"))


def flatten_metadata(df: DataFrame, prefix: str = "meta_") -> DataFrame:
    """``metadata.<c>`` -> ``meta_<c>``; other columns stay."""
    fields = df.schema["metadata"].dataType.fieldNames()
    rest = [c for c in df.columns if c != "metadata"]
    return df.select(*rest, *[F.col(f"metadata.`{c}`").alias(f"{prefix}{c}") for c in fields])


def sample_ordinal(df: DataFrame, out: str = "ordinal") -> DataFrame:
    """0-based position in (shard path, row in shard) order, over the rows of ``df``.

    Only (shard, row) pairs are ordered, by a range-partitioned prefix count, so
    no task holds more than its share of rows however the shards are sized and
    no payload column is part of that shuffle; the positions are then joined back.
    """
    position = ordinal(df.select(*POSITION), [], list(POSITION), out)
    return df.join(position, list(POSITION))


def scan_ordinal(df: DataFrame, out: str = "ordinal") -> DataFrame:
    """The same for a whole scan (no row filtered): rows of earlier shards plus the row's index.

    The offsets have one row per shard, as many as the file index that the driver
    holds for the scan anyway; no row is shuffled as long as Spark finds them small
    enough to send to the tasks.
    """
    sizes = df.groupBy(SHARD_COL).agg(F.count(F.lit(1)).alias("_rows"))
    before = running_sums(sizes, [], [SHARD_COL], {"_upto": "_rows"})
    offsets = before.select(SHARD_COL, (F.col("_upto") - F.col("_rows")).cast("long").alias("_before"))
    return df.join(offsets, SHARD_COL).withColumn(out, F.col("_before") + F.col(ROW_COL)).drop("_before")


def first_samples(df: DataFrame, max_samples: int | None, out: str = "ordinal") -> DataFrame:
    """The first ``max_samples`` rows of ``df`` in (shard, row) order with their ordinal; ``None`` or ``0`` keeps all.

    Positions alone decide; the rows kept are then picked from the scan by a join
    with that table, which Spark broadcasts if it turns out small.
    """
    if not max_samples:
        return sample_ordinal(df, out)
    position = cap_samples(ordinal(df.select(*POSITION), [], list(POSITION), out), max_samples, out)
    return df.join(position, list(POSITION))


def cap_samples(df_with_ordinal: DataFrame, max_samples: int | None, col: str = "ordinal") -> DataFrame:
    """First ``max_samples`` rows by ordinal; ``None`` or ``0`` keeps everything.

    A filter on the ordinal rather than ``limit``: ``limit`` funnels the
    survivors into one partition ahead of the encoder.
    """
    if not max_samples:
        return df_with_ordinal
    return df_with_ordinal.where(F.col(col) < F.lit(int(max_samples)))


def fixed_batches(df_with_ordinal: DataFrame, batch_size: int, col: str = "ordinal") -> DataFrame:
    """``batch_id = ordinal div batch_size`` (the last batch may be short)."""
    return df_with_ordinal.withColumn("batch_id", F.floor(F.col(col) / F.lit(int(batch_size))).cast("long"))


def assign_workers(df_with_batches: DataFrame, num_workers: int) -> DataFrame:
    """Round-robin batches over workers: ``worker_id = batch_id mod num_workers``."""
    return df_with_batches.withColumn("worker_id", F.pmod(F.col("batch_id"), F.lit(int(num_workers))).cast("int"))
