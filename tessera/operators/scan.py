"""Ordered prefix scans without a single-partition window.

``running_sums`` computes, for every row, the inclusive running sum of some
value columns over the rows of the same key in a total order. A window
``partitionBy(key)`` would put a whole key into one task; here the rows are
range-partitioned on ``(key, order)`` instead, so a hot key is spread over
many tasks:

1. ``repartitionByRange(P, key, order)`` + ``sortWithinPartitions``;
2. per partition, a local running sum (``mapInArrow``: no further shuffle, all
   columns pass through as they are);
3. per partition the total of its last key and, over the partitions, the sum
   a partition's first key has gathered before. Only a partition's first key can
   have such a carry, so the carry table has at most ``P`` rows and is broadcast
   with that bound;
4. local sum + carry.

Both branches read one range exchange, which Spark plans once and reuses. A
second exchange would sample bounds of its own; every carry therefore names the
partition's first row, and a row that sees another first row raises an error
instead of returning a wrong sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PID = "_scan_pid"
MARK = "_scan_mark"     # hash of a row's key and order
FIRST = "_scan_first"   # the row's key is the first of its partition
BEGIN = "_scan_begin"   # MARK of the partition's first row


def _local_sums(keys: list[str], values: list[str], names: list[str]):
    def run(batches):
        last, carry, first, begin = None, None, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if keys:
                codes = np.stack([batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys])
                new = np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)]
            else:
                new = np.arange(n) == 0
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            here = [tuple(batch.column(k)[int(i)].as_py() for k in keys) for i in (0, n - 1)]
            if begin is None:
                begin, last = batch.column(MARK)[0].as_py(), here[0]
            goes_on = carry is not None and last == here[0]
            is_first = (run_of == 0) & (first and last == here[0])
            sums = []
            for j, v in enumerate(values):
                x = batch.column(v).fill_null(0.0).to_numpy(zero_copy_only=False)
                c = np.cumsum(x)
                c = c - (c[starts] - x[starts])[run_of]
                if goes_on:
                    c[run_of == 0] += carry[j]
                sums.append(c)
            first = bool(is_first[-1])
            last, carry = here[1], [s[-1] for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums), pa.array(is_first), pa.array(np.full(n, begin, np.int64))], names)
    return run


def running_sums(df: DataFrame, keys: list[str], order: list[str],
                 values: dict[str, object], num_partitions: int | None = None) -> DataFrame:
    """Add ``out = sum(value) over (partition by keys order by order rows unbounded preceding)``.

    ``values`` maps output column -> value column name or Column expression.
    ``order`` must be a total order within a key (add a unique id last).
    Outputs are doubles; null keys are a key of their own.
    """
    P = int(num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tmp = [f"_scan_v{i}" for i in range(len(values))]
    base = df.withColumns({name: (F.col(v) if isinstance(v, str) else v).cast("double") for name, v in zip(tmp, values.values(), strict=True)})
    base = base.withColumn(MARK, F.xxhash64(*keys, *order))
    sort = [F.col(c).asc_nulls_first() for c in keys + order]
    # The partition id is taken by a projection right after the range
    # shuffle: it is the range-partition index even when the frame later
    # sits under a union (a task's own partition id would be shifted there).
    ranged = base.repartitionByRange(P, *sort).sortWithinPartitions(*sort).withColumn(PID, F.spark_partition_id())
    sums = [f"_scan_l{i}" for i in range(len(values))]
    added = [T.StructField(s, T.DoubleType()) for s in sums] + [T.StructField(FIRST, T.BooleanType()), T.StructField(BEGIN, T.LongType())]
    schema = T.StructType(list(ranged.schema.fields) + added)
    local = ranged.mapInArrow(_local_sums(keys, tmp, schema.fieldNames()), schema)

    # Totals per (partition, key), taken from ``local`` itself so that both
    # branches share one range exchange; carries of first keys: <= P rows.
    totals = local.groupBy(PID, *keys).agg(*[F.sum(v).alias(f"_scan_t{i}") for i, v in enumerate(tmp)],
                                           F.max(FIRST).alias(FIRST), F.max(BEGIN).alias("_scan_cbegin"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(F.col(PID).alias("_scan_cpid"), FIRST, "_scan_cbegin",
                            *[F.coalesce(F.sum(f"_scan_t{i}").over(w), F.lit(0.0)).alias(f"_scan_c{i}") for i in range(len(values))])
    carries = carries.where(FIRST).drop(FIRST)
    joined = local.join(F.broadcast(carries), on=F.col(PID) == F.col("_scan_cpid"), how="left")
    split = F.col("_scan_cbegin").isNull() | (F.col("_scan_cbegin") != F.col(BEGIN))
    fail = F.raise_error(F.lit("the branches of a prefix scan were planned onto different range exchanges")).cast("double")

    def total(i: int):
        return F.when(split, fail).otherwise(F.col(sums[i]) + F.when(F.col(FIRST), F.col(f"_scan_c{i}")).otherwise(0.0))
    # the outputs of ``values`` replace columns of the same name
    kept = [c for c in df.columns if c not in values]
    return joined.select(*kept, *[total(i).alias(out) for i, out in enumerate(values)])


def ordinal(df: DataFrame, keys: list[str], order: list[str], out: str = "ordinal",
            num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row within its key in ``order``."""
    r = running_sums(df, keys, order, {out: F.lit(1)}, num_partitions)
    return r.withColumn(out, (F.col(out) - 1).cast("long"))
