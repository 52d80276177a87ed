"""Exact percentiles without collecting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import ordinal


def exact_percentiles(df: DataFrame, keys: list[str], value_col: str, tie_col: str,
                      ps: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles (``percentile`` / ``quantile_cont``) per key.

    Ranks come from the range-partitioned prefix count; each percentile
    then needs only the two rows at ranks ``floor(p(n-1))`` and
    ``ceil(p(n-1))``, picked with a join against a target table that has a
    few rows per group. A null key is a group of its own.
    """
    # a struct is never null, so null keys join like others
    key = F.struct(*keys).alias("_key")
    vals = df.where(F.col(value_col).isNotNull()).select(*keys, tie_col, F.col(value_col).cast("double").alias("_v"))
    ranked = ordinal(vals, keys, ["_v", tie_col], "_rk").select(key, "_rk", "_v")
    counts = vals.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    targets = None
    for name, p in ps.items():
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(h).cast("long"), F.ceil(h).cast("long")
        frac = h - F.floor(h)
        t = counts.select("_key", F.lit(name).alias("_p"), F.explode(F.array(
            F.struct(lo.alias("_rk"), (F.lit(1.0) - frac).alias("_w")),
            F.struct(hi.alias("_rk"), frac.alias("_w")))).alias("_t")).select("_key", "_p", "_t._rk", "_t._w")
        targets = t if targets is None else targets.unionByName(t)
    picked = ranked.join(targets, on=["_key", "_rk"])
    res = picked.groupBy("_key").pivot("_p", list(ps)).agg(F.sum(F.col("_v") * F.col("_w")))
    return res.select("_key.*", *ps)
