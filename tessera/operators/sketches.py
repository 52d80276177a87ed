"""Mergeable quantiles: binary KLL sketches per interval, rolled up to longer ones.

A sketch is a bounded binary value whatever the number of values it stands for, and
sketches of parts merge into the sketch of the whole. Minutes are aggregated once (in
a batch or on a stream) and written; hours, days or other groupings are merged from
them without reading a request again. ``k`` sets the size: a quantile's rank is off
by about 2.3 / k of all values at most, and a group of up to ``k`` values is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 4096


def interval_sketches(rows: DataFrame, keys: list[str], period: str, value_col: str, ts_col: str, k: int = K) -> DataFrame:
    """``(*keys, window_start, sketch)``: a sketch of each key and interval; null values count nowhere.

    Works on a stream with a watermark on ``ts_col``, where an interval is emitted once it is closed.
    """
    g = rows.groupBy(*keys, F.window(ts_col, period).alias("w")).agg(F.kll_sketch_agg_double(F.col(value_col).cast("double"), F.lit(k)).alias("sketch"))
    return g.select(*keys, F.col("w.start").alias("window_start"), "sketch")


def roll_up(sketches: DataFrame, keys: list[str], period: str | None, k: int = K) -> DataFrame:
    """Sketches of longer intervals (``None``: of all time), or of fewer keys, from those of shorter ones."""
    by = list(keys) if period is None else [*keys, F.window("window_start", period).alias("w")]
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return merged if period is None else merged.select(*keys, F.col("w.start").alias("window_start"), "sketch")


def quantiles(sketches: DataFrame, ps: dict[str, float], count_col: str = "n") -> DataFrame:
    """The sketches' columns, how many values each stands for and its quantiles: a value whose rank is p."""
    n = F.kll_sketch_get_n_double("sketch")
    at = [F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(name) for name, p in ps.items()]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], n.alias(count_col), *at)
