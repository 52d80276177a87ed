"""Mergeable quantiles against exact ranks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.sketches import interval_sketches, quantiles, roll_up

PS = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.999}


def table(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else "cold", base + dt.timedelta(seconds=float(s)), float(v)) for i, (s, v) in enumerate(
        zip(rng.uniform(0, 3 * 86400, n), rng.lognormal(0, 2, n).round(3), strict=True))]
    return rows, spark.createDataFrame(rows + [("none", base, None)], "model string, ts timestamp, value double").repartition(7)


@pytest.mark.parametrize("k", [64, 512])
def test_rank_error_is_bounded_after_two_roll_ups(spark, k):
    rows, df = table(spark, 30_000)
    minutes = interval_sketches(df, ["model"], "10 minutes", "value", "ts", k)
    days = roll_up(roll_up(minutes, ["model"], "1 hour", k), ["model"], "1 day", k)
    for keys, part in ((["model", "window_start"], days), (["model"], roll_up(days, ["model"], None, k))):
        for r in quantiles(part, PS).where("n > 0").collect():
            start = getattr(r, "window_start", None) if "window_start" in keys else None
            mine = np.sort([v for m, t, v in rows if m == r.model and (start is None or start <= t < start + dt.timedelta(days=1))])
            assert r.n == len(mine)
            for name, p in PS.items():
                lo, hi = np.searchsorted(mine, r[name], "left") / len(mine), np.searchsorted(mine, r[name], "right") / len(mine)
                assert lo - 2.3 / k <= p <= hi + 2.3 / k, (k, name, lo, hi)
    sizes = [len(r.sketch) for r in roll_up(days, [], None, k).collect()]
    assert max(sizes) < 64 * k + 1000


def test_small_groups_are_exact_and_empty_ones_have_none(spark):
    rows, df = table(spark, 900)
    got = {r.model: r for r in quantiles(roll_up(interval_sketches(df, ["model"], "1 hour", "value", "ts"), ["model"], None), PS).collect()}
    for model in ("hot", "cold"):
        mine = np.sort([v for m, _, v in rows if m == model])
        assert got[model].n == len(mine)
        assert all(got[model][name] == mine[int(np.ceil(p * len(mine))) - 1] for name, p in PS.items())
    assert got["none"].n == 0 and got["none"].p50 is None
    empty = interval_sketches(df.limit(0), ["model"], "1 hour", "value", "ts")
    assert quantiles(roll_up(empty, ["model"], "1 day"), PS).collect() == []
    assert sorted(map(str, quantiles(roll_up(interval_sketches(df, ["model"], "1 hour", "value", "ts"), [], None), PS).collect())) == sorted(
        map(str, quantiles(interval_sketches(df.withColumn("ts", F.lit(dt.datetime(2024, 1, 1))), [], "1 hour", "value", "ts").drop("window_start"), PS).collect()))
