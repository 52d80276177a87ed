"""Range-partitioned prefix scans against plain window functions."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.scan import ordinal, running_sums


def _frame(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    # one hot key holds about a third of the rows
    keys = np.where(rng.random(n) < 0.35, "hot", rng.choice(list("abcdefgh"), n))
    pdf = pd.DataFrame({"k": keys, "t": rng.integers(0, 500, n), "id": np.arange(n),
                        "v": rng.normal(size=n)})
    return spark.createDataFrame(pdf)


def test_running_sums_match_window(spark):
    df = _frame(spark)
    got = running_sums(df, ["k"], ["t", "id"], {"s": "v", "c": F.lit(1)}, num_partitions=7)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("id", F.sum("v").over(w).alias("s2"), F.count(F.lit(1)).over(w).alias("c2"))
    j = got.join(ref, "id").toPandas()
    assert len(j) == 3000
    assert np.allclose(j.s, j.s2)
    assert (j.c == j.c2).all()


def test_ordinal_without_keys_is_global_position(spark):
    df = _frame(spark)
    got = ordinal(df, [], ["t", "id"], "o", num_partitions=5).toPandas().sort_values(["t", "id"])
    assert list(got.o) == list(range(len(got)))


def test_scan_under_union_keeps_partition_ids(spark):
    df = _frame(spark, n=800)
    a = ordinal(df, ["k"], ["t", "id"], "o", num_partitions=4)
    u = a.unionByName(a.where("o < 3")).toPandas()
    base = a.toPandas()
    assert len(u) == len(base) + (base.o < 3).sum()


def test_null_keys_and_many_partitions(spark):
    rng = np.random.default_rng(5)
    n = 1200
    keys = rng.choice(["x", "y", None], n, p=[0.2, 0.2, 0.6])
    pdf = pd.DataFrame({"k": keys, "t": rng.integers(0, 50, n), "id": np.arange(n), "v": rng.integers(-3, 4, n)})
    df = spark.createDataFrame(pdf, "k string, t long, id long, v long")
    got = running_sums(df, ["k"], ["t", "id"], {"s": "v"}, num_partitions=16).toPandas()
    pdf = pdf.sort_values(["t", "id"])
    pdf["ref"] = pdf.groupby(pdf["k"].fillna("<null>"))["v"].cumsum()
    j = got.merge(pdf[["id", "ref"]], on="id")
    assert len(j) == n and (j.s == j.ref).all()


def test_exact_percentiles_match_numpy_with_hot_key(spark):
    from tessera.operators.stats import exact_percentiles
    rng = np.random.default_rng(9)
    n = 2000
    keys = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"k": keys, "id": np.arange(n), "v": rng.normal(size=n).round(3)})
    got = exact_percentiles(spark.createDataFrame(pdf), ["k"], "v", "id", {"p50": 0.5, "p95": 0.95}).toPandas()
    for _, row in got.iterrows():
        vals = pdf[pdf.k == row.k].v.to_numpy()
        assert abs(row.p50 - np.percentile(vals, 50)) < 1e-9
        assert abs(row.p95 - np.percentile(vals, 95)) < 1e-9
