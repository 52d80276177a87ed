"""Chunked count-or-time batching against a sequential greedy pass."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators.requests import batch_summary, dynamic_batches


def greedy(ts, ids, B, W):
    order = np.lexsort((ids, ts))
    ts, ids = ts[order], ids[order]
    out, s = {}, 0
    while s < len(ts):
        e = s + 1
        while e < len(ts) and e - s < B and ts[e] <= ts[s] + W:
            e += 1
        for i in range(s, e):
            out[int(ids[i])] = int(ids[s])
        s = e
    return out


@pytest.mark.parametrize("B,W_s,chunk,fold", [(8, 3.0, 16, 4096), (8, 3.0, 16, 5), (3, 1.0, 5, 8),
                                              (3, 1.0, 5, 1000), (4, 10.0, 1000, 64)])
def test_chunked_equals_greedy(spark, B, W_s, chunk, fold, monkeypatch):
    monkeypatch.setattr("tessera.operators.requests.FOLD", fold)
    rng = np.random.default_rng(B)
    n = 700
    models = np.where(rng.random(n) < 0.4, "hot", rng.choice(["m1", "m2"], n))
    ts = np.cumsum(rng.exponential(0.7, n) * 1e6).astype(np.int64)
    pdf = pd.DataFrame({"model": models, "request_id": np.arange(n, dtype=np.int64), "enqueue_us": ts})
    df = spark.createDataFrame(pdf)
    got = dynamic_batches(df, B, W_s, ["model"], chunk_rows=chunk).toPandas()
    assert len(got) == n and got.request_id.is_unique
    for m in ["hot", "m1", "m2"]:
        sub = pdf[pdf.model == m]
        ref = greedy(sub.enqueue_us.to_numpy(), sub.request_id.to_numpy(), B, int(W_s * 1e6))
        mine = dict(zip(got[got.model == m].request_id, got[got.model == m].batch_id))
        assert mine == ref
    summ = batch_summary(spark.createDataFrame(got)).toPandas()
    assert (summ.batch_size <= B).all()
    assert (summ.wait_s <= W_s + 1e-9).all()


def test_null_key_is_a_key(spark):
    log = spark.range(200).selectExpr("id AS request_id", "id * 1000 AS enqueue_us")
    named = dynamic_batches(log.selectExpr("'m' AS model", "*"), 5, 1.0, ["model"], chunk_rows=20).drop("model")
    null = dynamic_batches(log.selectExpr("CAST(NULL AS STRING) AS model", "*"), 5, 1.0, ["model"], chunk_rows=20)
    assert null.where("model IS NULL").count() == 200
    assert sorted(map(tuple, null.drop("model").collect())) == sorted(map(tuple, named.collect()))
