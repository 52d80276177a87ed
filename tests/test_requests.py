"""Request-log operators: queue summary, rate limits, validation."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators.requests import admission, queue_depth, rate_limit_sliding
from tessera.operators.validate import REASONS, split_valid, validate


def _log(spark, rows):
    pdf = pd.DataFrame(rows, columns=["request_id", "model", "client", "enqueue_us", "dequeue_us"])
    return spark.createDataFrame(pdf)


def test_queue_depth_and_utilization(spark):
    # three requests queued, none served yet: depth 3 of 10 -> utilization 0.3
    log = _log(spark, [(1, "m", 1, 10, 100), (2, "m", 1, 20, 100), (3, "m", 1, 30, 100)])
    d = queue_depth(log, 10).where("event = 'enqueue'").orderBy("request_id").toPandas()
    assert list(d.depth) == [1, 2, 3] and abs(d.utilization.iloc[-1] - 0.3) < 1e-12


def test_admission_flags_full_queue(spark):
    log = _log(spark, [(1, "m", 1, 10, 100), (2, "m", 1, 20, 100)])
    a = admission(log, 1).orderBy("request_id").toPandas()
    assert list(a.rejected) == [False, True] and list(a.depth_before) == [0, 1]


def test_dequeue_before_enqueue_at_same_instant(spark):
    log = _log(spark, [(1, "m", 1, 10, 50), (2, "m", 1, 50, 60)])
    d = queue_depth(log, 1).where("event = 'enqueue'").orderBy("request_id").toPandas()
    assert list(d.depth) == [1, 1]


def test_sliding_rate_limit_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 400
    clients = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n))
    t = rng.integers(0, 50_000_000, n)
    log = _log(spark, [(i, "m", int(c), int(x), int(x)) for i, (c, x) in enumerate(zip(clients, t))])
    got = rate_limit_sliding(log, 5, 3.0).toPandas().set_index("request_id")
    for i in range(n):
        ref = int(((clients == clients[i]) & (t <= t[i]) & (t >= t[i] - 3_000_000)).sum())
        assert got.loc[i, "n_in_window"] == ref


def test_validation_order_and_split(spark):
    rows = [
        (1, "text/plain", 100, True, 10, 10, 3),
        (2, "image/png", 20 * 1048576, True, 10, 10, 3),
        (3, "image/png", 0, True, 10, 10, 3),
        (4, "image/png", 100, False, 10, 10, 3),
        (5, "image/png", 100, True, 0, 10, 3),
        (6, "image/png", 100, True, 4000, 4000, 3),
        (7, "image/png", 100, True, 10, 10, 3),
        (8, None, 100, True, 10, 10, 3),
    ]
    df = spark.createDataFrame(rows, "id long, ct string, n long, ok boolean, w int, h int, c int")
    v = validate(df, content_type="ct", n_bytes="n", decoded_ok="ok", width="w", height="h", channels="c")
    got = {r.id: r.reject_reason for r in v.collect()}
    assert [got[i] for i in range(1, 7)] == list(REASONS)
    assert got[7] is None and got[8] == REASONS[0]
    acc, rej = split_valid(v)
    assert acc.count() + rej.count() == df.count()


def test_salted_payload_join_with_hot_url(spark):
    from tessera.operators.validate import resolve_payloads
    # one URL holds most samples; payload side has one row per URL
    samples = spark.createDataFrame([(i, "hot" if i % 3 else f"u{i % 7}") for i in range(300)] + [(999, "miss")],
                                    "id long, url string")
    payloads = spark.createDataFrame([("hot", b"H"), ("u0", b"0"), ("u3", b"3")], "url string, content binary")
    plain_r, plain_u = resolve_payloads(samples, payloads)
    salt_r, salt_u = resolve_payloads(samples, payloads, hot_threshold=20)
    key = lambda rows: sorted((r.id, r.url, bytes(r.content)) for r in rows)
    assert key(plain_r.collect()) == key(salt_r.collect())
    assert sorted(r.id for r in plain_u.collect()) == sorted(r.id for r in salt_u.collect())
    assert salt_r.count() + salt_u.count() == samples.count()


def test_open_ended_rows(spark):
    from tessera.operators.requests import queue_depth, timeouts, with_status
    from tessera.operators.stats import exact_percentiles
    rows = [(1, "m", 0, 0.5, False, 5), (2, "m", 1, None, False, None), (3, None, 2, 9.0, False, 9), (4, None, 3, 0.1, True, 4)]
    log = spark.createDataFrame(rows, "request_id long, model string, enqueue_us long, duration_s double, failed boolean, dequeue_us long")
    assert {r.request_id: r.status for r in with_status(log, 2.0).collect()} == {1: "success", 2: "timeout", 3: "timeout", 4: "error"}
    assert {r.request_id: r.status for r in with_status(log, 2.0, now_us=10).collect()}[2] == "pending"
    assert {r.request_id for r in timeouts(log, 2.0).collect()} == {2, 3} and {r.request_id for r in timeouts(log, 2.0, now_us=10).collect()} == {3}
    depth = {(r.request_id, r.event): r.depth for r in queue_depth(log, 4).collect()}
    assert depth[1, "dequeue"] == 1 and depth[2, "enqueue"] == 2 and (2, "dequeue") not in depth and min(depth.values()) == 0
    pct = {r.model: r.p50 for r in exact_percentiles(log, ["model"], "duration_s", "request_id", {"p50": 0.5}).collect()}
    assert pct == {"m": 0.5, None: 4.55}


def test_topk_odd_rows(spark):
    from tessera.operators.topk import topk_inner_product
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [1.0, 0.0]), ("e", [None, 1.0])], "vec_id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.5]), ("none", None)], "query_id string, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_inner_product(corpus, queries, 2).orderBy("rank").collect()]
    assert got == [("q", 1, "a", 1.0), ("q", 2, "d", 1.0)]
    assert topk_inner_product(corpus, queries.limit(0), 2).collect() == [] and topk_inner_product(corpus.limit(0), queries, 2).collect() == []


def test_topk_in_blocks(spark, monkeypatch):
    import numpy as np
    from tessera.operators import topk
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((40, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    got = {(r.query_id, r["rank"]): r.vec_id for r in topk.topk_inner_product(corpus, queries, 3).collect()}
    want = {(j, r + 1): int(i) for j in range(40) for r, i in enumerate(np.argsort(-(x @ q[j]), kind="stable")[:3])}
    assert got == want


def test_exposition_escapes_and_names_null_labels(spark):
    from tessera.operators import metrics as M
    df = spark.createDataFrame([('a"b\\c\nd', 1.0), (None, 2.0)], "model string, value double")
    lines = {r.line for r in M.exposition([(M.QUEUE_DEPTH, "gauge", df, ["model"])]).collect()}
    assert 'inference_queue_depth{model="a\\"b\\\\c\\nd"} 1.0' in lines and 'inference_queue_depth{model=""} 2.0' in lines


def test_startup_is_measured(spark):
    from tessera.models import ConstantEncoder, EncoderSpec
    from tessera.operators.encode import measure_startup
    rows = measure_startup(spark, EncoderSpec.of(ConstantEncoder), 3).collect()
    assert len(rows) == 3 and all(r.load_s >= 0 and r.warmup_s >= 0 for r in rows)
