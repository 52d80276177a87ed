"""Property tests (hypothesis): resize geometry, pixel conversions, batching invariants."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import images as I
from tessera.operators.requests import batch_summary, dynamic_batches

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def _fit(w, h, mw, mh):
    if w <= mw and h <= mh:
        return w, h
    r = min(mw / w, mh / h)
    return max(1, int(w * r)), max(1, int(h * r))


@SLOW
@given(st.lists(st.tuples(st.integers(1, 6000), st.integers(1, 6000)), min_size=1, max_size=60),
       st.integers(16, 2048), st.integers(16, 2048))
def test_resize_dims_match_python(spark, sizes, mw, mh):
    df = spark.createDataFrame(sizes, "w int, h int")
    nw, nh = I.resize_dims("w", "h", mw, mh)
    got = [(r.a, r.b) for r in df.select(nw.alias("a"), nh.alias("b")).collect()]
    assert got == [_fit(w, h, mw, mh) for w, h in sizes]
    assert all(a <= max(mw, 1) and b <= max(mh, 1) or (w <= mw and h <= mh)
               for (a, b), (w, h) in zip(got, sizes))


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(1, 40),
       st.sampled_from([1, 3, 4]), st.integers(0, 255))
def test_lanczos_keeps_constant_images(h, w, nh, nw, c, v):
    px = np.full((h, w, c), v, dtype=np.uint8)
    out = I.lanczos_resize(px, nh, nw)
    assert out.shape == (nh, nw, c) and (out == v).all()


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.sampled_from([1, 3, 4]), st.randoms())
def test_rgb_conversion_shapes_and_channels(h, w, c, rnd):
    data = bytes(rnd.randrange(256) for _ in range(h * w * c))
    rgb = I.rgb_array(data, h, w, c)
    src = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)
    assert rgb.shape == (h, w, 3)
    if c == 1:
        assert (rgb == src).all()
    else:
        assert (rgb[:, :, 0] == src[:, :, 2]).all() and (rgb[:, :, 2] == src[:, :, 0]).all()


@SLOW
@given(st.integers(2, 6), st.floats(0.5, 8.0), st.integers(8, 40), st.integers(0, 10_000))
def test_dynamic_batch_invariants(spark, B, W, chunk, seed):
    rng = np.random.default_rng(seed)
    n = 150
    pdf = pd.DataFrame({"model": rng.choice(["a", "b"], n), "request_id": np.arange(n, dtype=np.int64),
                        "enqueue_us": rng.integers(0, 60_000_000, n)})
    got = dynamic_batches(spark.createDataFrame(pdf), B, W, ["model"], chunk_rows=max(chunk, B)).toPandas()
    # every request in exactly one batch
    assert sorted(got.request_id) == list(range(n))
    summ = batch_summary(spark.createDataFrame(got)).toPandas()
    assert (summ.batch_size <= B).all() and (summ.wait_s <= W + 1e-9).all()
    # a batch closes early only when full or when the next request is too late
    for m, grp in summ.groupby("model"):
        t = np.sort(pdf[pdf.model == m].enqueue_us.to_numpy())
        ordered = grp.sort_values("open_us")
        ends = np.cumsum(ordered.batch_size.to_numpy())
        for (_, row), e in zip(ordered.iterrows(), ends):
            if e < len(t) and row.batch_size < B:
                assert t[e] > row.open_us + W * 1e6
