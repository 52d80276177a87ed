"""transformWithState operators against plain passes, in order and out of order."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.session import scratch_path
from tessera.streaming.jobs import run_available_now, timeouts_join
from tessera.streaming.stateful import SLOTS, first_requests, replica_batches, rocksdb, sliding_limit

from .test_dynamic_batches import greedy

BASE = dt.datetime(2024, 1, 1)
EPOCH = dt.datetime(1970, 1, 1)


def requests(n, seed, span=600):
    rng = np.random.default_rng(seed)
    secs = np.sort(rng.uniform(0, span, n))
    secs[5:9] = secs[5]                                      # equal times
    return secs, pd.DataFrame({"request_id": np.arange(n, dtype=np.int64), "model": np.where(rng.random(n) < 0.7, "hot", "cold"), "replica": rng.integers(0, 2, n),
                               "client": rng.integers(0, 4, n), "ts": [BASE + dt.timedelta(seconds=round(float(s), 6)) for s in secs]})


def stream(spark, secs, pdf, files=4, delay="30 seconds", late=0.0):
    """Files by time range; a share of each range's last 20 s arrives one file later (within the delay)."""
    src = scratch_path(spark, "stateful_src").replace("file:", "")
    os.makedirs(src, exist_ok=True)
    part = np.floor(secs / (600 / files)).astype(int).clip(0, files - 1)
    moved = (secs % (600 / files) > 600 / files - 20) & (part < files - 1) & (np.random.default_rng(1).random(len(secs)) < late)
    part = np.where(moved, part + 1, part)
    for k in range(files):
        pdf[part == k].sample(frac=1.0, random_state=k).to_parquet(f"{src}/part{k}.parquet", index=False, coerce_timestamps="us", allow_truncated_timestamps=True)
    schema = "request_id long, model string, replica long, client long, ts timestamp_ntz"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", delay) if delay else rows


def times(pdf):
    return np.array([round((t - EPOCH).total_seconds() * 1e6) for t in pdf.ts], np.int64)


@pytest.mark.parametrize("late", [0.0, 1.0])
def test_replica_batches_equal_a_greedy_pass(spark, late):
    secs, pdf = requests(400, 3)
    B, W = 4, 9.0
    out = scratch_path(spark, "replica")
    with rocksdb(spark):
        got = run_available_now(replica_batches(stream(spark, secs, pdf, late=late), B, W), out + "/o", out + "/c").toPandas()
    t = times(pdf)
    wm = t.max() // 1000 * 1000 - 30_000_000
    want = set()
    for key, rows in pdf.groupby(["model", "replica"]):
        at = rows.index.to_numpy()
        members = {}
        for rid, first in greedy(t[at], at, B, int(W * 1e6)).items():
            members.setdefault(first, []).append(t[rid])
        for first, ts in members.items():
            close = max(ts) if len(ts) == B else min(ts) + int(W * 1e6)
            if close < wm - 1000:
                want.add((*key, first, len(ts), min(ts), max(ts), close))
    mine = set(map(tuple, got.itertuples(index=False)))
    assert want <= mine and len(mine) == len(got) and len(mine - want) <= 4
    # what is left in the state are requests of open batches only
    left = spark.read.format("statestore").option("path", out + "/c").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load()
    assert left.count() <= (t > wm - 1000 - W * 1e6).sum() and left.count() == 400 - got.batch_size.sum()


@pytest.mark.parametrize("late", [0.0, 1.0])
def test_sliding_limit_equals_plain_counts(spark, late):
    secs, pdf = requests(300, 4)
    out = scratch_path(spark, "sliding")
    with rocksdb(spark):
        got = run_available_now(sliding_limit(stream(spark, secs, pdf, late=late), 9, 60.0), out + "/o", out + "/c").collect()
    t = times(pdf)
    wm = t.max() // 1000 * 1000 - 30_000_000
    want = {}
    for i in np.flatnonzero(t < wm - 1000):
        n = int(((pdf.client == pdf.client[i]) & (t >= t[i] - 60_000_000) & (t <= t[i])).sum())
        want[int(i)] = (int(pdf.client[i]), n, n > 9)
    mine = {r.request_id: (r.client, r.n_in_window, r.over_limit) for r in got}
    assert len(mine) == len(got) and want.items() <= mine.items() and len(mine) - len(want) <= 4 and any(v[2] for v in want.values())
    slots = spark.read.format("statestore").option("path", out + "/c").option("stateVarName", "slots").option("flattenCollectionTypes", "true").load()
    assert slots.count() <= 4 * (SLOTS + SLOTS * 30 // 60 + 3)            # period and delay of four clients


def test_a_replayed_file_changes_nothing(spark):
    secs, pdf = requests(120, 5)
    twice = pd.concat([pdf, pdf[(secs > 200) & (secs < 290)]], ignore_index=True)
    answers = []
    for rows, at in ((pdf, secs), (twice, np.r_[secs, secs[(secs > 200) & (secs < 290)]])):
        reqs = first_requests(stream(spark, at, rows, files=2, delay="400 seconds"))
        resp = (stream(spark, secs, pdf, files=2, delay=None).where("request_id % 3 > 0")
                .select("request_id", (F.col("ts") + F.expr("INTERVAL 2 SECONDS")).alias("resp_ts")).withWatermark("resp_ts", "400 seconds"))
        out = scratch_path(spark, "replay")
        answers.append(sorted(map(tuple, run_available_now(timeouts_join(reqs, resp, 10), out + "/o", out + "/c").collect())))
    assert answers[0] == answers[1] and len(answers[0]) == len({a[0] for a in answers[0]}) > 0


class _Calls:
    """State and timers of one key that count how often they are called."""

    def __init__(self):
        self.calls, self.rows, self.map, self.one = 0, [], {}, {}

    def __getattr__(self, name):
        def state(*a):
            handle = self

            class One:
                def __getattr__(one, method):
                    def call(*v):
                        handle.calls += 1
                        return getattr(handle, f"_{method}")(a[0], *v) if a else None
                    return call
            return One() if name.startswith("get") else None
        self.calls += 0 if name.startswith("get") else 1
        return state

    def _exists(self, name):
        return bool(self.rows if name == "slots" else name in self.one)

    def _get(self, name):
        return list(self.rows) if name == "slots" else self.one[name]

    def _update(self, name, value):
        self.one[name] = value

    def _clear(self, name):
        self.rows = [] if name == "slots" else self.rows
        self.one.pop(name, None)

    def _appendList(self, name, rows):
        self.rows += rows

    def _put(self, name, rows):
        self.rows = list(rows)

    def _containsKey(self, name, key):
        return key in self.map

    def _getValue(self, name, key):
        return self.map[key]

    def _updateValue(self, name, key, value):
        self.map[key] = value

    def _removeKey(self, name, key):
        del self.map[key]

    def _iterator(self, name):
        return list(self.map.items())


def test_a_keys_requests_take_few_state_calls_however_many_slots():
    import types

    from tessera.streaming.stateful import _SlidingLimit
    handle, processor = _Calls(), _SlidingLimit(3, 60_000_000, "long", ["client", "request_id", "n_in_window", "over_limit"])
    processor.init(handle)
    t, client = np.arange(1000, dtype=np.int64) * 7_000_000, np.array(["a", "b", None, "a"] * 250, object)
    at = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    list(processor.handleInputRows((1,), iter([pd.DataFrame({"t_us": t[::-1], "client": client[::-1], "request_id": np.arange(1000)[::-1]})]), at))
    got = pd.concat(processor.decide((1,), 6_000_000)).sort_values("request_id")
    due = t < 6_000_000_000
    assert got.request_id.tolist() == np.flatnonzero(due).tolist() and got.client.tolist() == client[due].tolist()
    assert got.n_in_window.tolist() == [int(((t >= x - 60_000_000) & (t <= x) & (client == c)).sum()) for x, c in zip(t[due], client[due], strict=True)]
    left = [x for some, *_ in handle.rows for x in some]
    assert handle.calls <= 20 and set(t[~due]) <= set(left) and min(left) >= 6_000_000_000 - 60_000_000 - 60_000_000 // SLOTS
