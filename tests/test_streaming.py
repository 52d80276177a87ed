"""Stateful stream batching with out-of-order arrival across micro-batches."""

import datetime as dt
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.session import scratch_path
from tessera.streaming.jobs import run_available_now, stream_dynamic_batches

from .test_dynamic_batches import greedy


def test_stream_batches_match_greedy_under_final_watermark(spark):
    rng = np.random.default_rng(11)
    n, B, W = 240, 4, 5.0
    base = dt.datetime(2024, 1, 1)
    secs = np.sort(rng.uniform(0, 600, n))
    pdf = pd.DataFrame({"request_id": np.arange(n, dtype=np.int64),
                        "model": np.where(rng.random(n) < 0.6, "hot", "cold"),
                        "ts": [base + dt.timedelta(seconds=float(s)) for s in secs]})
    # four files by time range; the last 20 s of each range arrive one file later
    # (out of order, but within the 30 s watermark delay, so not late)
    src = scratch_path(spark, "stream_src").replace("file:", "")
    os.makedirs(src, exist_ok=True)
    part = np.floor(secs / 150).astype(int)
    part = np.where((secs % 150 > 130) & (part < 3), part + 1, part)
    for k in range(4):
        chunk = pdf[part == k].sample(frac=1.0, random_state=k)  # arbitrary order inside a file
        chunk.to_parquet(f"{src}/part{k}.parquet", index=False, coerce_timestamps="us",
                         allow_truncated_timestamps=True)
    schema = "request_id long, model string, ts timestamp_ntz"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
              .withColumn("ts", F.col("ts").cast("timestamp"))
              .withWatermark("ts", "30 seconds"))
    out = scratch_path(spark, "stream_out")
    got = run_available_now(stream_dynamic_batches(stream, B, W), out + "/o", out + "/c").toPandas()
    t_us = np.array([int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1e6) for t in pdf.ts])
    wm = (t_us.max() // 1000) * 1000 - 30_000_000
    for m in ["hot", "cold"]:
        sel = (pdf.model == m).to_numpy()
        ref = greedy(t_us[sel], pdf.request_id.to_numpy()[sel], B, int(W * 1e6))
        starts = {}
        for rid, b in ref.items():
            starts.setdefault(b, []).append(rid)
        tmap = dict(zip(pdf.request_id, t_us))
        expected = set()
        for b, members in starts.items():
            ts = sorted(tmap[r] for r in members)
            if (len(members) == B and ts[-1] < wm) or (tmap[b] + W * 1e6 < wm):
                expected.add((b, len(members)))
        mine = set(zip(got[got.model == m].batch_id, got[got.model == m].batch_size))
        assert mine == expected


def test_batches_beyond_a_hundred_are_all_counted(spark, tmp_path):
    from tessera.streaming.jobs import dataset_stream, run_batches
    spark.range(104 * 3).selectExpr("id", "id % 104 AS s").repartition(8, "s").write.partitionBy("s").parquet(str(tmp_path / "in"))
    stream = dataset_stream(spark, str(tmp_path / "in"), max_files_per_trigger=1).select("id")
    got = run_batches(stream, str(tmp_path / "out"), str(tmp_path / "c")).groupBy("batch_id").count().collect()
    assert len(got) == 104 and sum(r["count"] for r in got) == 312


def test_cluster_without_shared_folder_is_refused(monkeypatch):
    import types

    import pytest

    from tessera import session
    sc = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    fake = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(fake)


def test_lanes_carry_every_shard_once_one_a_micro_batch(spark, tmp_path):
    from tessera.streaming.jobs import dataset_stream, run_lanes
    root = str(tmp_path / "in")
    spark.range(23 * 3).selectExpr("id", "id % 23 AS shard").repartition(4, "shard").write.partitionBy("shard").parquet(f"{root}/docs")
    lanes = [dataset_stream(spark, root, max_files_per_trigger=1, only=f"*/shard=*{d}").select("id") for d in range(10)]
    got = run_lanes(lanes, str(tmp_path / "out"), str(tmp_path / "c"))
    carried = {}
    for r in got.collect():
        carried.setdefault((r.lane, r.batch_id), set()).add(r.id)
    assert sorted(map(sorted, carried.values())) == [[s, s + 23, s + 46] for s in range(23)]
    assert {lane for lane, _ in carried} == set(range(10)) and max(b for _, b in carried) <= 2      # no lane waits for all the others' shards


def test_lanes_deal_out_every_shard_also_that_of_rows_without_id(spark, tmp_path, monkeypatch):
    from tessera.sources.dataset import write_shards
    from tessera.streaming import jobs
    before = {k: spark.conf.get(k, None) for k in (jobs.LISTING, jobs.CHECKPOINTS)}
    rows = [(i, f"k{i}") for i in range(23 * 3)] + [(None, "a"), (None, "b"), (-1, "c")]
    write_shards(spark.createDataFrame(rows, "doc_id long, key string"), f"{tmp_path}/in/docs", "doc_id", 3)
    for shards_a_lane, n in ((25, 11), (1, 21)):
        monkeypatch.setattr(jobs, "LANE_SHARDS", shards_a_lane)
        lanes = [s.select("key") for s in jobs.shard_lanes(spark, str(tmp_path / "in"))]
        assert len(lanes) == n
        carried = {}
        for r in jobs.run_lanes(lanes, str(tmp_path / f"out{n}"), str(tmp_path / f"c{n}")).collect():
            carried.setdefault((r.lane, r.batch_id), []).append(r.key)
        shards = [[f"k{i}", f"k{i + 1}", f"k{i + 2}"] for i in range(0, 69, 3)] + [["a", "b"], ["c"]]
        assert sorted(map(sorted, carried.values())) == sorted(map(sorted, shards))
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_micro_batches_that_wait_share_a_job_and_repeated_ones_replace_their_rows(spark, tmp_path, monkeypatch):
    import time
    from concurrent.futures import ThreadPoolExecutor

    import pytest

    from tessera.streaming import jobs
    groups, write_all = [], jobs._GroupWriter._write_all
    monkeypatch.setattr(jobs._GroupWriter, "_write_all", lambda self, group: (groups.append(len(group)), write_all(self, group)))
    writer = jobs._GroupWriter(str(tmp_path / "out"))

    def together(batches):
        for _ in range(jobs.WRITERS):
            writer.turn.acquire()
        with ThreadPoolExecutor(8) as pool:
            waits = [pool.submit(writer.lane(lane), df, batch_id) for lane, batch_id, df in batches]
            while len(writer.waiting) < len(batches):
                time.sleep(0.01)
            for _ in range(jobs.WRITERS):
                writer.turn.release()
        return [w.exception() for w in waits]

    assert together([(lane, 5, spark.range(lane * 10, lane * 10 + 2)) for lane in range(5)]) == [None] * 5 and groups == [5]
    assert together([(3, 5, spark.range(7, 8)), (4, 6, spark.range(1))]) == [None] * 2 and groups == [5, 2]
    got = sorted((r.lane, r.batch_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 5, 0), (0, 5, 1), (1, 5, 10), (1, 5, 11), (2, 5, 20), (2, 5, 21), (3, 5, 7), (4, 5, 40), (4, 5, 41), (4, 6, 0)]
    bad = spark.range(3).selectExpr("assert_true(id < 2, 'bad') IS NULL AS id")
    assert all("bad" in str(e) for e in together([(0, 7, bad), (1, 7, bad)]))     # no lane may commit what was not written
    with pytest.raises(Exception, match="bad"):
        writer.lane(0)(bad, 8)


def test_a_models_waiting_requests_are_kept_as_arrays_and_ids_may_be_text():
    import types

    from tessera.streaming.jobs import _batcher
    kept = {}
    state = types.SimpleNamespace(exists=False, hasTimedOut=False, getCurrentWatermarkMs=lambda: 0, update=lambda v: kept.update(v=v),
                                  setTimeoutTimestamp=lambda ms: None, remove=lambda: kept.clear())
    columns = ["model", "batch_id", "batch_size", "open_us", "last_us", "close_us"]
    t = np.array([5, 3, 3, 90, 4, 7, 8], np.int64)
    first = list(_batcher(3, 10, columns)(("m",), [pd.DataFrame({"t_us": t, "request_id": list("ecbzdfg")})], state))
    assert len(first[0]) == 0 and isinstance(kept["v"][0], bytes)         # nothing is proven yet; one value, not one per request
    state.exists, state.get, state.hasTimedOut, state.getCurrentWatermarkMs = True, kept["v"], True, lambda: 1
    done = list(_batcher(3, 10, columns)(("m",), [], state))[0]
    assert list(done.itertuples(index=False, name=None)) == [("m", "b", 3, 3, 4, 4), ("m", "e", 3, 5, 8, 8), ("m", "z", 1, 90, 90, 100)] and not kept
