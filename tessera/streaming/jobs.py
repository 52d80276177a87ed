"""Streaming operators over request logs and sample streams.

Sources are file streams (Kafka with the same schema in production); sinks
are parquet in append mode, so aggregations emit a window once the
watermark has passed its end. ``run_available_now`` drives a query to the
end of its input (with the final no-data batch that advances the
watermark) and returns the sink read back as a batch table.
"""

from __future__ import annotations

import pickle
import threading
from concurrent.futures import Future
from contextlib import contextmanager
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.requests import _jumps, epoch_us
from ..sources.dataset import list_shards

US = 1_000_000
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
CHECKPOINTS = "spark.sql.streaming.checkpointFileManagerClass"
BY_FILE_SYSTEM = "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
LANE_SHARDS = 25        # shards that make a lane of their own worth its start
WRITERS = 2             # jobs that write micro-batches at a time: while one commits, the other's tasks run


@contextmanager
def many_small_files(spark: SparkSession):
    """What is listed, and the streams that are started, inside have many small files.

    A listing has four tasks a core, by default up to 10,000 of a folder each. Checkpoint
    files are renamed by ``FileSystem``: ``FileContext``, the default, asks the shell
    several times for each file of a local or mounted folder. A file manager that the
    session names itself stays.
    """
    before = {k: spark.conf.get(k, None) for k in (LISTING, CHECKPOINTS)}
    at_most = 4 * spark.sparkContext.defaultParallelism
    spark.conf.set(LISTING, str(min(at_most, int(before[LISTING] or at_most))))
    if before[CHECKPOINTS] is None:
        spark.conf.set(CHECKPOINTS, BY_FILE_SYSTEM)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def file_stream(spark: SparkSession, directory: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of ``<name>.parquet`` files under ``directory``."""
    r = spark.readStream.schema(spark.read.parquet(f"{directory}/{name}.parquet").schema)
    r = r.option("pathGlobFilter", f"{name}.parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.parquet(directory)


def dataset_stream(spark: SparkSession, root: str, max_files_per_trigger: int | None = None, only: str | None = None,
                   schema: T.StructType | None = None) -> DataFrame:
    """Every parquet shard under ``root`` as a stream (one shard per trigger if asked).

    ``only``: a glob below ``root`` of the folders that the stream reads. ``schema``:
    that of all shards, where it is known; else every shard's footer is read for it.
    """
    schema = schema or spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(root).schema
    r = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
         .option("pathGlobFilter", "*.parquet"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.parquet(f"{root}/{only}" if only else root)


def shard_lanes(spark: SparkSession, root: str) -> list[DataFrame]:
    """The shards ``root/*/shard=*`` dealt to streams by the last digits of their number, one shard a micro-batch in each.

    Ten streams, or up to a hundred if there are shards for them, and one for shards
    whose name does not end in a digit (rows without an id).
    """
    with many_small_files(spark):
        shards = list_shards(spark, root).count()
        parts = max(n for n in (1, 2, 5, 10) if n == 1 or 10 * n * LANE_SHARDS <= shards)
        tens = ["0123456789"[i * 10 // parts:(i + 1) * 10 // parts] for i in range(parts)]
        before = [f"[{t}]" for t in tens[:-1]] + [f"[!{''.join(tens[:-1])}]"] if parts > 1 else [""]     # the last takes whatever else there is
        ends = [f"{t}{digit}" for digit in range(10) for t in before] + ["[!0-9]"]
        schema = dataset_stream(spark, root).schema
        with ThreadPool(8) as pool:         # each lists its shards
            return pool.map(inheritable_thread_target(spark)(
                lambda end: dataset_stream(spark, root, max_files_per_trigger=1, only=f"*/shard=*{end}", schema=schema)), ends, chunksize=1)


def run_available_now(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run to the end of the input, however long that takes, and read the sink."""
    q = (df.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", out)
         .trigger(availableNow=True).start())
    try:
        q.awaitTermination()        # raises the query's own error
    finally:
        if q.isActive:
            q.stop()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def run_batches(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Like ``run_available_now``, each row with the id of the micro-batch that carried it (``batch_id``).

    Every micro-batch writes a folder of its own name, so a repeated attempt
    replaces its rows instead of adding to them.
    """
    return run_lanes([df], out, checkpoint).drop("lane")


class _GroupWriter:
    """Writes the micro-batches that wait at the same time in one job, each to the folder of its lane and id.

    A micro-batch returns only when its rows are written, so the streams commit no
    earlier than if each wrote by itself. Whoever gets a turn writes all that wait;
    what every task of a job costs, whatever it writes, is shared by them.
    """

    def __init__(self, out: str):
        self.out = out
        self.waiting: list = []
        self.enter, self.turn = threading.Lock(), threading.Semaphore(WRITERS)

    def lane(self, lane: int):
        def write(batch: DataFrame, batch_id: int) -> None:
            # as text: a number would stand in the generated code, which would be compiled anew for every micro-batch
            rows = batch.select("*", F.lit(str(lane)).alias("lane"), F.lit(str(batch_id)).alias("batch_id"))
            mine = Future()
            with self.enter:
                self.waiting.append((rows, mine))
            with self.turn:
                if not mine.done():
                    with self.enter:
                        group, self.waiting = self.waiting, []
                    if group:       # else mine is being written by another
                        self._write_all(group)
            mine.result()       # raises what the write raised
        return write

    def _write_all(self, group: list) -> None:
        try:
            frames = [rows for rows, _ in group]
            tasks = frames[0].sparkSession.sparkContext.defaultParallelism
            while len(frames) > 1:      # in pairs: a chain of unions would be analysed anew for each link
                frames = [reduce(DataFrame.union, frames[i:i + 2]) for i in range(0, len(frames), 2)]
            (frames[0].coalesce(tasks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("lane", "batch_id").parquet(self.out))
        except BaseException as e:
            for _, done in group:
                done.set_exception(e)
        else:
            for _, done in group:
                done.set_result(None)


def run_lanes(frames: list[DataFrame], out: str, checkpoint: str) -> DataFrame:
    """``run_batches`` of several streams of one schema side by side: rows with ``lane`` and ``batch_id``.

    What a micro-batch costs besides its rows is setting up a job, and a few small
    files of offsets and commits. Micro-batches of different lanes do not wait for
    each other, and those that are to be written at the same time share a job.
    """
    spark, writer, queries = frames[0].sparkSession, _GroupWriter(out), []
    with many_small_files(spark):
        try:
            for lane, df in enumerate(frames):
                queries.append(df.writeStream.foreachBatch(writer.lane(lane)).option("checkpointLocation", f"{checkpoint}/lane={lane}")
                               .trigger(availableNow=True).start())
            for q in queries:
                q.awaitTermination()
        finally:
            for q in queries:
                if q.isActive:
                    q.stop()
        schema = T.StructType([*frames[0].schema.fields, T.StructField("lane", T.IntegerType()), T.StructField("batch_id", T.LongType())])
        return spark.read.schema(schema).parquet(out)


# ---------------------------------------------------------------- request streams
def request_stream(events: DataFrame, delay: str) -> DataFrame:
    """events stream -> request rows with an event-time watermark."""
    s = events.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("model"),
                      F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"),
                      (F.col("value") / 100).alias("duration_s"), (F.col("event_type") == "error").alias("failed"),
                      "value")
    return s.withWatermark("ts", delay)


def windowed_counts(reqs: DataFrame, period: str, labels: list[str]) -> DataFrame:
    g = reqs.groupBy(F.window("ts", period).alias("w"), *labels).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "n")


def timeouts_join(requests: DataFrame, responses: DataFrame, bound_s: int) -> DataFrame:
    """Left outer stream-stream join: a request without a response within ``bound_s``."""
    req = requests.select(F.col("request_id").alias("req_id"), F.col("ts").alias("req_ts"))
    resp = responses.select(F.col("request_id").alias("resp_id"), F.col("resp_ts"))
    cond = ((F.col("req_id") == F.col("resp_id")) & (F.col("resp_ts") >= F.col("req_ts"))
            & (F.col("resp_ts") <= F.col("req_ts") + F.expr(f"INTERVAL {int(bound_s)} SECONDS")))
    j = req.join(resp, cond, "leftOuter")
    return j.select(F.col("req_id").alias("request_id"), F.col("resp_id").isNull().alias("timed_out"))


def _by_time(t: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by time, then id (of any type)."""
    if ids.dtype != object:
        return np.lexsort((ids, t))
    order = np.argsort(t, kind="stable")
    cuts = np.flatnonzero(np.diff(t[order])) + 1
    begin, end = np.r_[0, cuts], np.r_[cuts, len(t)]
    for a, b in zip(begin[end - begin > 1], end[end - begin > 1], strict=True):
        order[a:b] = sorted(order[a:b], key=lambda i: ids[i])
    return order


def _batcher(B: int, W: int, columns: list[str]):
    def fn(key, pdfs, state):
        ts, names = [], []
        if state.exists:
            t, ids = pickle.loads(state.get[0])
            ts, names = [t], [ids]
        if not state.hasTimedOut:
            for pdf in pdfs:
                ts.append(pdf["t_us"].to_numpy(np.int64))
                names.append(pdf["request_id"].to_numpy())
        t, ids = np.concatenate([np.empty(0, np.int64), *ts]), np.concatenate(names) if names else np.empty(0, object)
        order = _by_time(t, ids)  # arrival order inside a micro-batch is arbitrary
        t, ids = t[order], ids[order]
        wm_ms = state.getCurrentWatermarkMs()
        wm = wm_ms * 1000
        jump = _jumps(t, B, W)
        starts, s = [], 0
        while s < len(t):
            e = int(jump[s])
            if not ((e - s == B and t[e - 1] < wm) or (t[s] + W < wm)):
                break
            starts.append(s)
            s = e
        begin = np.array(starts, np.int64)
        end = jump[begin]
        size, open_, last = end - begin, t[begin], t[end - 1]
        rows = [*([k] * len(begin) for k in key), ids[begin], size.astype(np.int32), open_, last, np.where(size == B, last, open_ + W)]
        if s < len(t):
            state.update((pickle.dumps((t[s:], ids[s:])),))     # as arrays: a state of lists costs each request far more
            nxt = int(t[s]) + W
            state.setTimeoutTimestamp(max(wm_ms + 1, nxt // 1000 + 1))
        else:
            state.remove()
        yield pd.DataFrame(dict(zip(columns, rows, strict=True)))
    return fn


def stream_dynamic_batches(reqs: DataFrame, max_batch: int, max_wait_s: float,
                           keys=("model",)) -> DataFrame:
    """Count-or-time batching on a stream: state per key keeps the requests
    of still-open batches; a batch is emitted once the watermark proves it
    closed (full and complete, or its wait elapsed).

    Ids may be of any type. A hot model is spread by a second key, such as the
    replica that serves the request: ``keys=("model", "replica")``; each
    replica then batches what it serves.
    """
    keys = list(keys)
    W = int(round(max_wait_s * US))
    id_type = reqs.schema["request_id"].dataType
    fields = [T.StructField("batch_id", id_type), T.StructField("batch_size", T.IntegerType()), T.StructField("open_us", T.LongType()),
              T.StructField("last_us", T.LongType()), T.StructField("close_us", T.LongType())]
    schema = T.StructType([reqs.schema[k] for k in keys] + fields)
    state = T.StructType([T.StructField("waiting", T.BinaryType())])
    src = reqs.select(*keys, "request_id", "ts", epoch_us("ts").alias("t_us"))
    return src.groupBy(*keys).applyInPandasWithState(
        _batcher(int(max_batch), W, schema.fieldNames()), schema, state, "append",
        GroupStateTimeout.EventTimeTimeout)
