"""Stateful request operators on ``transformWithState``: list state with event-time timers.

A request is appended to its key's state as it is; nothing is rewritten for it.
Work is done by timers: one fires when the watermark proves that something can be
decided, so late but not too late input changes nothing. State per key is bounded
by what arrives within the wait (or period) plus the watermark's delay.

These processors keep state in Spark's RocksDB store; ``rocksdb`` sets it for the
queries started inside.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.requests import _jumps, epoch_us

US = 1_000_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOTS = 32              # time slots of a period
KEYS = 4096             # state keys that the clients of a sliding limit share


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _plain(values) -> list:
    return [v.item() if isinstance(v, np.generic) else v for v in values]


class _Timed(StatefulProcessor):
    """Keeps one pending timer a key, at the earliest time asked for (in microseconds of event time)."""

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "ms long")

    def wake(self, us: int, watermark_ms: int) -> None:
        ms = max(us // 1000 + 1, watermark_ms + 1)
        pending = self.timer.get() if self.timer.exists() else None
        if pending is None or ms < pending[0]:
            if pending is not None:
                self.handle.deleteTimer(pending[0])
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        yield from self.decide(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- batches

class _Batcher(_Timed):
    def __init__(self, most: int, wait: int, id_type: str, columns: list[str]):
        self.most, self.wait, self.id_type, self.columns = most, wait, id_type, columns

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", f"t long, id {self.id_type}")
        self.seen = handle.getValueState("seen", "n long, first long")

    def handleInputRows(self, key, rows, timerValues):
        n, first = self.seen.get() if self.seen.exists() else (0, None)
        for pdf in rows:
            t = _plain(pdf["t_us"])
            self.waiting.appendList(list(zip(t, _plain(pdf["request_id"]), strict=True)))
            n, first = n + len(t), min(t) if first is None else min(first, *t)
        self.seen.update((n, first))
        if n >= self.most:                      # the first batch may be full
            t, _ = self._sorted()
            self.wake(self._close(t, 0, int(_jumps(t, self.most, self.wait)[0])), timerValues.getCurrentWatermarkInMs())
        else:
            self.wake(first + self.wait, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def _sorted(self):
        rows = sorted((r[0], r[1]) for r in self.waiting.get())
        return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]

    def _close(self, t, a: int, b: int) -> int:
        return int(t[b - 1]) if b - a == self.most else int(t[a]) + self.wait

    def decide(self, key, watermark_ms):
        t, ids = self._sorted()
        jump, out, a = _jumps(t, self.most, self.wait), [], 0
        while a < len(t) and self._close(t, a, int(jump[a])) < watermark_ms * 1000:
            b = int(jump[a])
            out.append((*key, ids[a], b - a, int(t[a]), int(t[b - 1]), self._close(t, a, b)))
            a = b
        if a == len(t):
            self.waiting.clear()
            self.seen.clear()
        else:
            if a:
                self.waiting.put(list(zip(_plain(t[a:]), ids[a:], strict=True)))
                self.seen.update((len(t) - a, int(t[a])))
            self.wake(self._close(t, a, int(jump[a])), watermark_ms)
        if out:
            yield pd.DataFrame(out, columns=self.columns)


def replica_batches(reqs: DataFrame, max_batch: int, max_wait_s: float, keys=("model", "replica")) -> DataFrame:
    """Count-or-time batches of each key: ``(*keys, batch_id, batch_size, open_us, last_us, close_us)``.

    A batch opens at its first request, takes at most ``max_batch`` and closes
    ``max_wait_s`` after opening; it is emitted once the watermark proves it closed.
    Order within a key is by time, then id. ``reqs`` has a watermark on ``ts``.
    """
    keys = list(keys)
    id_type = reqs.schema["request_id"].dataType
    fields = [T.StructField("batch_id", id_type), T.StructField("batch_size", T.IntegerType()), T.StructField("open_us", T.LongType()),
              T.StructField("last_us", T.LongType()), T.StructField("close_us", T.LongType())]
    schema = T.StructType([reqs.schema[k] for k in keys] + fields)
    src = reqs.select(*keys, "request_id", "ts", epoch_us("ts").alias("t_us"))
    return src.groupBy(*keys).transformWithStateInPandas(
        _Batcher(int(max_batch), int(round(max_wait_s * US)), id_type.simpleString(), schema.fieldNames()), schema, "Append", "EventTime")


# ---------------------------------------------------------------- sliding limit

class _SlidingLimit(_Timed):
    """Requests wait in chunks; a call appends what arrived, and what is over leaves when it is half of the state."""

    def __init__(self, limit: int, period: int, id_type: str, columns: list[str]):
        self.limit, self.period, self.id_type, self.columns = limit, period, id_type, columns
        self.width = max(1, period // SLOTS)

    def init(self, handle) -> None:
        super().init(handle)
        self.slots = handle.getListState("slots", f"t array<long>, client array<string>, id array<{self.id_type}>")
        self.done = handle.getValueState("done", "us long")     # requests before it are decided

    def handleInputRows(self, key, rows, timerValues):
        chunks = [(pdf["t_us"].tolist(), pdf["client"].tolist(), _plain(pdf["request_id"])) for pdf in rows if len(pdf)]
        if chunks:
            self.slots.appendList(chunks)
            self.wake(min(min(c[0]) for c in chunks), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def decide(self, key, watermark_ms):
        now, done = watermark_ms * 1000, self.done.get()[0] if self.done.exists() else -(1 << 62)
        times, clients, ids = [], [], []
        for some, whose, their in self.slots.get():
            times += some
            clients += whose
            ids += their
        t, (code, _) = np.array(times, np.int64), pd.factorize(np.array(clients, object), use_na_sentinel=False)
        # clients side by side, further apart than a window reaches
        at = np.sort(code * (int(t.max() - t.min()) + self.period + 1) + (t - t.min()))
        due = np.flatnonzero((t >= done) & (t < now))
        mine = code[due] * (int(t.max() - t.min()) + self.period + 1) + (t[due] - t.min())
        count = np.searchsorted(at, mine, "right") - np.searchsorted(at, mine - self.period, "left")
        self.done.update((now,))
        # no later window reaches back before this slot of the period
        left = np.flatnonzero(t >= (now - self.period) // self.width * self.width).tolist()
        if not left:
            self.slots.clear()
        elif 2 * len(left) <= len(t):
            self.slots.put([([times[i] for i in left], [clients[i] for i in left], [ids[i] for i in left])])
        if (t >= now).any():
            self.wake(int(t[t >= now].min()), watermark_ms)
        if len(due):
            some = due.tolist()
            yield pd.DataFrame(dict(zip(self.columns, ([clients[i] for i in some], [ids[i] for i in some], count.astype(np.int64), count > self.limit), strict=True)))


def sliding_limit(reqs: DataFrame, limit: int, period_s: float) -> DataFrame:
    """For every request, the client's requests in ``[t - period, t]``: ``(client, request_id, n_in_window, over_limit)``.

    Decided once the watermark has passed the request, so that requests out of
    order count; equal times count each other. ``reqs`` has a watermark on ``ts``.
    Clients share ``KEYS`` state keys by hash: what a key costs besides its
    requests does not grow with the number of clients.
    """
    id_type, client = reqs.schema["request_id"].dataType, reqs.schema["client"].dataType
    schema = T.StructType([T.StructField("client", T.StringType()), T.StructField("request_id", id_type), T.StructField("n_in_window", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    text = F.hex("client") if client == T.BinaryType() else F.col("client").cast("string")
    src = reqs.select(F.pmod(F.xxhash64("client"), F.lit(KEYS)).alias("part"), text.alias("client"), "request_id", "ts", epoch_us("ts").alias("t_us"))
    out = src.groupBy("part").transformWithStateInPandas(
        _SlidingLimit(int(limit), int(round(period_s * US)), id_type.simpleString(), schema.fieldNames()), schema, "Append", "EventTime")
    back = F.unhex("client") if client == T.BinaryType() else F.col("client").cast(client)
    return out.withColumn("client", back)


# ---------------------------------------------------------------- repeated requests

def first_requests(reqs: DataFrame) -> DataFrame:
    """Each request id once: repeats within the watermark's delay (a replayed file, a retried send) are dropped.

    State is kept for the delay only. ``reqs`` has a watermark on ``ts``.
    """
    return reqs.dropDuplicatesWithinWatermark(["request_id"])
