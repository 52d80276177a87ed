"""Request-log analytics: the online path's queue semantics as table operators.

A request log has one row per request with at least ``request_id``,
``model``, ``client``, ``enqueue_ts`` (timestamp) and ``duration_s``; the
helpers below derive status, queue depth, rate-limit audits, timeouts and
dynamic micro-batches from it. Times inside are integer microseconds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import ordinal, running_sums

# Service defaults (queue bound, request timeout, rate limit
# per client and period, model batch size and batch wait).
DEFAULT_MAX_QUEUE = 1024
DEFAULT_TIMEOUT_S = 30.0
DEFAULT_RATE_LIMIT = 100
DEFAULT_RATE_PERIOD_S = 60
DEFAULT_BATCH_SIZE = 16
DEFAULT_BATCH_WAIT_S = 0.003

US = 1_000_000


def epoch_us(ts) -> F.Column:
    """Microseconds since 1970 for TIMESTAMP or TIMESTAMP_NTZ (no time-zone shift)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def _late(timeout_s: float, now_us=None):
    """An answer after ``timeout_s``, or none although that time is over at ``now_us`` (None: it is over)."""
    limit = F.lit(float(timeout_s))
    waited = F.lit(True) if now_us is None else F.lit(now_us) - F.col("enqueue_us") > limit * US
    return F.coalesce(F.col("duration_s") > limit, waited)


def with_status(log: DataFrame, timeout_s: float = DEFAULT_TIMEOUT_S, now_us=None) -> DataFrame:
    """status: timeout (no answer within ``timeout_s``), pending (no answer yet at
    ``now_us``), error, or success; error_type for the errors counter: timeout /
    processing_error."""
    status = (F.when(_late(timeout_s, now_us), "timeout").when(F.col("duration_s").isNull(), "pending")
              .when(F.col("failed"), "error").otherwise("success"))
    etype = F.when(status == "timeout", "timeout").when(status == "error", "processing_error")
    return log.withColumn("status", status).withColumn("error_type", etype)


def request_identity(log: DataFrame, now_ts: str) -> DataFrame:
    """Stable request hash (reproducible under task retry) and age at ``now_ts``.

    A request without an id is identified by all that is known of it.
    """
    known = F.coalesce(F.col("request_id").cast("string"), F.to_json(F.struct(*log.columns)))
    rid = F.sha2(F.concat_ws("|", known, F.col("model")), 256)
    now_us = epoch_us(F.lit(now_ts).cast("timestamp_ntz"))
    return log.select(
        "request_id", rid.alias("request_hash"),
        (F.col("enqueue_us") / F.lit(float(US))).alias("enqueue_epoch_s"),
        ((now_us - F.col("enqueue_us")) / F.lit(1000.0)).alias("age_ms"))


# ------------------------------------------------------------ queue depth
def queue_depth(log: DataFrame, maxsize: int, keys=("model",)) -> DataFrame:
    """Depth after every enqueue (+1) and dequeue (-1) of each key's queue.

    A request without a dequeue time stays in the queue. Ties: a dequeue at the
    same instant is applied before an enqueue, then by request id. The running sum is a range-partitioned scan, so a hot
    model does not end up in one task.
    """
    keys = list(keys)
    event = lambda t, kind, delta: F.struct(F.col(t).alias("t_us"), F.lit(kind).alias("kind"), F.lit(delta).alias("delta"))
    ev = log.select(*keys, "request_id", F.explode(F.array(event("enqueue_us", 1, 1), event("dequeue_us", 0, -1))).alias("e"))
    ev = ev.select(*keys, "request_id", "e.*").where(F.col("t_us").isNotNull())
    d = running_sums(ev, keys, ["t_us", "kind", "request_id"], {"depth": "delta"})
    d = d.withColumn("depth", F.col("depth").cast("long"))
    return d.select(*keys, "request_id", "t_us", F.when(F.col("kind") == 1, "enqueue").otherwise("dequeue").alias("event"),
                    "depth",
                    (F.col("depth") / F.lit(float(maxsize)) if maxsize > 0 else F.lit(0.0)).alias("utilization"),
                    (F.col("depth") == 0).alias("is_empty"),
                    (F.col("depth") >= F.lit(maxsize)).alias("is_full"),
                    (F.col("depth") > F.lit(maxsize)).alias("over_capacity"))


def admission(log: DataFrame, maxsize: int, keys=("model",)) -> DataFrame:
    """Per request: queue depth just before it arrived and whether a bounded
    queue of ``maxsize`` would have been full (``rejected``)."""
    d = queue_depth(log, maxsize, keys).where(F.col("event") == "enqueue")
    return d.select(*keys, "request_id", (F.col("depth") - 1).alias("depth_before"),
                    ((F.col("depth") - 1) >= F.lit(maxsize)).alias("rejected"))


# ------------------------------------------------------------ rate limits
def rate_limit_fixed(log: DataFrame, limit: int, period: str) -> DataFrame:
    """Requests per client per fixed window; ``over_limit`` when count > limit."""
    g = log.groupBy("client", F.window("enqueue_ts", period).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("client", F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("over_limit"))


def rate_limit_sliding(log: DataFrame, limit: int, period_s: float) -> DataFrame:
    """For every request, the client's requests in ``[t - period, t]``.

    Computed as a difference of two prefix counts on probe rows, with the
    range-partitioned scan; a client with a third of all traffic is still
    spread over many tasks.
    """
    p_us = int(round(period_s * US))
    def row(shift: int, kind: int, weight: int, probe):
        return F.struct((F.col("enqueue_us") - shift).alias("t_us"), F.lit(kind).alias("kind"), F.lit(weight).alias("w"), F.lit(probe).cast("int").alias("probe"))
    ev = log.select("client", "request_id", F.explode(F.array(row(p_us, 0, 0, 0), row(0, 1, 1, None), row(0, 2, 0, 1))).alias("e"))
    s = running_sums(ev.select("client", "request_id", "e.*"), ["client"], ["t_us", "kind", "request_id"], {"cum": "w"})
    probes = s.where(F.col("probe").isNotNull())
    n = probes.groupBy("client", "request_id").agg(
        (F.sum(F.when(F.col("probe") == 1, F.col("cum"))) - F.sum(F.when(F.col("probe") == 0, F.col("cum"))))
        .cast("long").alias("n_in_window"))
    return n.withColumn("over_limit", F.col("n_in_window") > F.lit(int(limit)))


def timeouts(log: DataFrame, timeout_s: float = DEFAULT_TIMEOUT_S, now_us=None) -> DataFrame:
    """Requests answered too late, or not at all although their time is over at ``now_us``."""
    return log.where(_late(timeout_s, now_us))


# ------------------------------------------------------------ dynamic batching
def _jumps(ts: np.ndarray, B: int, W: int) -> np.ndarray:
    n = len(ts)
    lim = np.searchsorted(ts, ts + W, side="right")
    return np.minimum(np.arange(n) + B, lim)


def _transitions(B, W, C):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_local")
        ts = pdf["t_us"].to_numpy(np.int64)
        own = int((pdf["_local"].to_numpy() < C).sum())
        jump = _jumps(ts, B, W)
        exit_of: dict[int, int] = {}
        exits = []
        for o in range(B):
            if o >= own:
                exits.append(0)
                continue
            path, s = [], o
            while s < own and s not in exit_of:
                path.append(s)
                s = int(jump[s])
            e = exit_of[s] if s in exit_of else s - C
            for p in path:
                exit_of[p] = e
            exits.append(int(e))
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "_chunk": [int(pdf["_chunk"].iloc[0])], "exits": [exits]})
    return fn


def _members(B, W, C):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_local")
        ts = pdf["t_us"].to_numpy(np.int64)
        ids = pdf["request_id"].to_numpy()
        own = int((pdf["_local"].to_numpy() < C).sum())
        jump = _jumps(ts, B, W)
        chunk = int(pdf["_chunk"].iloc[0])
        starts = []
        s = int(pdf["entry"].iloc[0])
        while s < own:
            starts.append(s)
            s = int(jump[s])
        starts = np.asarray(starts, dtype=np.int64)
        ends = jump[starts] if len(starts) else np.asarray([], dtype=np.int64)
        sizes = ends - starts
        rows = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]) if len(starts) else np.asarray([], dtype=np.int64)
        start_of = np.repeat(starts, sizes)
        size_of = np.repeat(sizes, sizes)
        open_us = ts[start_of]
        last_us = ts[ends - 1][np.repeat(np.arange(len(starts)), sizes)] if len(starts) else np.asarray([], dtype=np.int64)
        close_us = np.where(size_of == B, last_us, open_us + W)
        out = {"_key": pd.Series([pdf["_key"].iloc[0]] * len(rows), dtype=object)}  # a chunk may open no batch
        out.update({
            "request_id": ids[rows],
            "batch_id": ids[start_of],
            "batch_seq": (chunk * C + start_of).astype(np.int64),
            "batch_pos": (rows - start_of).astype(np.int32),
            "batch_size": size_of.astype(np.int32),
            "enqueue_us": ts[rows],
            "open_us": open_us,
            "last_us": last_us,
            "close_us": close_us,
        })
        return pd.DataFrame(out)
    return fn


def dynamic_batches(log: DataFrame, max_batch: int, max_wait_s: float, keys=("model",),
                    chunk_rows: int = 50_000) -> DataFrame:
    """Count-or-time micro-batching of each key's requests (a null key is a key).

    A batch opens at its first request and takes the following requests
    (by enqueue time, then id) while it has fewer than ``max_batch`` members
    and their enqueue time is at most ``open + max_wait``. The greedy rule
    is sequential, so it is run in parallel chunks of ``chunk_rows``:

    1. per key ordinal (range-partitioned prefix count);
    2. per chunk (plus a halo of ``max_batch - 1`` following rows) the exit
       offset for each of the ``max_batch`` possible entry offsets;
    3. entry offsets of all chunks by composing those small maps in two levels
       (``_entries``);
    4. per chunk, the batches from its entry offset.

    No task holds more than ``chunk_rows + max_batch - 1`` requests. Steps 2 and 4
    read one exchange of the chunks; nothing runs before an action.
    """
    keys = list(keys)
    B, W, C = int(max_batch), int(round(max_wait_s * US)), int(chunk_rows)
    if C < B:
        raise ValueError("chunk_rows must be at least max_batch")
    base = log.select(*keys, "request_id", F.col("enqueue_us").alias("t_us"))
    r = ordinal(base, keys, ["t_us", "request_id"], "_rn").withColumn("_chunk", F.floor(F.col("_rn") / C).cast("long"))
    r = r.withColumn("_local", F.col("_rn") - F.col("_chunk") * C)
    # a chunk's first rows are also the halo of the chunk before it
    own = F.struct(F.col("_chunk").alias("c"), F.col("_local").alias("l"))
    halo = F.struct((F.col("_chunk") - 1).alias("c"), (F.col("_local") + C).alias("l"))
    places = F.when((F.col("_local") < B - 1) & (F.col("_chunk") > 0), F.array(own, halo)).otherwise(F.array(own))
    # a struct is never null, so null keys join and group like others
    chunks = (r.select(F.struct(*keys).alias("_key"), "t_us", "request_id", F.explode(places).alias("p"))
              .select("_key", F.col("p.c").alias("_chunk"), F.col("p.l").alias("_local"), "t_us", "request_id"))
    chunks = chunks.repartition("_key", "_chunk")

    kind = chunks.schema["_key"]
    tr_schema = T.StructType([kind, T.StructField("_chunk", T.LongType()), T.StructField("exits", T.ArrayType(T.IntegerType()))])
    maps = chunks.groupBy("_key", "_chunk").applyInPandas(_transitions(B, W, C), tr_schema)
    with_entry = chunks.join(_entries(maps, B), on=["_key", "_chunk"], how="left")
    missing = F.raise_error(F.lit("a chunk of requests has no entry offset")).cast("int")
    with_entry = with_entry.withColumn("entry", F.coalesce(F.col("entry"), missing))
    id_type = log.schema["request_id"].dataType
    out_schema = T.StructType([kind, T.StructField("request_id", id_type), T.StructField("batch_id", id_type),
        T.StructField("batch_seq", T.LongType()), T.StructField("batch_pos", T.IntegerType()),
        T.StructField("batch_size", T.IntegerType()), T.StructField("enqueue_us", T.LongType()),
        T.StructField("open_us", T.LongType()), T.StructField("last_us", T.LongType()),
        T.StructField("close_us", T.LongType())])
    out = with_entry.groupBy("_key", "_chunk").applyInPandas(_members(B, W, C), out_schema)
    return out.select("_key.*", *out.columns[1:])


#: chunks folded together; two levels reach FOLD^2 chunks of a key
FOLD = 4096


def _entries(maps: DataFrame, B: int) -> DataFrame:
    """entry_0 = 0, entry_{k+1} = exits_k[entry_k] for the chunks of each key.

    Runs of ``FOLD`` chunks are composed into one map each, the maps of a key's
    runs are folded from entry 0, and each run is folded from its own entry. A
    group holds at most ``FOLD`` maps of B numbers.
    """
    def fold(ms, start):
        return F.aggregate(ms, F.struct(start.cast("int").alias("e"), F.array().cast("array<int>").alias("es")),
                           lambda acc, m: F.struct(F.element_at(m["exits"], acc["e"] + 1).alias("e"), F.concat(acc["es"], F.array(acc["e"])).alias("es")))["es"]
    run = F.floor(F.col("_chunk") / FOLD).cast("long")
    runs = (maps.groupBy("_key", run.alias("_run"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_chunk").alias("c"), "exits"))).alias("ms")))
    identity = F.array(*[F.lit(i) for i in range(B)])
    whole = F.aggregate("ms", identity, lambda acc, m: F.transform(acc, lambda e: F.element_at(m["exits"], e + 1)))
    per_key = (runs.select("_key", "_run", whole.alias("exits")).groupBy("_key")
               .agg(fold(F.array_sort(F.collect_list(F.struct(F.col("_run").alias("c"), "exits"))), F.lit(0)).alias("es")))
    starts = per_key.select("_key", F.posexplode("es").alias("_run", "start")).withColumn("_run", F.col("_run").cast("long"))
    inner = runs.join(starts, on=["_key", "_run"]).select("_key", "_run", F.posexplode(fold(F.col("ms"), F.col("start"))).alias("i", "entry"))
    return inner.select("_key", (F.col("_run") * FOLD + F.col("i")).alias("_chunk"), "entry")


def batch_summary(members: DataFrame, keys=("model",)) -> DataFrame:
    """One row per batch: size, open/last/close, wait = last - open (seconds)."""
    keys = list(keys)
    return members.where(F.col("batch_pos") == 0).select(
        *keys, "batch_id", "batch_seq", "batch_size", "open_us", "last_us", "close_us",
        ((F.col("last_us") - F.col("open_us")) / F.lit(float(US))).alias("wait_s"))
