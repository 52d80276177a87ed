"""Registered queries: Structured Streaming operators (file stream -> parquet sink).

Each query runs a streaming job to the end of its input with
``trigger(availableNow)`` and returns the sink as a table. Append mode emits
a window or a batch once the watermark proves it final, so the oracles apply
the same rule with the final watermark (max event time - delay).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators.encode import apply_encoder
from ..session import prepare, scratch_path
from ..sources.dataset import document_samples
from ..streaming.jobs import (file_stream, request_stream, run_available_now, stream_dynamic_batches,
                              timeouts_join, windowed_counts)
from .catalog_data import HASH_TEXT, HASH_TEXT_SQL, TEXT_DIM
from .catalog_requests import BATCH_MAX, BATCH_WAIT_S, RATE_LIMIT, TIMEOUT_S

DELAY = "10 minutes"
DELAY_US = 600 * 1_000_000
RESPONSE_BOUND_S = 30
# final watermark in microseconds (Spark keeps it in milliseconds)
WM_SQL = f"((epoch_us((SELECT max(ts) FROM events)) // 1000) * 1000 - {DELAY_US})"


def _run(spark, df, name):
    root = scratch_path(spark, "stream_" + name)
    return run_available_now(df, root + "/out", root + "/checkpoint")


@register("stream_encode", HASH_TEXT_SQL.format(dim=TEXT_DIM))
def stream_encode(spark, sf_dir):
    """Documents arriving as a stream, encoded by the batched model UDF, written to parquet."""
    prepare(spark)
    docs = file_stream(spark, sf_dir, "documents")
    samples = document_samples(docs).select("key", "caption")
    enc = apply_encoder(samples, HASH_TEXT, text_col="caption")
    out = enc.select("key", F.posexplode("embedding").alias("dim", "value")).where(F.col("value") != 0)
    res = _run(spark, out, "encode")
    return res.select("key", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


def _reqs(spark, sf_dir):
    prepare(spark)
    return request_stream(file_stream(spark, sf_dir, "events"), DELAY)


@register("stream_requests_total", f"""
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, model, status, CAST(count(*) AS BIGINT) AS n
FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, event_type AS model,
             CASE WHEN value / 100 > {TIMEOUT_S} THEN 'timeout' WHEN event_type = 'error' THEN 'error'
                  ELSE 'success' END AS status FROM events)
GROUP BY b, model, status
HAVING epoch_us(b) + 86400000000 <= {WM_SQL}""")
def stream_requests_total(spark, sf_dir):
    """Requests per model and status per day, emitted as each day closes."""
    r = _reqs(spark, sf_dir)
    status = (F.when(F.col("duration_s") > F.lit(TIMEOUT_S), "timeout")
              .when(F.col("failed"), "error").otherwise("success"))
    c = windowed_counts(r.withColumn("status", status), "1 day", ["model", "status"])
    res = _run(spark, c, "requests_total")
    return res.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "model", "status", "n")


@register("stream_rate_limit", f"""
SELECT client, strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS n
FROM (SELECT user_id AS client, time_bucket(INTERVAL 1 DAY, ts) AS b FROM events)
GROUP BY client, b
HAVING count(*) > {RATE_LIMIT} AND epoch_us(b) + 86400000000 <= {WM_SQL}""")
def stream_rate_limit(spark, sf_dir):
    """Clients over the per-day limit, reported as each day closes."""
    r = _reqs(spark, sf_dir)
    c = windowed_counts(r, "1 day", ["client"]).where(F.col("n") > RATE_LIMIT)
    res = _run(spark, c, "rate_limit")
    return res.select("client", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@register("stream_timeouts", f"""
SELECT event_id AS request_id, NOT coalesce(value >= 0 AND value <= {RESPONSE_BOUND_S}, false) AS timed_out
FROM events
WHERE coalesce(value >= 0 AND value <= {RESPONSE_BOUND_S}, false)
   OR epoch_us(ts) + {RESPONSE_BOUND_S} * 1000000 < {WM_SQL}""")
def stream_timeouts(spark, sf_dir):
    """Requests joined to a response stream (answer at ts + value s) within 30 s;
    unmatched ones are timeouts once the watermark passes their bound."""
    prepare(spark)
    reqs = request_stream(file_stream(spark, sf_dir, "events"), DELAY)
    resp_src = file_stream(spark, sf_dir, "events")
    resp = resp_src.select(F.col("event_id").alias("request_id"),
                           (F.col("ts").cast("timestamp") + F.make_dt_interval(
                               secs=F.coalesce(F.col("value"), F.lit(-1.0)).cast("decimal(18,6)"))).alias("resp_ts")) \
                   .withWatermark("resp_ts", DELAY)
    j = timeouts_join(reqs, resp, RESPONSE_BOUND_S)
    return _run(spark, j, "timeouts")


from .catalog_requests import DYN_SQL, LOG_SQL  # noqa: E402


@register("stream_dynamic_batches", f"""
WITH RECURSIVE {LOG_SQL}, {DYN_SQL}
SELECT model, batch_id, batch_size, CAST(open_us AS BIGINT) AS open_us, CAST(close_us AS BIGINT) AS close_us
FROM batches
WHERE (batch_size = {BATCH_MAX} AND last_us < {WM_SQL}) OR (open_us + {int(BATCH_WAIT_S * 1e6)} < {WM_SQL})""")
def stream_dynamic_batches_q(spark, sf_dir):
    """Count-or-time micro-batches on the request stream (state per model, event-time timers)."""
    b = stream_dynamic_batches(_reqs(spark, sf_dir), BATCH_MAX, BATCH_WAIT_S)
    res = _run(spark, b, "dynamic_batches")
    return res.select("model", "batch_id", "batch_size", "open_us", "close_us")


from ..sources.dataset import sample_dataset  # noqa: E402
from ..streaming.jobs import run_lanes, shard_lanes  # noqa: E402
from .catalog_data import SAMPLES_SQL, SHARD_ROWS  # noqa: E402


@register("stream_backpressure", f"""
SELECT CAST(count(*) AS BIGINT) AS rows_in_batch FROM ({SAMPLES_SQL}) GROUP BY grp, id // {SHARD_ROWS}""")
def stream_backpressure(spark, sf_dir):
    """Admission control on a stream: at most one shard per micro-batch
    (``maxFilesPerTrigger``); rows that every micro-batch carried, from the data.
    Shards go to lanes by the last digits of their number, each lane a stream."""
    prepare(spark)
    root = sample_dataset(spark, sf_dir, SHARD_ROWS)
    lanes = [shards.select("key") for shards in shard_lanes(spark, root)]
    base = scratch_path(spark, "stream_backpressure")
    carried = run_lanes(lanes, base + "/out", base + "/checkpoint")
    return carried.groupBy("lane", "batch_id").agg(F.count(F.lit(1)).alias("rows_in_batch")).select("rows_in_batch")


from ..functions.images import DEFAULT_MAX_MB, decoded_size_mb  # noqa: E402
from ..functions.urls import normalize_file_uri  # noqa: E402
from ..models.base import EncoderSpec  # noqa: E402
from ..models.builtin import PixelGridEncoder  # noqa: E402
from .catalog_images import GRID, IMG_RULES_SQL, PIXELS_SQL, _image_dir  # noqa: E402


@register("stream_validate_encode", f"""
WITH {PIXELS_SQL},
g AS (
  SELECT vec_id, (i // 8 // 2) * 4 + (i % 8) // 2 AS cell,
         CASE c WHEN 1 THEN p ELSE (p + (p + 40) % 256 + (p + 80) % 256) / 3.0 END / 255.0 AS v
  FROM px WHERE kind IN ('png', 'bmp')),
f AS (SELECT vec_id, cell, avg(v) AS x FROM g GROUP BY vec_id, cell),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM f GROUP BY vec_id)
SELECT CAST(f.vec_id AS VARCHAR) AS key, 'ok' AS status, CAST(cell AS INTEGER) AS dim, round(x / nrm, 6) AS value
FROM f JOIN n USING (vec_id) WHERE x <> 0
UNION ALL
SELECT CAST(vec_id AS VARCHAR), 'undecodable_image', NULL, NULL FROM ({IMG_RULES_SQL}) WHERE kind IN ('junk', 'truncated')""")
def stream_validate_encode(spark, sf_dir):
    """Online path on a stream: image requests -> validation -> encoder -> response rows
    (rejected requests answered with their reason, no model call)."""
    prepare(spark)
    out, _ = _image_dir(spark, sf_dir)
    schema = spark.read.format("image").load(out).schema
    s = spark.readStream.format("image").schema(schema).option("dropInvalid", "false").load(out)
    img = s.select(normalize_file_uri("image.origin").alias("file"), "image.height", "image.width",
                   "image.nChannels", "image.data")
    reason = (F.when((F.col("width") < 0) | (F.col("nChannels") < 0), "undecodable_image")
              .when((F.col("width") == 0) | (F.col("height") == 0), "invalid_dimensions")
              .when(decoded_size_mb("width", "height", "nChannels") > F.lit(DEFAULT_MAX_MB), "image_too_large"))
    key = F.regexp_extract("file", r"img_([0-9]+)\.", 1).cast("long").cast("string")
    req = img.select(key.alias("key"), reason.alias("reject_reason"), "data", "height", "width", "nChannels")
    enc = apply_encoder(req, EncoderSpec.of(PixelGridEncoder, grid=GRID),
                        image_cols=("data", "height", "width", "nChannels"), skip_col="reject_reason")
    resp = enc.select("key", F.coalesce("reject_reason", F.lit("ok")).alias("status"),
                      F.posexplode_outer("embedding").alias("dim", "value"))
    resp = resp.where(F.col("value").isNull() | (F.col("value") != 0))
    res = _run(spark, resp, "validate_encode")
    return res.select("key", "status", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


from ..operators import metrics as M  # noqa: E402


def _stream_hist_sql():
    vals = ", ".join(f"('{b}', CAST('{b}' AS DOUBLE))" for b in M.DURATION_BUCKETS)
    src = f"""(SELECT time_bucket(INTERVAL 1 DAY, ts) AS b, event_type AS model, value / 100 AS d FROM events
              WHERE epoch_us(time_bucket(INTERVAL 1 DAY, ts)) + 86400000000 <= {WM_SQL})"""
    ws = "strftime(b, '%Y-%m-%d %H:%M:%S')"
    return f"""
SELECT {ws} AS window_start, model, 'bucket' AS sample, le, CAST(count(*) FILTER (WHERE d <= ub) AS DOUBLE) AS value
FROM {src} CROSS JOIN (VALUES {vals}) AS t(le, ub) GROUP BY b, model, le
UNION ALL SELECT {ws}, model, 'bucket', '+Inf', CAST(count(d) AS DOUBLE) FROM {src} GROUP BY b, model
UNION ALL SELECT {ws}, model, 'count', NULL, CAST(count(d) AS DOUBLE) FROM {src} GROUP BY b, model
UNION ALL SELECT {ws}, model, 'sum', NULL, round(sum(d), 6) FROM {src} GROUP BY b, model"""


@register("stream_duration_histogram", _stream_hist_sql())
def stream_duration_histogram(spark, sf_dir):
    """Cumulative request-duration histogram per model and day, emitted as each day closes."""
    r = _reqs(spark, sf_dir)
    wide = r.groupBy(F.window("ts", "1 day").alias("w"), "model").agg(*M.histogram_aggs("duration_s"))
    rows = M.stack_histogram(wide.withColumn("window_start", F.col("w.start")), ["window_start", "model"],
                             M.DURATION_BUCKETS)
    res = _run(spark, rows, "duration_histogram")
    value = F.when(F.col("sample") == "sum", F.round("value", 6)).otherwise(F.col("value"))
    return res.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "model", "sample", "le", value.alias("value"))


from ..streaming.stateful import first_requests, replica_batches, rocksdb, sliding_limit  # noqa: E402

REPLICAS = 4
REPLICA_LOG_SQL = LOG_SQL.replace("event_type AS model", f"event_type || '/' || CAST(user_id % {REPLICAS} AS VARCHAR) AS model")


@register("stream_replica_batches", f"""
WITH RECURSIVE {REPLICA_LOG_SQL}, {DYN_SQL}
SELECT split_part(model, '/', 1) AS model, CAST(split_part(model, '/', 2) AS BIGINT) AS replica, batch_id, batch_size,
       CAST(open_us AS BIGINT) AS open_us, CAST(close_us AS BIGINT) AS close_us
FROM batches
WHERE (batch_size = {BATCH_MAX} AND last_us < {WM_SQL}) OR (open_us + {int(BATCH_WAIT_S * 1e6)} < {WM_SQL})""")
def stream_replica_batches(spark, sf_dir):
    """Count-or-time batches of each (model, replica) on the request stream: list state, event-time timers."""
    reqs = _reqs(spark, sf_dir).withColumn("replica", F.pmod("client", F.lit(REPLICAS)))
    with rocksdb(spark):
        res = _run(spark, replica_batches(reqs, BATCH_MAX, BATCH_WAIT_S), "replica_batches")
    return res.select("model", F.col("replica").cast("long").alias("replica"), "batch_id", "batch_size", "open_us", "close_us")


@register("stream_rate_limit_sliding", f"""
SELECT client, request_id, n_in_window, n_in_window > {RATE_LIMIT} AS over_limit FROM (
  SELECT user_id AS client, event_id AS request_id, ts, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts
         RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n_in_window FROM events)
WHERE epoch_us(ts) < {WM_SQL}""")
def stream_rate_limit_sliding(spark, sf_dir):
    """A decision for every request of the stream: the client's requests in the day up to it (list state of requests)."""
    with rocksdb(spark):
        return _run(spark, sliding_limit(_reqs(spark, sf_dir), RATE_LIMIT, 86400.0), "rate_limit_sliding")


@register("stream_replayed_requests", "SELECT event_id AS request_id, event_type AS model, user_id AS client FROM events")
def stream_replayed_requests(spark, sf_dir):
    """The request stream with every file sent twice: each request once."""
    prepare(spark)
    twice = file_stream(spark, sf_dir, "events").unionByName(file_stream(spark, sf_dir, "events"))
    return _run(spark, first_requests(request_stream(twice, DELAY)).select("request_id", "model", "client"), "replayed")


from ..operators.sketches import interval_sketches, quantiles, roll_up  # noqa: E402
from .catalog_requests import request_log  # noqa: E402

LATENCY = {"p50_s": 0.5, "p95_s": 0.95, "p99_s": 0.99}


def _latency_sql(where: str) -> str:
    ps = ", ".join(f"quantile_disc(value / 100, {p}) AS {name}" for name, p in LATENCY.items())
    return f"""
SELECT event_type AS model, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(value) AS BIGINT) AS n, {ps}
FROM events WHERE {where} GROUP BY ALL"""


def _daily(minutes):
    days = quantiles(roll_up(roll_up(minutes, ["model"], "1 hour"), ["model"], "1 day"), LATENCY)
    return days.select("model", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", *LATENCY)


@register("latency_quantile_rollup", _latency_sql("true"))
def latency_quantile_rollup(spark, sf_dir):
    """Latency quantiles per model and day, merged from the binary sketches of minutes through those of hours."""
    log = request_log(spark, sf_dir)
    return _daily(interval_sketches(log, ["model"], "1 minute", "duration_s", "enqueue_ts"))


@register("stream_latency_quantiles", _latency_sql(f"epoch_us(time_bucket(INTERVAL 1 MINUTE, ts)) + 60000000 <= {WM_SQL}"))
def stream_latency_quantiles(spark, sf_dir):
    """The same from a stream: sketches of closed minutes go to the sink, days are merged from it."""
    return _daily(_run(spark, interval_sketches(_reqs(spark, sf_dir), ["model"], "1 minute", "duration_s", "ts"), "latency_sketches"))


from ..streaming.live_metrics import LiveMetrics, run_measured  # noqa: E402
from .catalog_requests import _expo_hist_sql  # noqa: E402

# Event types of the given log, which stand for models.
MODELS = ["click", "error", "purchase", "signup", "view"]


@register("stream_metrics_live", f"""
WITH {LOG_SQL}
SELECT '# HELP {M.REQUESTS_TOTAL[0]} {M.REQUESTS_TOTAL[1]}' AS line UNION ALL SELECT '# TYPE {M.REQUESTS_TOTAL[0]} counter'
UNION ALL SELECT '{M.REQUESTS_TOTAL[0]}{{model="' || model || '",status="' || status || '"}} ' || CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) FROM log GROUP BY model, status
UNION ALL {_expo_hist_sql(M.REQUEST_DURATION, "log", "duration_s", M.DURATION_BUCKETS)}""")
def stream_metrics_live(spark, sf_dir):
    """Exposition of what a query listener gathered while the request stream ran."""
    reqs = _reqs(spark, sf_dir)
    status = (F.when(F.col("duration_s") > F.lit(TIMEOUT_S), "timeout").when(F.col("failed"), "error").otherwise("success"))
    live = LiveMetrics(MODELS, ["success", "error", "timeout"])
    root = scratch_path(spark, "stream_live")
    run_measured(reqs.withColumn("status", status), root + "/out", root + "/checkpoint", live)
    return live.exposition(spark, with_rate=False)
