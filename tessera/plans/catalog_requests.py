"""Registered queries: request-log analytics on ``events``.

Fixture mapping: model = event_type, client = user_id, request_id =
event_id, enqueue time = ts, duration_s = value / 100, a request of type
``error`` failed, dequeue time = ts + value minutes. Events are minutes
apart, so the time parameters are scaled: timeout 2 s, batch wait 1 h,
rate period 1 day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import metrics as M
from ..operators.requests import (admission, batch_summary, dynamic_batches, epoch_us, queue_depth,
                                  rate_limit_fixed, rate_limit_sliding, request_identity, timeouts,
                                  with_status)
from ..operators.stats import exact_percentiles
from ..operators.validate import http_status
from ..session import prepare, scratch_path, table
from ..sinks.files import write_lines

TIMEOUT_S = 2.0
MAXSIZE = 6
RATE_LIMIT = 6
BATCH_MAX = 8
BATCH_WAIT_S = 3600.0
CHUNK_ROWS = 1024
NOW = "2024-01-15 12:00:00"
WAIT_BUCKETS = ("60.0", "120.0", "300.0", "600.0", "1200.0", "1800.0", "3600.0")


def request_log(spark, sf_dir):
    prepare(spark)
    ev = table(spark, sf_dir, "events")
    log = ev.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("model"),
                    F.col("user_id").alias("client"), F.col("ts").alias("enqueue_ts"),
                    (F.col("value") / 100).alias("duration_s"),
                    (F.col("event_type") == "error").alias("failed"), "props", "value")
    us = epoch_us("enqueue_ts")
    log = log.withColumn("enqueue_us", us).withColumn(
        "dequeue_us", us + F.round(F.coalesce(F.col("value"), F.lit(0.0)) * 60_000_000).cast("long"))
    return with_status(log, TIMEOUT_S)


LOG_SQL = f"""
log AS (
  SELECT event_id AS request_id, event_type AS model, user_id AS client, ts AS enqueue_ts,
         value / 100 AS duration_s, props, value,
         epoch_us(ts) AS enqueue_us,
         epoch_us(ts) + CAST(round(coalesce(value, 0) * 60000000) AS BIGINT) AS dequeue_us,
         CASE WHEN value / 100 > {TIMEOUT_S} THEN 'timeout' WHEN event_type = 'error' THEN 'error'
              ELSE 'success' END AS status,
         CASE WHEN value / 100 > {TIMEOUT_S} THEN 'timeout' WHEN event_type = 'error' THEN 'processing_error'
         END AS error_type
  FROM events)"""

DEPTH_SQL = f"""
ev AS (
  SELECT model, request_id, enqueue_us AS t_us, 1 AS kind, 1 AS delta FROM log
  UNION ALL SELECT model, request_id, dequeue_us, 0, -1 FROM log),
depth AS (
  SELECT *, CAST(sum(delta) OVER (PARTITION BY model ORDER BY t_us, kind, request_id
                                  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM ev),
adm AS (SELECT model, request_id, depth - 1 AS depth_before, depth - 1 >= {MAXSIZE} AS rejected
        FROM depth WHERE kind = 1)"""

DYN_SQL = f"""
j AS (
  SELECT model, request_id, enqueue_us, rn, least(rn + {BATCH_MAX}, rn + cnt_w) AS nxt FROM (
    SELECT model, request_id, enqueue_us,
           row_number() OVER (PARTITION BY model ORDER BY enqueue_ts, request_id) - 1 AS rn,
           count(*) OVER (PARTITION BY model ORDER BY enqueue_ts
                          RANGE BETWEEN CURRENT ROW AND INTERVAL {int(BATCH_WAIT_S)} SECOND FOLLOWING) AS cnt_w
    FROM log)),
starts AS (
  SELECT DISTINCT model, CAST(0 AS BIGINT) AS s FROM j
  UNION ALL
  SELECT j.model, j.nxt FROM starts JOIN j ON j.model = starts.model AND j.rn = starts.s),
batches AS (
  SELECT o.model, o.request_id AS batch_id, CAST(o.nxt - o.rn AS INTEGER) AS batch_size,
         o.enqueue_us AS open_us, l.enqueue_us AS last_us,
         CASE WHEN o.nxt - o.rn = {BATCH_MAX} THEN l.enqueue_us ELSE o.enqueue_us + {int(BATCH_WAIT_S * 1e6)} END AS close_us,
         o.rn AS s, o.nxt AS e
  FROM starts st JOIN j o ON o.model = st.model AND o.rn = st.s
  JOIN j l ON l.model = st.model AND l.rn = o.nxt - 1)"""


def _with(*parts):
    return "WITH RECURSIVE " + ",\n".join(parts)


@register("requests_total", _with(LOG_SQL) + """
SELECT model, status, CAST(count(*) AS DOUBLE) AS value FROM log GROUP BY model, status""")
def requests_total(spark, sf_dir):
    return M.counter(request_log(spark, sf_dir), ["model", "status"])


@register("errors_total", _with(LOG_SQL) + """
SELECT model, error_type, CAST(count(*) AS DOUBLE) AS value FROM log
WHERE error_type IS NOT NULL GROUP BY model, error_type""")
def errors_total(spark, sf_dir):
    return M.counter(request_log(spark, sf_dir).where(F.col("error_type").isNotNull()), ["model", "error_type"])


@register("rejections_total", _with(LOG_SQL, DEPTH_SQL) + """
SELECT model, CAST(count(*) AS DOUBLE) AS value FROM adm WHERE rejected GROUP BY model""")
def rejections_total(spark, sf_dir):
    adm = admission(request_log(spark, sf_dir), MAXSIZE)
    return M.counter(adm.where("rejected"), ["model"])


def _hist_sql(src: str, col: str, buckets) -> str:
    vals = ", ".join(f"('{b}', CAST('{b}' AS DOUBLE))" for b in buckets)
    return f"""
SELECT model, 'bucket' AS sample, le, CAST(count(*) FILTER (WHERE {col} <= ub) AS DOUBLE) AS value
FROM {src} CROSS JOIN (VALUES {vals}) AS b(le, ub) GROUP BY model, le
UNION ALL SELECT model, 'bucket', '+Inf', CAST(count({col}) AS DOUBLE) FROM {src} GROUP BY model
UNION ALL SELECT model, 'count', NULL, CAST(count({col}) AS DOUBLE) FROM {src} GROUP BY model
UNION ALL SELECT model, 'sum', NULL, round(sum({col}), 6) FROM {src} GROUP BY model"""


def _rounded(hist):
    """Sums to six digits, for comparison."""
    return hist.withColumn("value", F.when(F.col("sample") == "sum", F.round("value", 6)).otherwise(F.col("value")))


@register("duration_histogram", _with(LOG_SQL) + _hist_sql("log", "duration_s", M.DURATION_BUCKETS))
def duration_histogram(spark, sf_dir):
    return _rounded(M.histogram(request_log(spark, sf_dir), "duration_s", ["model"], M.DURATION_BUCKETS))


def _batches(spark, sf_dir):
    members = dynamic_batches(request_log(spark, sf_dir), BATCH_MAX, BATCH_WAIT_S, ["model"], CHUNK_ROWS)
    return members


@register("dynamic_batches", _with(LOG_SQL, DYN_SQL) + """
SELECT model, batch_id, batch_size, round((last_us - open_us) / 1e6, 6) AS wait_s,
       CAST(close_us AS BIGINT) AS close_us FROM batches""")
def dynamic_batches_q(spark, sf_dir):
    """Count-or-time micro-batches (max 8 requests, 1 h wait) per model."""
    b = batch_summary(_batches(spark, sf_dir))
    return b.select("model", "batch_id", "batch_size", F.round("wait_s", 6).alias("wait_s"), "close_us")


@register("batch_size_histogram", _with(LOG_SQL, DYN_SQL) + _hist_sql("batches", "batch_size", M.BATCH_SIZE_BUCKETS))
def batch_size_histogram(spark, sf_dir):
    return _rounded(M.histogram(batch_summary(_batches(spark, sf_dir)), "batch_size", ["model"], M.BATCH_SIZE_BUCKETS))


@register("batch_wait_histogram", _with(LOG_SQL, DYN_SQL)
          + _hist_sql("(SELECT model, (last_us - open_us) / 1e6 AS wait_s FROM batches)", "wait_s", WAIT_BUCKETS))
def batch_wait_histogram(spark, sf_dir):
    return _rounded(M.histogram(batch_summary(_batches(spark, sf_dir)), "wait_s", ["model"], WAIT_BUCKETS))


@register("response_records", _with(LOG_SQL, DYN_SQL) + """
SELECT l.request_id, l.model, round(l.duration_s * 1000, 3) AS processing_time_ms, b.batch_size,
       round((b.close_us - l.enqueue_us) / 1000.0 + l.duration_s * 1000, 3) AS total_time_ms
FROM log l JOIN j ON j.model = l.model AND j.request_id = l.request_id
JOIN batches b ON b.model = l.model AND j.rn >= b.s AND j.rn < b.e""")
def response_records(spark, sf_dir):
    """One response row per request: processing time, its batch size, total time."""
    log = request_log(spark, sf_dir)
    m = _batches(spark, sf_dir).select("request_id", "batch_size", "close_us")
    r = log.join(m, "request_id")
    return r.select("request_id", "model", F.round(F.col("duration_s") * 1000, 3).alias("processing_time_ms"),
                    "batch_size",
                    F.round((F.col("close_us") - F.col("enqueue_us")) / 1000.0 + F.col("duration_s") * 1000, 3)
                    .alias("total_time_ms"))


@register("response_status", _with(LOG_SQL, DEPTH_SQL) + """
SELECT l.model, CAST(CASE WHEN a.rejected THEN 429 WHEN l.error_type IS NOT NULL THEN 500 ELSE 200 END AS INTEGER) AS http_status,
       CAST(count(*) AS BIGINT) AS n, CAST(count(l.props) AS BIGINT) AS n_with_metadata
FROM log l JOIN adm a USING (model, request_id) GROUP BY ALL""")
def response_status(spark, sf_dir):
    """Answers of each model by status class: queue full (429), failed (500), answered (200)."""
    log = request_log(spark, sf_dir)
    r = log.join(admission(log, MAXSIZE).select("request_id", "rejected"), "request_id")
    status = http_status(queue_full="rejected", error_type="error_type")
    return r.groupBy("model", status.alias("http_status")).agg(F.count(F.lit(1)).alias("n"), F.count("props").alias("n_with_metadata"))


@register("gauge_last_value", _with(LOG_SQL) + """
SELECT model, CAST(arg_max(CAST(json_extract(props, '$.k') AS DOUBLE), enqueue_ts) AS DOUBLE) AS value
FROM log GROUP BY model""")
def gauge_last_value(spark, sf_dir):
    """Gauge semantics: last value set per label (props.k by time, then id)."""
    log = request_log(spark, sf_dir)
    return M.gauge_last(log, ["model"], F.get_json_object("props", "$.k").cast("double"),
                        ["enqueue_ts", "request_id"])


@register("queue_summary", _with(LOG_SQL, DEPTH_SQL) + f"""
SELECT l.model, CAST(count(*) AS BIGINT) AS total_requests,
       CAST(count(*) FILTER (WHERE a.rejected) AS BIGINT) AS rejections,
       CAST(count(*) FILTER (WHERE l.status = 'timeout') AS BIGINT) AS timeouts,
       CAST(count(*) FILTER (WHERE l.enqueue_us <= epoch_us(TIMESTAMP '{NOW}')
                              AND l.dequeue_us > epoch_us(TIMESTAMP '{NOW}')) AS BIGINT) AS depth,
       {MAXSIZE} AS maxsize,
       round(count(*) FILTER (WHERE l.enqueue_us <= epoch_us(TIMESTAMP '{NOW}')
                              AND l.dequeue_us > epoch_us(TIMESTAMP '{NOW}')) / {MAXSIZE}, 6) AS utilization
FROM log l JOIN adm a USING (model, request_id) GROUP BY l.model""")
def queue_summary(spark, sf_dir):
    """Per model: requests, over-capacity arrivals, timeouts, depth and utilization at NOW."""
    log = request_log(spark, sf_dir)
    adm = admission(log, MAXSIZE).select("request_id", "rejected")
    now_us = epoch_us(F.lit(NOW).cast("timestamp_ntz"))
    live = (F.col("enqueue_us") <= now_us) & (F.col("dequeue_us") > now_us)
    g = log.join(adm, "request_id").groupBy("model").agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if("rejected").alias("rejections"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"), F.count_if(live).alias("depth"))
    util = F.when(F.lit(MAXSIZE) > 0, F.col("depth") / F.lit(MAXSIZE)).otherwise(F.lit(0.0))
    return g.select("model", "total_requests", "rejections", "timeouts", "depth",
                    F.lit(MAXSIZE).alias("maxsize"), F.round(util, 6).alias("utilization"))


@register("queue_depth", _with(LOG_SQL, DEPTH_SQL) + f"""
SELECT model, request_id, CASE WHEN kind = 1 THEN 'enqueue' ELSE 'dequeue' END AS event, depth,
       round(depth / {MAXSIZE}, 6) AS utilization, depth = 0 AS is_empty, depth >= {MAXSIZE} AS is_full,
       depth > {MAXSIZE} AS over_capacity FROM depth""")
def queue_depth_q(spark, sf_dir):
    d = queue_depth(request_log(spark, sf_dir), MAXSIZE)
    return d.select("model", "request_id", "event", "depth", F.round("utilization", 6).alias("utilization"),
                    "is_empty", "is_full", "over_capacity")


@register("request_rate_latency", _with(LOG_SQL) + """
SELECT model, strftime(time_bucket(INTERVAL 1 DAY, enqueue_ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       CAST(count(*) AS BIGINT) AS n, round(count(*) / 86400.0, 9) AS rate_per_s,
       round(avg(duration_s), 6) AS avg_s, max(duration_s) AS max_s,
       round(quantile_cont(duration_s, 0.5), 6) AS p50_s, round(quantile_cont(duration_s, 0.95), 6) AS p95_s
FROM log GROUP BY ALL""")
def request_rate_latency(spark, sf_dir):
    """Per model and day: request rate, mean / max / exact p50 and p95 latency."""
    log = request_log(spark, sf_dir).withColumn(
        "window_start", F.window("enqueue_ts", "1 day").start.cast("string"))
    keys = ["model", "window_start"]
    base = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("duration_s").alias("avg_s"),
                                  F.max("duration_s").alias("max_s"))
    pct = exact_percentiles(log, keys, "duration_s", "request_id", {"p50_s": 0.5, "p95_s": 0.95})
    pct = pct.select(*[F.col(k).alias(f"_{k}") for k in keys], "p50_s", "p95_s")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = base.join(pct, same, "left")
    return out.select(*keys, "n", F.round(F.col("n") / 86400.0, 9).alias("rate_per_s"),
                      F.round("avg_s", 6).alias("avg_s"), "max_s",
                      F.round("p50_s", 6).alias("p50_s"), F.round("p95_s", 6).alias("p95_s"))


@register("error_ratio", _with(LOG_SQL) + """
SELECT model, error_type, round(n / total, 6) AS ratio FROM (
  SELECT model, error_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY model) AS total
  FROM log GROUP BY model, error_type) WHERE error_type IS NOT NULL""")
def error_ratio(spark, sf_dir):
    """Errors of each type over all requests of the model."""
    log = request_log(spark, sf_dir)
    total = log.groupBy("model").agg(F.count(F.lit(1)).alias("total"))
    errs = log.where(F.col("error_type").isNotNull()).groupBy("model", "error_type").agg(F.count(F.lit(1)).alias("n"))
    return errs.join(total, "model").select("model", "error_type",
                                            F.round(F.try_divide(F.col("n"), F.col("total")), 6).alias("ratio"))


@register("timeouts", _with(LOG_SQL) + f"""
SELECT request_id, model, duration_s FROM log WHERE duration_s > {TIMEOUT_S}""")
def timeouts_q(spark, sf_dir):
    return timeouts(request_log(spark, sf_dir), TIMEOUT_S).select("request_id", "model", "duration_s")


@register("rate_limit_fixed", _with(LOG_SQL) + f"""
SELECT client, strftime(time_bucket(INTERVAL 1 DAY, enqueue_ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       CAST(count(*) AS BIGINT) AS n, count(*) > {RATE_LIMIT} AS over_limit FROM log GROUP BY ALL""")
def rate_limit_fixed_q(spark, sf_dir):
    r = rate_limit_fixed(request_log(spark, sf_dir), RATE_LIMIT, "1 day")
    return r.select("client", F.col("window_start").cast("string").alias("window_start"), "n", "over_limit")


@register("rate_limit_sliding", _with(LOG_SQL) + f"""
SELECT client, request_id, n_in_window, n_in_window > {RATE_LIMIT} AS over_limit FROM (
  SELECT client, request_id, CAST(count(*) OVER (PARTITION BY client ORDER BY enqueue_ts
         RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n_in_window FROM log)""")
def rate_limit_sliding_q(spark, sf_dir):
    return rate_limit_sliding(request_log(spark, sf_dir), RATE_LIMIT, 86400.0).select(
        "client", "request_id", "n_in_window", "over_limit")


@register("request_age", _with(LOG_SQL) + f"""
SELECT request_id, sha256(concat_ws('|', CAST(request_id AS VARCHAR), model)) AS request_hash,
       round(enqueue_us / 1e6, 6) AS enqueue_epoch_s,
       round((epoch_us(TIMESTAMP '{NOW}') - enqueue_us) / 1000.0, 3) AS age_ms FROM log""")
def request_age(spark, sf_dir):
    r = request_identity(request_log(spark, sf_dir), NOW)
    return r.select("request_id", "request_hash", F.round("enqueue_epoch_s", 6).alias("enqueue_epoch_s"),
                    F.round("age_ms", 3).alias("age_ms"))


def _expo_sql():
    def head(m, kind):
        return f"SELECT '# HELP {m[0]} {m[1]}' AS line UNION ALL SELECT '# TYPE {m[0]} {kind}'"
    vals = ", ".join(f"('{b}', CAST('{b}' AS DOUBLE))" for b in M.DURATION_BUCKETS)
    name = M.REQUEST_DURATION[0]
    return _with(LOG_SQL) + f"""
{head(M.REQUESTS_TOTAL, 'counter')}
UNION ALL SELECT '{M.REQUESTS_TOTAL[0]}{{model="' || model || '",status="' || status || '"}} ' || CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) FROM log GROUP BY model, status
UNION ALL {head(M.ERRORS_TOTAL, 'counter')}
UNION ALL SELECT '{M.ERRORS_TOTAL[0]}{{model="' || model || '",error_type="' || error_type || '"}} ' || CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) FROM log WHERE error_type IS NOT NULL GROUP BY model, error_type
UNION ALL {head(M.REQUEST_DURATION, 'histogram')}
UNION ALL SELECT '{name}_bucket{{model="' || model || '",le="' || le || '"}} ' || CAST(CAST(count(*) FILTER (WHERE duration_s <= ub) AS DOUBLE) AS VARCHAR) FROM log CROSS JOIN (VALUES {vals}) AS b(le, ub) GROUP BY model, le
UNION ALL SELECT '{name}_bucket{{model="' || model || '",le="+Inf"}} ' || CAST(CAST(count(duration_s) AS DOUBLE) AS VARCHAR) FROM log GROUP BY model
UNION ALL SELECT '{name}_count{{model="' || model || '"}} ' || CAST(CAST(count(duration_s) AS DOUBLE) AS VARCHAR) FROM log GROUP BY model
UNION ALL SELECT '{name}_sum{{model="' || model || '"}} ' || CAST(round(sum(duration_s), 6) AS VARCHAR) FROM log GROUP BY model
UNION ALL {head(M.QUEUE_DEPTH, 'gauge')}
UNION ALL SELECT '{M.QUEUE_DEPTH[0]}{{model="' || model || '"}} ' || CAST(CAST(arg_max(CAST(json_extract(props, '$.k') AS DOUBLE), enqueue_ts) AS DOUBLE) AS VARCHAR) FROM log GROUP BY model
"""


@register("metrics_exposition", _expo_sql())
def metrics_exposition(spark, sf_dir):
    """Text exposition of counters, the duration histogram and the depth gauge
    (all four families from one pass over the log)."""
    log = request_log(spark, sf_dir)
    requests, errors, hist, gauge = M.request_families(
        log, "duration_s", F.get_json_object("props", "$.k"), ("enqueue_ts", "request_id"))
    return M.exposition([
        (M.REQUESTS_TOTAL, "counter", requests, ["model", "status"]),
        (M.ERRORS_TOTAL, "counter", errors, ["model", "error_type"]),
        (M.REQUEST_DURATION, "histogram", _rounded(hist), ["model"]),
        (M.QUEUE_DEPTH, "gauge", gauge, ["model"]),
    ])


def _expo_hist_sql(metric, src: str, col: str, buckets) -> str:
    vals, name = ", ".join(f"('{b}', CAST('{b}' AS DOUBLE))" for b in buckets), metric[0]
    text = lambda v: f"CAST(CAST({v} AS DOUBLE) AS VARCHAR)"
    return f"""
SELECT '# HELP {name} {metric[1]}' AS line UNION ALL SELECT '# TYPE {name} histogram'
UNION ALL SELECT '{name}_bucket{{model="' || model || '",le="' || le || '"}} ' || {text(f"count(*) FILTER (WHERE {col} <= ub)")}
  FROM {src} CROSS JOIN (VALUES {vals}) AS b(le, ub) GROUP BY model, le
UNION ALL SELECT '{name}_bucket{{model="' || model || '",le="+Inf"}} ' || {text(f"count({col})")} FROM {src} GROUP BY model
UNION ALL SELECT '{name}_count{{model="' || model || '"}} ' || {text(f"count({col})")} FROM {src} GROUP BY model
UNION ALL SELECT '{name}_sum{{model="' || model || '"}} ' || {text(f"round(sum({col}), 6)")} FROM {src} GROUP BY model"""


@register("metrics_exposition_queue", _with(LOG_SQL, DEPTH_SQL, DYN_SQL) + " SELECT * FROM (" + " UNION ALL ".join([
    _expo_hist_sql(M.BATCH_SIZE, "batches", "batch_size", M.BATCH_SIZE_BUCKETS),
    _expo_hist_sql(M.BATCH_WAIT, "(SELECT model, round((last_us - open_us) / 1e6, 6) AS wait_s FROM batches)", "wait_s", WAIT_BUCKETS),
    f"""
SELECT '# HELP {M.QUEUE_REJECTIONS[0]} {M.QUEUE_REJECTIONS[1]}' UNION ALL SELECT '# TYPE {M.QUEUE_REJECTIONS[0]} counter'
UNION ALL SELECT '{M.QUEUE_REJECTIONS[0]}{{model="' || model || '"}} ' || CAST(CAST(count(*) AS DOUBLE) AS VARCHAR)
  FROM adm WHERE rejected GROUP BY model"""]) + ")")
def metrics_exposition_queue(spark, sf_dir):
    """Batch size and wait histograms and the rejection counter, written as exposition text and read back."""
    batches = batch_summary(_batches(spark, sf_dir)).select("model", "batch_size", F.round("wait_s", 6).alias("wait_s"))
    rejected = admission(request_log(spark, sf_dir), MAXSIZE).where("rejected")
    lines = M.exposition([
        (M.BATCH_SIZE, "histogram", _rounded(M.histogram(batches, "batch_size", ["model"], M.BATCH_SIZE_BUCKETS)), ["model"]),
        (M.BATCH_WAIT, "histogram", _rounded(M.histogram(batches, "wait_s", ["model"], WAIT_BUCKETS)), ["model"]),
        (M.QUEUE_REJECTIONS, "counter", M.counter(rejected, ["model"]), ["model"]),
    ])
    return write_lines(lines, scratch_path(spark, "exposition"))


@register("log_records", _with(LOG_SQL) + f"""
SELECT '{{"timestamp":"' || strftime(enqueue_ts, '%Y-%m-%dT%H:%M:%S.%f') || '","level":"WARNING","logger":"tessera.requests",'
       || '"message":"request timed out","request_id":' || CAST(request_id AS VARCHAR)
       || ',"duration_ms":' || CAST(round(duration_s * 1000, 3) AS VARCHAR) || '}}' AS json,
       strftime(enqueue_ts, '%Y-%m-%d %H:%M:%S') || ' - tessera.requests - WARNING - request timed out' AS plain
FROM log WHERE duration_s > {TIMEOUT_S}""")
def log_records(spark, sf_dir):
    """Structured WARNING records for timed-out requests (JSON and plain form)."""
    t = timeouts(request_log(spark, sf_dir), TIMEOUT_S).withColumn(
        "duration_ms", F.round(F.col("duration_s") * 1000, 3))
    return M.log_records(t, "WARNING", "tessera.requests", "request timed out", "enqueue_ts",
                         ["request_id", "duration_ms"])
