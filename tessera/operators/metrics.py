"""Labelled counters, gauges and cumulative histograms as aggregations,
plus their text exposition and structured log records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric names, help texts and bucket upper bounds (seconds,
# batch sizes) of the service's metric registry.
REQUESTS_TOTAL = ("inference_requests_total", "Total number of inference requests")
REQUEST_DURATION = ("inference_request_duration_seconds", "Request processing duration in seconds")
BATCH_SIZE = ("inference_batch_size", "Batch size distribution")
BATCH_WAIT = ("inference_batch_wait_seconds", "Time waiting to form batch")
QUEUE_DEPTH = ("inference_queue_depth", "Current queue depth")
QUEUE_REJECTIONS = ("inference_queue_rejections_total", "Total number of rejected requests due to full queue")
MODEL_LOAD = ("inference_model_load_seconds", "Time taken to load model")
MODEL_WARMUP = ("inference_model_warmup_seconds", "Time taken to warmup model")
ERRORS_TOTAL = ("inference_errors_total", "Total number of errors")

DURATION_BUCKETS = ("0.001", "0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "10.0")
BATCH_SIZE_BUCKETS = ("1.0", "2.0", "4.0", "8.0", "16.0", "32.0", "64.0", "128.0")
BATCH_WAIT_BUCKETS = ("0.001", "0.002", "0.005", "0.01", "0.02", "0.05", "0.1", "0.2", "0.5")
INF = "+Inf"


def counter(df: DataFrame, labels: list[str]) -> DataFrame:
    """``labels…, value``: number of rows per label set."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).cast("double").alias("value"))


def histogram(df: DataFrame, value_col: str, labels: list, buckets=DURATION_BUCKETS) -> DataFrame:
    """Cumulative-bucket histogram: one row per (labels, sample, le).

    ``sample`` is ``bucket`` (``le`` = upper bound or ``+Inf``), ``sum`` or
    ``count``. One aggregation pass computes every bucket; ``stack`` turns
    the columns into rows afterwards (no explode of the input).
    """
    wide = df.groupBy(*labels).agg(*histogram_aggs(value_col, buckets))
    return stack_histogram(wide, list(labels), buckets)


def stack_histogram(wide: DataFrame, keep: list[str], buckets) -> DataFrame:
    """Bucket columns ``b0..bk, n, s`` -> rows ``(sample, le, value)`` (also after a
    streaming aggregation: ``stack`` is a stateless projection)."""
    parts = [f"'bucket', '{b}', b{i}" for i, b in enumerate(buckets)]
    parts += [f"'bucket', '{INF}', n", "'count', CAST(NULL AS STRING), n", "'sum', CAST(NULL AS STRING), s"]
    stacked = f"stack({len(parts)}, {', '.join(parts)}) AS (sample, le, value)"
    return wide.select(*keep, F.expr(stacked))


def histogram_aggs(value_col: str, buckets=DURATION_BUCKETS) -> list:
    v = F.col(value_col).cast("double")
    aggs = [F.count_if(v <= F.lit(float(b))).cast("double").alias(f"b{i}") for i, b in enumerate(buckets)]
    return aggs + [F.count(v).cast("double").alias("n"), F.sum(v).alias("s")]


def gauge_last(df: DataFrame, labels: list[str], value, order: list[str]) -> DataFrame:
    """Gauge = the last value written per label set (by ``order``)."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*labels).agg(F.max_by(v, F.struct(*order)).cast("double").alias("value"))


def _num(c) -> F.Column:
    """Value text as the exposition prints floats (``3.0``, ``0.25``)."""
    return F.col(c).cast("double").cast("string")


def _escaped(c) -> F.Column:
    """A label value as the text format wants it; null is the empty label."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _labels(pairs) -> F.Column:
    parts = []
    for i, (k, col) in enumerate(pairs):
        parts += [F.lit(("," if i else "") + f'{k}="'), _escaped(col), F.lit('"')]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def exposition(series: list[tuple[tuple[str, str], str, DataFrame, list[str]]]) -> DataFrame:
    """Text exposition lines for several metric families.

    ``series`` items: ``((name, help), type, frame, label columns)`` where a
    counter/gauge frame has ``value`` and a histogram frame has
    ``sample, le, value`` as produced by :func:`histogram`.
    """
    spark = series[0][2].sparkSession
    out = None
    for (name, help_), kind, frame, labels in series:
        head = spark.createDataFrame([(f"# HELP {name} {help_}",), (f"# TYPE {name} {kind}",)], "line string")
        if kind == "histogram":
            lab = [(k, F.col(k)) for k in labels]
            line = (F.when(F.col("sample") == "bucket",
                           F.concat(F.lit(f"{name}_bucket"), _labels(lab + [("le", F.col("le"))]), F.lit(" "), _num("value")))
                    .when(F.col("sample") == "sum", F.concat(F.lit(f"{name}_sum"), _labels(lab), F.lit(" "), _num("value")))
                    .otherwise(F.concat(F.lit(f"{name}_count"), _labels(lab), F.lit(" "), _num("value"))))
        else:
            line = F.concat(F.lit(name), _labels([(k, F.col(k)) for k in labels]), F.lit(" "), _num("value"))
        part = head.unionByName(frame.select(line.alias("line")))
        out = part if out is None else out.unionByName(part)
    return out


def request_families(log: DataFrame, value_col: str = "duration_s", gauge_value=None,
                     gauge_order: tuple = ("enqueue_ts", "request_id"), buckets=DURATION_BUCKETS):
    """Counters, duration histogram and last-value gauge from ONE pass over a log.

    The log is aggregated once at the finest label set (model, status,
    error_type); every family is then a re-aggregation of that small table
    (bucket counts and sums add up, and the gauge's last value is the max of
    the per-group maxima of ``struct(order, value)``).
    """
    v = F.col(value_col).cast("double")
    gv = F.col(gauge_value) if isinstance(gauge_value, str) else gauge_value
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count(v).alias("_n"), F.sum(v).alias("_s")]
    aggs += [F.count_if(v <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(buckets)]
    if gv is not None:
        aggs.append(F.max(F.struct(*[F.col(c) for c in gauge_order], gv.cast("double").alias("v"))).alias("_last"))
    # Each family prunes different columns, which would stop Spark from reusing
    # one aggregation across the branches; the fine table is tiny (labels
    # only), so it is checkpointed once and every family reads it.
    fine = log.groupBy("model", "status", "error_type").agg(*aggs).checkpoint()
    requests = fine.groupBy("model", "status").agg(F.sum("_rows").cast("double").alias("value"))
    errors = (fine.where(F.col("error_type").isNotNull()).groupBy("model", "error_type")
                  .agg(F.sum("_rows").cast("double").alias("value")))
    wide = fine.groupBy("model").agg(
        *[F.sum(f"_b{i}").cast("double").alias(f"b{i}") for i in range(len(buckets))],
        F.sum("_n").cast("double").alias("n"), F.sum("_s").alias("s"))
    hist = stack_histogram(wide, ["model"], buckets)
    gauge = None
    if gv is not None:
        gauge = fine.groupBy("model").agg(F.max("_last").alias("_l")).select("model", F.col("_l.v").alias("value"))
    return requests, errors, hist, gauge


def log_records(df: DataFrame, level: str, logger: str, message, ts_col: str,
                extra: list[str]) -> DataFrame:
    """Structured log lines: JSON (absent optional fields omitted) and plain text."""
    ts = F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    msg = F.lit(message) if isinstance(message, str) else message
    rec = F.struct(ts.alias("timestamp"), F.lit(level).alias("level"), F.lit(logger).alias("logger"),
                   msg.alias("message"), *[F.col(c) for c in extra])
    plain = F.concat_ws(" - ", F.date_format(F.col(ts_col), "yyyy-MM-dd HH:mm:ss"), F.lit(logger), F.lit(level), msg)
    return df.select(F.to_json(rec).alias("json"), plain.alias("plain"))
