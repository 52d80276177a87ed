"""Reason-coded request validation and URL payload joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.images import DEFAULT_MAX_MB, MIB, decoded_size_mb

# Reject reasons in rule order, and HTTP-style status classes.
REASONS = ("invalid_content_type", "file_too_large", "empty_image", "undecodable_image",
           "invalid_dimensions", "image_too_large")
STATUS_OK, STATUS_BAD_REQUEST, STATUS_QUEUE_FULL, STATUS_INTERNAL = 200, 400, 429, 500


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def reject_reason(content_type, n_bytes, decoded_ok, width, height, channels,
                  max_upload_mb: float = DEFAULT_MAX_MB, max_decoded_mb: float = DEFAULT_MAX_MB) -> F.Column:
    """First failing rule wins: content type, raw size, empty, undecodable,
    dimensions, decoded size. Null when the request is valid."""
    ct = _c(content_type)
    return (F.when(ct.isNull() | ~ct.startswith("image/"), REASONS[0])
            .when(_c(n_bytes).cast("double") / F.lit(MIB) > F.lit(float(max_upload_mb)), REASONS[1])
            .when(_c(n_bytes) == 0, REASONS[2])
            .when(~F.coalesce(_c(decoded_ok), F.lit(False)), REASONS[3])
            .when((_c(width) <= 0) | (_c(height) <= 0), REASONS[4])
            .when(decoded_size_mb(width, height, channels) > F.lit(float(max_decoded_mb)), REASONS[5]))


def validate(df: DataFrame, **cols) -> DataFrame:
    """Add ``reject_reason`` and ``http_status`` (200 accepted, 400 rejected)."""
    limits = {k: cols.pop(k) for k in ("max_upload_mb", "max_decoded_mb") if k in cols}
    reason = reject_reason(**cols, **limits)
    return df.withColumn("reject_reason", reason).withColumn("http_status", http_status("reject_reason"))


def http_status(reject_reason=None, queue_full=None, error_type=None) -> F.Column:
    """Answer class of a request: 429 if the queue was full, 400 if it was refused, 500 if it failed, else 200.

    Arguments are columns or names; leave out what a log does not have.
    """
    status = F.when(F.lit(False), STATUS_OK)
    if queue_full is not None:
        status = status.when(_c(queue_full), STATUS_QUEUE_FULL)
    if reject_reason is not None:
        status = status.when(_c(reject_reason).isNotNull(), STATUS_BAD_REQUEST)
    if error_type is not None:
        status = status.when(_c(error_type).isNotNull(), STATUS_INTERNAL)
    return status.otherwise(STATUS_OK)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); together they are the input (no row lost)."""
    return (validated.where(F.col("reject_reason").isNull()),
            validated.where(F.col("reject_reason").isNotNull()))


#: samples of one URL above which the URL is salted
HOT_ROWS = 100_000


def lookup_payloads(samples: DataFrame, payloads: DataFrame, url_col: str = "url",
                    payload_url_col: str = "url", hot_threshold: int | None = HOT_ROWS) -> DataFrame:
    """Left join of samples to their payload rows by URL; ``_purl`` is null when
    a sample's URL has no payload.

    URLs are matched as given (normalise ``file:`` URIs of both sides first,
    see ``functions.urls.normalize_file_uri``). A URL shared by more than
    ``hot_threshold`` samples is salted: its samples are spread over
    ``ceil(count / hot_threshold)`` salts and only its payload row is replicated
    that many times (``None``: no salting). The table of hot URLs has at most
    ``rows / hot_threshold`` entries; Spark sends it to the tasks if it is small.
    """
    p = payloads.withColumnRenamed(payload_url_col, "_purl")
    if not hot_threshold:
        return samples.join(p, samples[url_col] == p["_purl"], "left")
    T = int(hot_threshold)
    hot = (samples.groupBy(F.col(url_col).alias("_hurl")).agg(F.count(F.lit(1)).alias("_n"))
                  .where(F.col("_n") > T)
                  .select("_hurl", F.ceil(F.col("_n") / F.lit(T)).cast("int").alias("_salts")))
    s = (samples.join(hot, samples[url_col] == F.col("_hurl"), "left")
                .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
                    F.pmod(F.xxhash64(*[F.col(c) for c in samples.columns]), F.col("_salts")).cast("int")))
                .drop("_hurl", "_salts"))
    ps = (p.join(hot, p["_purl"] == F.col("_hurl"), "left")
           .withColumn("_psalt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
           .drop("_hurl", "_salts"))
    cond = (s[url_col] == ps["_purl"]) & (s["_salt"] == ps["_psalt"])
    return s.join(ps, cond, "left").drop("_salt", "_psalt")


def resolve_payloads(samples: DataFrame, payloads: DataFrame, url_col: str = "url",
                     payload_url_col: str = "url", hot_threshold: int | None = HOT_ROWS,
                     ) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) from one left join (see :func:`lookup_payloads`);
    unresolved rows carry ``reject_reason = 'unresolved_url'``."""
    j = lookup_payloads(samples, payloads, url_col, payload_url_col, hot_threshold)
    resolved = j.where(F.col("_purl").isNotNull()).drop("_purl")
    unresolved = (j.where(F.col("_purl").isNull()).select(*samples.columns)
                   .withColumn("reject_reason", F.lit("unresolved_url")))
    return resolved, unresolved
