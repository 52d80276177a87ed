"""URL helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The object-store scheme of input URLs and its Hadoop connector scheme.
S3_SCHEME = "s3://"
S3A_SCHEME = "s3a://"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def scheme(url) -> Column:
    return F.try_parse_url(_c(url), F.lit("PROTOCOL"))


def host(url) -> Column:
    """Bucket of an object-store URL (the authority part); null if unparsable."""
    return F.try_parse_url(_c(url), F.lit("HOST"))


def object_key(url) -> Column:
    """Path without its leading ``/``."""
    return F.ltrim(F.try_parse_url(_c(url), F.lit("PATH")), F.lit("/"))


def is_s3(url) -> Column:
    return _c(url).startswith(S3_SCHEME)


def to_hadoop_uri(url) -> Column:
    """``s3://`` -> ``s3a://`` so Hadoop's S3A connector reads it; others unchanged."""
    u = _c(url)
    return F.when(is_s3(u), F.concat(F.lit(S3A_SCHEME), F.substring(u, len(S3_SCHEME) + 1, 1 << 30))).otherwise(u)


def join_path(prefix, filename) -> Column:
    """``f"{prefix}/{filename}".lstrip("/")``."""
    return F.ltrim(F.concat(_c(prefix), F.lit("/"), _c(filename)), F.lit("/"))


def normalize_file_uri(path) -> Column:
    """``file:/x`` and ``file:///x`` -> ``/x``; other URIs unchanged."""
    p = _c(path)
    return F.regexp_replace(p, r"^file:(//)?", "")
