"""Image expressions on Spark's image struct fields and raw bytes.

Spark's image source stores pixels row-major as BGR / BGRA / gray bytes
with ``nChannels`` 1, 3 or 4. Geometry, mode and format checks are SQL
expressions; pixel work (RGB conversion, Lanczos resize) is numpy inside
Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIB = 1048576.0
# Default size limit (MB), default resize bounds, channel-count
# to mode names, and the magic numbers of the encodings the tests use.
DEFAULT_MAX_MB = 10.0
DEFAULT_MAX_SIDE = 1024
MODES = {1: "L", 3: "RGB", 4: "RGBA"}
MAGIC = (("PNG", "89504E47"), ("JPEG", "FFD8FF"), ("BMP", "424D"))


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def decoded_size_mb(width, height, channels) -> Column:
    """``width * height * channels / 2^20`` (bigint product: no int overflow)."""
    return (_c(width).cast("long") * _c(height).cast("long") * _c(channels).cast("long")) / F.lit(MIB)


def within_decoded_limit(width, height, channels, max_mb: float = DEFAULT_MAX_MB) -> Column:
    """Strict ``>`` rejects: a size equal to the limit passes."""
    return ~(decoded_size_mb(width, height, channels) > F.lit(float(max_mb)))


def raw_size_mb(content_or_length) -> Column:
    c = _c(content_or_length)
    return c.cast("double") / F.lit(MIB)


def mode_name(channels) -> Column:
    expr = None
    for n, name in MODES.items():
        expr = (F.when(_c(channels) == n, name) if expr is None else expr.when(_c(channels) == n, name))
    return expr


def format_name(content) -> Column:
    """Encoding from the first bytes (PNG / JPEG / BMP), else null."""
    h = F.hex(F.substring(_c(content), 1, 4))
    expr = None
    for name, magic in MAGIC:
        expr = F.when(h.startswith(magic), name) if expr is None else expr.when(h.startswith(magic), name)
    return expr


def resize_dims(width, height, max_w: int = DEFAULT_MAX_SIDE, max_h: int = DEFAULT_MAX_SIDE):
    """Fit inside ``max_w x max_h`` keeping the aspect ratio; unchanged if it fits.

    ``ratio = min(max_w / w, max_h / h)``; new sides are truncated to ints
    (never below 1).
    """
    w, h = _c(width).cast("double"), _c(height).cast("double")
    fits = (_c(width) <= max_w) & (_c(height) <= max_h)
    ratio = F.least(F.lit(float(max_w)) / w, F.lit(float(max_h)) / h)
    nw = F.when(fits, _c(width)).otherwise(F.greatest(F.lit(1), (w * ratio).cast("int")))
    nh = F.when(fits, _c(height)).otherwise(F.greatest(F.lit(1), (h * ratio).cast("int")))
    return nw.cast("int"), nh.cast("int")


# ---------------------------------------------------------------- pixels
def _plane(data, h, w, c) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(int(h), int(w), int(c))


def rgb_array(data, h, w, c) -> np.ndarray:
    """Stored BGR(A)/gray bytes -> (h, w, 3) RGB uint8."""
    px = _plane(data, h, w, c)
    if c == 1:
        return np.repeat(px, 3, axis=2)
    return px[:, :, 2::-1] if c >= 3 else px


@F.pandas_udf(T.BinaryType())
def to_rgb_bytes(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    """RGB bytes: gray replicated, BGR reversed, alpha dropped."""
    return pd.Series([None if d is None else rgb_array(d, h, w, c).tobytes()
                      for d, h, w, c in zip(data, height, width, channels)])


def _lanczos_matrix(n_in: int, n_out: int, a: int = 3) -> np.ndarray:
    """Resampling weights (n_out x n_in) of a Lanczos-a filter, support scaled when shrinking."""
    scale = n_in / n_out
    support = a * max(scale, 1.0)
    out = np.zeros((n_out, n_in))
    for i in range(n_out):
        center = (i + 0.5) * scale
        lo, hi = int(np.floor(center - support)), int(np.ceil(center + support))
        xs = np.arange(max(lo, 0), min(hi, n_in))
        t = (xs + 0.5 - center) / max(scale, 1.0)
        wts = np.sinc(t) * np.sinc(t / a)
        wts[np.abs(t) >= a] = 0.0
        s = wts.sum()
        out[i, xs] = wts / s if s != 0 else 0.0
    return out


def lanczos_resize(px: np.ndarray, new_h: int, new_w: int) -> np.ndarray:
    """Separable Lanczos-3 resize of an (h, w, c) uint8 array."""
    h, w, c = px.shape
    if (new_h, new_w) == (h, w):
        return px
    rows, cols = _lanczos_matrix(h, new_h), _lanczos_matrix(w, new_w)
    f = px.astype(np.float64)
    tmp = np.einsum("ij,jkc->ikc", rows, f)
    res = np.einsum("kl,ilc->ikc", cols, tmp)
    return np.clip(np.rint(res), 0, 255).astype(np.uint8)


RESIZED = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
                        T.StructField("nChannels", T.IntegerType()), T.StructField("data", T.BinaryType())])


def resize_pixels(max_w: int = DEFAULT_MAX_SIDE, max_h: int = DEFAULT_MAX_SIDE):
    """pandas UDF (data, height, width, channels) -> resized image struct."""
    @F.pandas_udf(RESIZED)
    def fn(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
        out = {"height": [], "width": [], "nChannels": [], "data": []}
        for d, h, w, c in zip(data, height, width, channels):
            h, w, c = int(h), int(w), int(c)
            if w <= max_w and h <= max_h:
                nw, nh = w, h
            else:
                r = min(max_w / w, max_h / h)
                nw, nh = max(1, int(w * r)), max(1, int(h * r))
            px = lanczos_resize(_plane(d, h, w, c), nh, nw)
            out["height"].append(nh)
            out["width"].append(nw)
            out["nChannels"].append(c)
            out["data"].append(px.tobytes())
        return pd.DataFrame(out)
    return fn
