"""Stand-in encoders that need no weights.

Real networks are user plug-ins (see ``loader``); these keep the pipeline
testable and deterministic (an executor retry reproduces the same output).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

from .base import Encoder

# The test-mock embedding, the token pattern of the hashing
# encoder and the linear-head weight rule W[k, j] = ((31k + 17j) mod 101 - 50) / 50.
CONSTANT_EMBEDDING = (0.1, 0.2, 0.3)
TOKEN_SPLIT = re.compile(r"[^A-Za-z0-9]+")


def head_weights(n_classes: int, n_features: int) -> np.ndarray:
    k = np.arange(n_classes)[:, None]
    j = np.arange(n_features)[None, :]
    return (((31 * k + 17 * j) % 101) - 50) / 50.0


def _l2(mat: np.ndarray) -> np.ndarray:
    norm = np.sqrt((mat * mat).sum(axis=1, keepdims=True))
    out = np.zeros_like(mat)
    np.divide(mat, norm, out=out, where=norm > 0)
    return out


class ConstantEncoder(Encoder):
    name = "constant"
    output_dim = 3
    inputs = ()

    def encode(self, batch):
        return np.tile(np.asarray(CONSTANT_EMBEDDING, dtype=np.float64), (len(batch), 1))


class HashTextEncoder(Encoder):
    """Bag of hashed tokens, L2-normalised.

    Tokens are the maximal runs of ASCII letters and digits, lower-cased;
    a token lands in bucket ``int(md5(token)[:8], 16) % dim``.
    """

    name = "hash-text"
    inputs = ("text",)

    def __init__(self, dim: int = 64, fail_on: str | None = None):
        self.output_dim = int(dim)
        self.fail_on = fail_on
        self._bucket: dict[str, int] = {}

    def batch_size(self) -> int:
        return 64

    def _buckets(self, tokens: list[str]) -> np.ndarray:
        cache, dim = self._bucket, self.output_dim
        if len(cache) > 2_000_000:
            cache.clear()
        out = np.empty(len(tokens), dtype=np.int64)
        for i, t in enumerate(tokens):
            b = cache.get(t)
            if b is None:
                b = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim
                cache[t] = b
            out[i] = b
        return out

    def token_counts(self, texts) -> np.ndarray:
        n, dim = len(texts), self.output_dim
        row_ids, toks = [], []
        for i, txt in enumerate(texts):
            if txt is None:
                continue
            if self.fail_on is not None and self.fail_on in txt:
                raise ValueError(f"encoder refused input containing {self.fail_on!r}")
            parts = [p.lower() for p in TOKEN_SPLIT.split(txt) if p]
            toks.extend(parts)
            row_ids.extend([i] * len(parts))
        counts = np.zeros(n * dim, dtype=np.float64)
        if toks:
            flat = np.asarray(row_ids, dtype=np.int64) * dim + self._buckets(toks)
            counts += np.bincount(flat, minlength=n * dim)
        return counts.reshape(n, dim)

    def encode(self, batch):
        return _l2(self.token_counts(batch["text"].tolist()))


def rasters_to_gray(batch) -> list[np.ndarray]:
    """Spark image rows (BGR/BGRA/gray, row-major) -> float gray planes."""
    out = []
    for data, h, w, c in zip(batch["image_data"], batch["image_height"],
                             batch["image_width"], batch["image_channels"]):
        arr = np.frombuffer(data, dtype=np.uint8).reshape(int(h), int(w), int(c)).astype(np.float64)
        if c >= 3:
            arr = arr[:, :, :3]
        out.append(arr.mean(axis=2))
    return out


class PixelGridEncoder(Encoder):
    """Mean intensity on a ``grid x grid`` partition of the image, L2-normalised."""

    name = "pixel-grid"
    inputs = ("image",)

    def __init__(self, grid: int = 4):
        self.grid = int(grid)
        self.output_dim = self.grid * self.grid

    def features(self, batch) -> np.ndarray:
        g = self.grid
        feats = np.zeros((len(batch), g * g))
        for i, plane in enumerate(rasters_to_gray(batch)):
            h, w = plane.shape
            cy = (np.arange(h) * g) // h
            cx = (np.arange(w) * g) // w
            cell = (cy[:, None] * g + cx[None, :]).ravel()
            sums = np.bincount(cell, weights=plane.ravel() / 255.0, minlength=g * g)
            cnt = np.bincount(cell, minlength=g * g)
            feats[i] = np.divide(sums, cnt, out=np.zeros(g * g), where=cnt > 0)
        return feats

    def encode(self, batch):
        return _l2(self.features(batch))


class MultimodalClassifier(Encoder):
    """Text + image features -> fixed linear head -> ``n_classes`` logits."""

    name = "multimodal-classifier"
    inputs = ("text", "image")

    def __init__(self, n_classes: int = 10, text_dim: int = 16, grid: int = 4):
        self.text = HashTextEncoder(dim=text_dim)
        self.image = PixelGridEncoder(grid=grid)
        self.n_classes = int(n_classes)
        self.output_dim = self.n_classes
        self.weights = head_weights(self.n_classes, text_dim + grid * grid)

    def batch_size(self) -> int:
        return 8

    def encode(self, batch):
        texts = batch["text"].fillna("")
        feats = np.hstack([self.text.encode({"text": texts}), self.image.encode(batch)])
        return feats @ self.weights.T
