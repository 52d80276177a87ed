"""Encoder protocol.

An encoder turns a batch of payload rows into one output per row. The batch
of a built-in encoder is a pandas DataFrame with the payload columns (``text``
and/or ``image_*``), that of a plug-in a list of items (see ``loader``);
``encode`` returns a sequence (or 2-d array) with exactly one entry per row.
``load``/``warmup`` run once per Python worker; ``batch_size``/``batch_wait_s``
describe how the encoder likes to be fed.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field
from typing import Any

# Model-record defaults and the service-wide default batch size.
DEFAULT_MODEL_BATCH_SIZE = 16
DEFAULT_MODEL_BATCH_WAIT_S = 0.003
DEFAULT_CONFIG_BATCH_SIZE = 16
REQUIRED_METHODS = ("load", "warmup", "batch_size", "batch_wait_s", "encode")


@dataclass
class ModelInfo:
    name: str
    version: str | None = None
    description: str | None = None
    batch_size: int = DEFAULT_MODEL_BATCH_SIZE
    batch_wait_s: float = DEFAULT_MODEL_BATCH_WAIT_S
    metadata: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return {"name": self.name, "version": self.version, "description": self.description,
                "batch_size": self.batch_size, "batch_wait_s": self.batch_wait_s,
                "metadata": dict(self.metadata)}


class Encoder:
    """Base class with the optional methods filled in."""

    name = "encoder"
    output_dim: int | None = None
    inputs: tuple[str, ...] = ("text",)

    def load(self) -> None:  # weights, tokenizers ...
        pass

    def warmup(self) -> None:
        pass

    def batch_size(self) -> int:
        return DEFAULT_MODEL_BATCH_SIZE

    def batch_wait_s(self) -> float:
        return DEFAULT_MODEL_BATCH_WAIT_S

    def encode(self, batch):  # pragma: no cover - abstract
        raise NotImplementedError


@dataclass(frozen=True)
class EncoderSpec:
    """Picklable recipe for building an encoder on an executor.

    ``target`` is ``"module:Class"`` (built with ``kwargs``); ``archive`` names a
    plug-in directory shipped by ``loader.register``; ``model_dir`` is a plug-in
    directory that every worker can open itself (a mounted store).
    """

    target: str | None = None
    kwargs: tuple = ()
    model_dir: str | None = None
    archive: str | None = None
    label: str | None = None

    @staticmethod
    def of(cls, **kwargs) -> "EncoderSpec":
        return EncoderSpec(target=f"{cls.__module__}:{cls.__qualname__}",
                           kwargs=tuple(sorted(kwargs.items())))

    def build(self):
        if self.archive is not None or self.model_dir is not None:
            from pyspark import SparkFiles

            from .loader import build
            return build(self.model_dir or SparkFiles.get(self.archive))
        mod, _, cls = self.target.partition(":")
        obj = getattr(importlib.import_module(mod), cls)
        return obj(**dict(self.kwargs))

    def describe(self) -> str:
        if self.label or self.model_dir:
            return self.label or self.model_dir
        args = ",".join(f"{k}={v}" for k, v in self.kwargs)
        return f"{self.target.rpartition(':')[2]}({args})"


def resolve_batch_size(explicit: int | None, encoder=None,
                       default: int = DEFAULT_CONFIG_BATCH_SIZE) -> int:
    """Explicit argument, else the encoder's own preference, else the default."""
    if explicit:
        return int(explicit)
    if encoder is not None:
        bs = getattr(encoder, "batch_size", None)
        val = bs() if callable(bs) else bs
        if val:
            return int(val)
    return int(default)
