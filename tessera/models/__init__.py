"""Encoder plug-ins: protocol, built-in stand-ins and the directory loader."""

from .base import Encoder, EncoderSpec, ModelInfo, resolve_batch_size
from .builtin import ConstantEncoder, HashTextEncoder, PixelGridEncoder, MultimodalClassifier
from .loader import Plugin, PluginError, parse_record, plugin_class, register

__all__ = [
    "Encoder", "EncoderSpec", "ModelInfo", "resolve_batch_size",
    "ConstantEncoder", "HashTextEncoder", "PixelGridEncoder", "MultimodalClassifier",
    "Plugin", "PluginError", "parse_record", "plugin_class", "register",
]
