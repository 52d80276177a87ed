"""Encoder plug-ins: directories with ``config.json`` and ``model.py``.

A directory may lie on any file system Spark reaches. ``register`` reads it
through the Hadoop file system, checks the record and the code on the driver,
and ships the directory to the executors as an archive, so workers need not see
the original path. The plug-in class is called ``ModelImpl``; it encodes a list of
``{"image": ..., "text": ...}`` items (the image an RGB uint8 array, either
missing if the job has no such column) into a list with one vector per item.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import os
import runpy
import tempfile
import zipfile

from .base import DEFAULT_MODEL_BATCH_SIZE, DEFAULT_MODEL_BATCH_WAIT_S, REQUIRED_METHODS, Encoder, EncoderSpec, ModelInfo

CONFIG, CODE, CLASS = "config.json", "model.py", "ModelImpl"
#: record field -> (type, default; ``...`` if it must be given)
RECORD = {"name": (str, ...), "version": (str, None), "description": (str, None), "batch_size": (int, DEFAULT_MODEL_BATCH_SIZE),
          "batch_wait_s": ((int, float), DEFAULT_MODEL_BATCH_WAIT_S), "metadata": (dict, {})}


class PluginError(ValueError):
    """A plug-in that cannot be used; ``part`` says whether the directory, its config, code or interface is at fault."""

    def __init__(self, part: str, where: str, what: str):
        super().__init__(f"{part} of plug-in {where}: {what}")
        self.part = part


def parse_record(text: str, where: str = "config") -> ModelInfo:
    """``config.json`` to a record; unknown fields are ignored, null means the default."""
    def refuse(what: str):
        raise PluginError("config", where, what)
    try:
        given = json.loads(text)
    except json.JSONDecodeError as bad:
        refuse(f"no JSON (line {bad.lineno}: {bad.msg})")
    if not isinstance(given, dict):
        refuse(f"an object is expected, this is a {type(given).__name__}")
    values = {}
    for field, (kind, default) in RECORD.items():
        value = given.get(field)
        if value is None:
            if default is ...:
                refuse(f"{field!r} is missing")
            value = dict(default) if isinstance(default, dict) else default
        elif not isinstance(value, kind) or isinstance(value, bool):
            refuse(f"{field!r} cannot be {value!r}")
        values[field] = value
    return ModelInfo(**values)


def plugin_class(code_path: str, strict: bool = False) -> type:
    """Runs ``model.py`` and returns its class, checked before anything is built."""
    try:
        names = runpy.run_path(code_path)
    except Exception as bad:  # whatever the plug-in's code raises
        raise PluginError("code", code_path, f"{type(bad).__name__}: {bad}") from bad
    found = names.get(CLASS)
    if not inspect.isclass(found):
        raise PluginError("code", code_path, f"it defines no class {CLASS}")
    lacking = [m for m in (REQUIRED_METHODS if strict else ("encode",)) if not callable(getattr(found, m, None))]
    if lacking:
        raise PluginError("interface", code_path, f"{CLASS} lacks {', '.join(lacking)}")
    return found


class Plugin(Encoder):
    """Feeds batches to a plug-in in its own form."""

    def __init__(self, model):
        self.model = model

    def load(self) -> None:
        getattr(self.model, "load", lambda: None)()

    def warmup(self) -> None:
        getattr(self.model, "warmup", lambda: None)()

    def batch_size(self) -> int:
        return getattr(self.model, "batch_size", super().batch_size)()

    def batch_wait_s(self) -> float:
        return getattr(self.model, "batch_wait_s", super().batch_wait_s)()

    def encode(self, batch):
        return self.model.encode(items(batch))


def items(batch) -> list[dict]:
    """Rows of a payload frame as ``{"text", "image"}`` dictionaries."""
    out = [{} for _ in range(len(batch))]
    if "text" in batch:
        for item, text in zip(out, batch["text"], strict=True):
            item["text"] = text
    if "image_data" in batch:
        from ..functions.images import rgb_array

        columns = (batch["image_data"], batch["image_height"], batch["image_width"], batch["image_channels"])
        for item, (data, *dims) in zip(out, zip(*columns, strict=True), strict=True):
            item["image"] = None if data is None else rgb_array(data, *map(int, dims))
    return out


def build(directory: str) -> Plugin:
    """The plug-in of a directory this process can open."""
    return Plugin(plugin_class(os.path.join(directory, CODE))())


# ---------------------------------------------------------------- shipping

def _files(spark, uri: str) -> dict[str, bytes]:
    """Files below ``uri`` by relative name, through the Hadoop file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(uri)
    fs = root.getFileSystem(conf)
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        raise PluginError("directory", uri, "there is no such directory")
    base, found, listing = fs.getFileStatus(root).getPath().toString().rstrip("/") + "/", {}, fs.listFiles(root, True)
    with tempfile.TemporaryDirectory(prefix="tessera-plugin-") as tmp:
        while listing.hasNext():
            path = listing.next().getPath()
            local = os.path.join(tmp, "file")
            fs.copyToLocalFile(False, path, jvm.org.apache.hadoop.fs.Path("file://" + local), True)
            with open(local, "rb") as f:
                found[path.toString().removeprefix(base)] = f.read()
    return found


def register(spark, uri: str, strict: bool = False) -> tuple[ModelInfo, EncoderSpec]:
    """Checks the plug-in at ``uri`` and sends its directory to the executors.

    Returns its record and a spec that builds it on any worker.
    """
    files = _files(spark, uri)
    for needed, part in ((CONFIG, "config"), (CODE, "code")):
        if needed not in files:
            raise PluginError(part, uri, f"{needed} is missing")
    info = parse_record(files[CONFIG].decode(), uri)
    home = tempfile.mkdtemp(prefix="tessera-plugin-")
    name = "plugin-" + hashlib.sha256(b"".join(k.encode() + b"\0" + files[k] for k in sorted(files))).hexdigest()[:16]
    with zipfile.ZipFile(os.path.join(home, name + ".zip"), "w", zipfile.ZIP_DEFLATED) as z:
        for relative, data in files.items():
            z.writestr(relative, data)
    with zipfile.ZipFile(z.filename) as packed:
        packed.extractall(os.path.join(home, "check"))
    plugin_class(os.path.join(home, "check", CODE), strict)
    spark.sparkContext.addArchive(f"{z.filename}#{name}")
    return info, EncoderSpec(archive=name, label=uri)
