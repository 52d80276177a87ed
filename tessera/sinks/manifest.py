"""Result table with a manifest made of the tasks' commit messages (a Python data source).

Each task attempt writes one Parquet file of a name of its own and tells the driver
its rows, bytes and range of keys. Spark commits the messages of exactly one
attempt a task; they become the manifest, which is what readers go by. Files of
failed, repeated or speculative attempts are in no manifest and so in no table; a
write that is aborted leaves the last manifest as it was.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "tessera_manifest"
MANIFEST = "manifest.json"


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.split(":", 1)[-1].lstrip("/")
    return fs.FileSystem.from_uri("s3://" + path[6:] if path.startswith("s3a://") else path)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote; ``low`` and ``high`` are the least and greatest key, as text."""

    file: str | None
    rows: int
    bytes: int
    low: str | None
    high: str | None


class ManifestWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str | None, append: bool):
        self.path, self.key, self.append = path.rstrip("/"), key, append

    def write(self, iterator) -> Written:
        filesystem, base = _filesystem(self.path)
        name = f"data/{uuid.uuid4().hex}.parquet"
        writer, rows, low, high = None, 0, None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    filesystem.create_dir(f"{base}/data", recursive=True)
                    out = filesystem.open_output_stream(f"{base}/{name}")
                    writer = pq.ParquetWriter(out, batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
                if self.key is not None:
                    span = pc.min_max(batch.column(batch.schema.get_field_index(self.key)).cast(pa.string())).as_py()
                    low = span["min"] if low is None else min(low, span["min"] or low)
                    high = span["max"] if high is None else max(high, span["max"] or high)
        finally:
            if writer is not None:
                writer.close()
                out.close()
        size = filesystem.get_file_info(f"{base}/{name}").size if writer is not None else 0
        return Written(name if writer is not None else None, rows, size, low, high)

    def commit(self, messages) -> None:
        filesystem, base = _filesystem(self.path)
        tasks = [asdict(m) for m in messages if m is not None and m.rows]
        old = read_manifest(self.path)["tasks"] if self.append else []
        tasks = old + sorted(tasks, key=lambda t: (t["low"] or "", t["file"]))
        keys = [t for t in tasks if t["low"] is not None]
        manifest = {"rows": sum(t["rows"] for t in tasks), "bytes": sum(t["bytes"] for t in tasks), "files": len(tasks),
                    "low": min((t["low"] for t in keys), default=None), "high": max((t["high"] for t in keys), default=None), "tasks": tasks}
        filesystem.create_dir(base, recursive=True)
        # written aside and moved: readers see the old manifest or the new one
        aside = f"{base}/{MANIFEST}.{uuid.uuid4().hex}"
        with filesystem.open_output_stream(aside) as f:
            f.write(json.dumps(manifest).encode())
        filesystem.move(aside, f"{base}/{MANIFEST}")

    def abort(self, messages) -> None:
        filesystem, base = _filesystem(self.path)
        for m in messages:
            if m is not None and m.file is not None:
                filesystem.delete_file(f"{base}/{m.file}")


class ManifestSink(DataSource):
    """Options: ``path``, and ``key``, the column whose range the manifest tells."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options["path"], self.options.get("key"), not overwrite)


def read_manifest(path: str) -> dict:
    """The last committed manifest; one without tasks if there is none."""
    filesystem, base = _filesystem(path.rstrip("/"))
    info = filesystem.get_file_info(f"{base}/{MANIFEST}")
    if not info.is_file:
        return {"rows": 0, "bytes": 0, "files": 0, "low": None, "high": None, "tasks": []}
    with filesystem.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def write_with_manifest(df: DataFrame, path: str, key: str | None = None, append: bool = False) -> dict:
    """Writes ``df`` below ``path`` and returns the manifest."""
    df.sparkSession.dataSource.register(ManifestSink)
    writer = df.write.format(NAME).option("path", path).mode("append" if append else "overwrite")
    (writer.option("key", key) if key is not None else writer).save()
    return read_manifest(path)


def read_with_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the files that the manifest names."""
    files = [f"{path.rstrip('/')}/{t['file']}" for t in read_manifest(path)["tasks"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
