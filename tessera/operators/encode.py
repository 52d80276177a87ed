"""Batched model application (the model-UDF surface).

``apply_encoder`` runs an encoder over a DataFrame through ``mapInArrow``. All
columns of the input pass through as the Arrow arrays they arrived in, so 64-bit
ids, nested values and nulls stay exactly as they were; only the payload of the
rows to encode is converted. Batches are cut to the model's batch size across
Arrow batches: only the last one of a partition may be short. The encoder is
built once per Python worker.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..models.base import EncoderSpec, resolve_batch_size

_ENCODERS: dict = {}

# Fixed value: error type recorded for members of a failed batch.
PROCESSING_ERROR = "processing_error"
IMAGE_FIELDS = ("image_data", "image_height", "image_width", "image_channels")


def get_encoder(spec: EncoderSpec, warmup: bool = True):
    enc = _ENCODERS.get(spec)
    if enc is None:
        enc = spec.build()
        if hasattr(enc, "load"):
            enc.load()
        if warmup and hasattr(enc, "warmup"):
            enc.warmup()
        _ENCODERS[spec] = enc
    return enc


def _encode(enc, payload: pd.DataFrame, on_error: str):
    """Encode one batch; returns (rows, error_type)."""
    try:
        out = [None if r is None else np.asarray(r, dtype=np.float64) for r in enc.encode(payload)]
        if len(out) != len(payload):  # positional pairing must be exact
            raise ValueError(f"encoder returned {len(out)} rows for a batch of {len(payload)}")
        return out, None
    except Exception:
        if on_error == "raise":
            raise
        return [None] * len(payload), PROCESSING_ERROR


def apply_encoder(df: DataFrame, spec: EncoderSpec, *, text_col: str | None = None,
                  image_cols: tuple[str, str, str, str] | None = None,
                  output_col: str = "embedding", batch_size: int | None = None,
                  on_error: str = "raise", batch_col: str | None = None,
                  batch_size_col: str | None = None, skip_col: str | None = None,
                  partitions: int | None = None, resources=None) -> DataFrame:
    """Append ``output_col`` (array<double>) computed by the encoder.

    ``on_error="raise"`` fails the task (Spark retries it; a job fails if the
    encoder keeps failing); ``"mark"`` fans a failed batch out as null
    outputs with ``error_type`` set for every member. With ``batch_col`` the
    batches are exactly the runs of equal values of that column (the frame
    must be clustered and sorted by it); otherwise a batch takes the next
    ``batch_size`` rows of the partition. Rows where ``skip_col`` is not null
    (e.g. a reject reason) pass through with a null output and never reach the
    model. Inputs that their files would give to few tasks are dealt out anew
    first (see ``spread_tasks``; ``partitions`` sets the number, 0 leaves them as
    they are); nothing runs before an action. ``resources`` is a Spark
    ``ResourceProfile`` (see ``encoder_resources``) for the encoder's stage alone,
    on clusters that schedule by stage.

    Arrow batches handed to the UDF are bounded by Spark's
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` and
    ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    if on_error not in ("raise", "mark"):
        raise ValueError("on_error must be 'raise' or 'mark'")
    if partitions and batch_col is not None:
        raise ValueError("partitions would break up the batches of batch_col")
    fields = list(df.schema.fields) + [T.StructField(output_col, T.ArrayType(T.DoubleType()), True)]
    if on_error == "mark":
        fields.append(T.StructField("error_type", T.StringType(), True))
    if batch_size_col:
        fields.append(T.StructField(batch_size_col, T.IntegerType(), True))
    payload_of = {**({"text": text_col} if text_col is not None else {}), **(dict(zip(IMAGE_FIELDS, image_cols, strict=True)) if image_cols is not None else {})}

    def emit(rows: pa.Table, bounds: list[tuple[int, int]], enc) -> pa.RecordBatch:
        """``bounds``: batches as ranges of the rows that are not skipped."""
        use = _used(rows, skip_col)
        chosen = rows if use.all() else rows.filter(pa.array(use))
        payload = pd.DataFrame({name: chosen.column(src).to_pandas() for name, src in payload_of.items()}, index=range(chosen.num_rows))
        where = np.flatnonzero(use)
        outputs, errors, sizes = [None] * rows.num_rows, [None] * rows.num_rows, np.zeros(rows.num_rows, np.int32)
        for a, b in bounds:
            out, err = _encode(enc, payload.iloc[a:b], on_error)
            for at, vector in zip(where[a:b], out, strict=True):
                outputs[at], errors[at], sizes[at] = vector, err, b - a
        columns = [c.combine_chunks() for c in rows.columns] + [pa.array(outputs, pa.list_(pa.float64()))]
        if on_error == "mark":
            columns.append(pa.array(errors, pa.string()))
        if batch_size_col:
            columns.append(pa.array(sizes))
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns],
                                          [f.name for f in fields])

    def run(batches):
        enc = get_encoder(spec)
        size = resolve_batch_size(batch_size, enc)
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            ready, bounds = _ready_by_key(rows, batch_col, skip_col) if batch_col is not None else _ready_by_size(rows, size, skip_col)
            if ready:
                yield emit(rows.slice(0, ready), bounds, enc)
            rest = rows.slice(ready)
        if rest is not None and rest.num_rows:
            used = int(_used(rest, skip_col).sum())
            if batch_col is not None:
                yield emit(rest, [(0, used)] if used else [], enc)      # one run of equal keys
            else:
                yield emit(rest, [(s, min(s + size, used)) for s in range(0, used, size)], enc)

    if partitions is None and batch_col is None:
        partitions = spread_tasks(df)
    if partitions:
        df = df.repartition(int(partitions))
    return df.mapInArrow(run, T.StructType(fields), profile=resources)


def encoder_resources(task_cpus: int = 1, task_gpus: float = 0.0, executor_cores: int | None = None, executor_memory: str | None = None,
                      executor_gpus: int = 0, gpu_script: str = ""):
    """A ``ResourceProfile`` for the encoder's stage: what a task takes, and, if given, the executors that run it.

    Without executor settings tasks take their share of the executors there are.
    """
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    tasks = TaskResourceRequests().cpus(task_cpus)
    if task_gpus:
        tasks = tasks.resource("gpu", task_gpus)
    builder = ResourceProfileBuilder().require(tasks)
    if executor_cores or executor_memory or executor_gpus:
        executors = ExecutorResourceRequests()
        if executor_cores:
            executors = executors.cores(executor_cores)
        if executor_memory:
            executors = executors.memory(executor_memory)
        if executor_gpus:
            executors = executors.resource("gpu", executor_gpus, discoveryScript=gpu_script)
        builder = builder.require(executors)
    return builder.build


#: bytes of input files whose rows an encoder task gets, and the most tasks that rows are dealt out to
TASK_BYTES = 1 << 20
MOST_SPREAD = 4096


def spread_tasks(df: DataFrame) -> int:
    """Tasks to deal the rows out to before an expensive encoder; 0 if the scan makes enough by itself.

    Decided by the size of the files read, known from their listing: a scan cuts
    files by bytes, but a row group never, so a few large files can end up in
    one task each. Beyond ``MOST_SPREAD`` scan tasks nothing is dealt out. The rows
    of a stream's micro-batch go to ``spark.sql.shuffle.partitions`` tasks.
    """
    spark = df.sparkSession
    if df.isStreaming:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(n for n in sizes if n < 1 << 60)            # other leaves do not say
    scan = -(-known // int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    wanted = min(-(-known // TASK_BYTES), MOST_SPREAD)
    return wanted if wanted > max(scan, 1) else 0


def _used(rows: pa.Table, skip_col: str | None) -> np.ndarray:
    if skip_col is None:
        return np.ones(rows.num_rows, bool)
    return rows.column(skip_col).is_null().to_numpy()


def _ready_by_size(rows: pa.Table, size: int, skip_col: str | None):
    """Leading rows that fill whole batches, and those batches."""
    where = np.flatnonzero(_used(rows, skip_col))
    full = len(where) // size
    return (int(where[full * size - 1]) + 1 if full else 0), [(k * size, (k + 1) * size) for k in range(full)]


def _ready_by_key(rows: pa.Table, batch_col: str, skip_col: str | None):
    """All runs of equal keys but the last, which may go on in the next Arrow batch."""
    codes = rows.column(batch_col).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.flatnonzero(codes[1:] != codes[:-1]) + 1]
    used = np.r_[0, np.cumsum(_used(rows, skip_col))][starts]
    return int(starts[-1]), [(int(a), int(b)) for a, b in zip(used[:-1], used[1:], strict=True) if b > a]


def measure_startup(spark, spec: EncoderSpec, workers: int = 1) -> DataFrame:
    """``(load_s, warmup_s)``: seconds that loading and warming up the encoder takes, once in each of ``workers`` tasks."""
    def run(batches):
        import time

        for batch in batches:
            for _ in range(batch.num_rows):
                enc, marks = spec.build(), [time.perf_counter()]
                for step in ("load", "warmup"):
                    getattr(enc, step, lambda: None)()
                    marks.append(time.perf_counter())
                yield pa.RecordBatch.from_arrays([pa.array([marks[1] - marks[0]]), pa.array([marks[2] - marks[1]])], ["load_s", "warmup_s"])

    return spark.range(0, workers, 1, workers).mapInArrow(run, "load_s double, warmup_s double")
