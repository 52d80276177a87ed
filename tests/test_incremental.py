"""Incremental embedding: only new shards reach the encoder, no row twice, whatever is cut off."""

import shutil

import pytest
from pyspark.sql import functions as F

from tessera.models.base import EncoderSpec
from tessera.models.builtin import HashTextEncoder
from tessera.plans import incremental as I

SPEC = EncoderSpec.of(HashTextEncoder, dim=4)


def shard(spark, root, name, rows, extra=None):
    df = spark.createDataFrame(rows, "url string, caption string, key string")
    (df if extra is None else df.withColumn(extra, F.lit(1))).coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")


def rows_of(spark, out):
    return sorted((r.key, r.caption) for r in I.read_embeddings(spark, out).collect())


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out")


def test_only_new_and_changed_shards_are_read(spark, place):
    src, out = place
    for i in range(4):
        shard(spark, src, f"s{i}", [("u", f"text {i} {j}", f"k{i}{j}") for j in range(3)], extra="more" if i == 2 else None)
    first = I.embed_incrementally(spark, src, out, SPEC, batch_shards=3)
    assert (len(first.batches), first.shards) == (2, 4) and len(rows_of(spark, out)) == 12
    assert I.embed_incrementally(spark, src, out, SPEC).shards == 0
    shard(spark, src, "s9", [("u", "new", "k9")])
    assert I.embed_incrementally(spark, src, out, SPEC).shards == 1 and len(rows_of(spark, out)) == 13
    # a shard with other contents under the same name replaces its rows
    old = next(p for p in (r.path for r in I.ledger(spark, out).collect()) if "/s1/" in p)
    spark.createDataFrame([("u", "changed", "k10"), ("u", "changed too", "k1x")], "url string, caption string, key string").coalesce(1).write.parquet(f"{src}_x")
    import glob
    shutil.copy(glob.glob(f"{src}_x/*.parquet")[0], old.replace("file:", ""))
    shutil.rmtree(glob.glob(f"{src}/s1")[0] + "/none", ignore_errors=True)
    for crc in glob.glob(f"{src}/s1/.*.crc"):
        import os
        os.remove(crc)
    assert I.embed_incrementally(spark, src, out, SPEC).shards == 1
    got = rows_of(spark, out)
    assert len(got) == 12 and ("k10", "changed") in got and not any(c.startswith("text 1 ") for _, c in got)


@pytest.mark.parametrize("stop", ["before rows", "before ledger"])
def test_a_run_that_was_cut_off_is_finished_first(spark, place, monkeypatch, stop):
    src, out = place
    for i in range(3):
        shard(spark, src, f"s{i}", [("u", f"text {i}", f"k{i}")])

    class Cut(Exception):
        pass

    def cut(*a, **k):
        raise Cut
    with monkeypatch.context() as m:
        if stop == "before rows":
            m.setattr(I, "encode_samples", cut)
        else:
            write = I._write_shards
            m.setattr(I, "_write_shards", lambda shards, path: cut() if "/ledger/" in path else write(shards, path))
        with pytest.raises(Cut):
            I.embed_incrementally(spark, src, out, SPEC, batch_shards=2)
    assert I.ledger(spark, out).count() == 0
    shard(spark, src, "s7", [("u", "text 7", "k7")])
    seen = []
    scan = I.scan_dataset
    monkeypatch.setattr(I, "scan_dataset", lambda spark, paths: seen.append(paths) or scan(spark, paths))
    res = I.embed_incrementally(spark, src, out, SPEC, batch_shards=2)
    assert res.shards == 4 and sorted(len(p) for p in seen) in ([2, 2], [1, 1, 2]) and len({x for p in seen for x in p}) == 4
    assert rows_of(spark, out) == [(f"k{i}", f"text {i}") for i in (0, 1, 2, 7)]
    # committed rows are not written again, and a batch run twice changes nothing
    for batch in res.batches:
        I.run_batch(spark, out, batch, SPEC)
    assert rows_of(spark, out) == [(f"k{i}", f"text {i}") for i in (0, 1, 2, 7)]


def test_batches_are_cut_by_bytes(spark, place):
    src, out = place
    for i in range(4):
        shard(spark, src, f"s{i}", [("u", "x", f"k{i}")])
    assert len(I.plan_batches(spark, src, out, batch_bytes=1)) == 4


def test_shards_of_a_batch_are_not_prepared_in_the_task_that_writes_them(spark, tmp_path):
    from pyspark import TaskContext
    attempt = F.udf(lambda _: str(TaskContext.get().taskAttemptId()), "string").asNondeterministic()
    shards = spark.range(0, 40, 1, 8).select(attempt("id").alias("path"), F.col("id").alias("length"), F.current_timestamp().alias("modificationTime"))
    I._write_shards(shards, str(tmp_path / "plan"))
    rows = spark.read.parquet(str(tmp_path / "plan"))
    assert rows.count() == 40 and rows.select("path").distinct().count() == 8 and len(rows.inputFiles()) == 1
