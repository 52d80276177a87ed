"""Metrics gathered while a stream runs against those of its rows afterwards."""

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.session import scratch_path
from tessera.streaming.live_metrics import OTHER, ROWS_PER_SECOND, LiveMetrics, run_measured


def test_exposition_after_a_run_equals_the_batch_exposition(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(["a", "b", 'odd"name', None][i % 4], ["success", "error", "strange"][i % 3], None if i % 10 == 9 else i / 100) for i in range(300)]
    spark.createDataFrame(rows, "model string, status string, duration_s double").repartition(6).write.parquet(src)
    stream = spark.readStream.schema("model string, status string, duration_s double").option("maxFilesPerTrigger", 2).parquet(src)
    live = LiveMetrics(["a", 'odd"name'], ["success", "error"])
    out = scratch_path(spark, "live")
    got = run_measured(stream, out + "/o", out + "/c", live)
    assert got.count() == 300 and live.last_batch >= 2
    named = got.withColumn("model", F.when(F.col("model").isin("a", 'odd"name'), F.col("model")).otherwise(OTHER)).withColumn(
        "status", F.when(F.col("status").isin("success", "error"), F.col("status")).otherwise(OTHER))
    hist = M.histogram(named, "duration_s", ["model"]).withColumn("value", F.when(F.col("sample") == "sum", F.round("value", 6)).otherwise(F.col("value")))
    want = M.exposition([(M.REQUESTS_TOTAL, "counter", M.counter(named, ["model", "status"]), ["model", "status"]), (M.REQUEST_DURATION, "histogram", hist, ["model"])])
    assert sorted(r.line for r in live.exposition(spark, with_rate=False).collect()) == sorted(r.line for r in want.collect())
    assert any(r.line.startswith(ROWS_PER_SECOND[0]) for r in live.exposition(spark).collect())


def test_nothing_seen(spark):
    assert [r.line[:6] for r in LiveMetrics(["a"], ["x"]).exposition(spark, with_rate=False).collect()] == ["# HELP", "# TYPE"] * 2
