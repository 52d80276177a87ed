"""Metrics of a running stream: observed per micro-batch, added up by a query listener.

``LiveMetrics.observe`` puts one aggregation on the stream that Spark computes while
the rows pass (nothing is read twice); each micro-batch's values arrive with its
progress and are added to counters, a cumulative duration histogram and gauges of
the query itself. ``exposition`` gives the text lines at any moment, in the form of the
batch exposition. Labels are those named beforehand, which bounds what is kept on the
driver; other values count under ``other``.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import metrics as M

NAME = "tessera_live"
OTHER = "other"
ROWS_PER_SECOND = ("inference_input_rows_per_second", "Rows a second of the last micro-batch")


class LiveMetrics(StreamingQueryListener):
    """Counters by (model, status), a duration histogram by model, and the input rate of the last micro-batch."""

    def __init__(self, models: list[str], statuses: list[str], buckets=M.DURATION_BUCKETS):
        self.models, self.statuses, self.buckets = [*models, OTHER], [*statuses, OTHER], buckets
        self.sums: dict[str, float] = {}
        self.rate, self.last_batch = 0.0, -1

    def observe(self, rows: DataFrame, model: str = "model", status: str = "status", value: str = "duration_s") -> DataFrame:
        def named(col: str, names: list[str], i: int):
            known = F.coalesce(F.col(col).isin(names[:-1]), F.lit(False))
            return ~known if i == len(names) - 1 else F.col(col) == names[i]
        v, aggs = F.col(value).cast("double"), []
        for i in range(len(self.models)):
            mine = named(model, self.models, i)
            aggs += [F.count_if(mine & named(status, self.statuses, j)).alias(f"c_{i}_{j}") for j in range(len(self.statuses))]
            aggs += [F.count_if(mine & (v <= float(b))).alias(f"b_{i}_{k}") for k, b in enumerate(self.buckets)]
            aggs += [F.count(F.when(mine, v)).alias(f"n_{i}"), F.coalesce(F.sum(F.when(mine, v)), F.lit(0.0)).alias(f"s_{i}"), F.count_if(mine).alias(f"rows_{i}")]
        return rows.observe(NAME, *aggs)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(NAME)
        if seen is not None:
            for field, value in seen.asDict().items():
                self.sums[field] = self.sums.get(field, 0) + (value or 0)
            self.rate = event.progress.inputRowsPerSecond or 0.0
        self.last_batch = max(self.last_batch, event.progress.batchId)

    def onQueryTerminated(self, event) -> None:
        pass

    def exposition(self, spark: SparkSession, with_rate: bool = True) -> DataFrame:
        """Text lines of all families as they stand; label values that never occurred have no line."""
        def get(field: str) -> float:
            return float(self.sums.get(field, 0))
        counts = [(m, s, get(f"c_{i}_{j}")) for i, m in enumerate(self.models) for j, s in enumerate(self.statuses) if get(f"c_{i}_{j}")]
        hist = []
        for i, m in enumerate(self.models):
            if get(f"rows_{i}"):
                hist += [(m, "bucket", b, get(f"b_{i}_{k}")) for k, b in enumerate(self.buckets)]
                hist += [(m, "bucket", M.INF, get(f"n_{i}")), (m, "count", None, get(f"n_{i}")), (m, "sum", None, round(get(f"s_{i}"), 6))]
        families = [(M.REQUESTS_TOTAL, "counter", spark.createDataFrame(counts, "model string, status string, value double"), ["model", "status"]),
                    (M.REQUEST_DURATION, "histogram", spark.createDataFrame(hist, "model string, sample string, le string, value double"), ["model"])]
        if with_rate:
            families.append((ROWS_PER_SECOND, "gauge", spark.createDataFrame([(NAME, self.rate)], "query string, value double"), ["query"]))
        return M.exposition(families)


def run_measured(rows: DataFrame, out: str, checkpoint: str, live: LiveMetrics, settle_s: float = 30.0, **columns) -> DataFrame:
    """Runs the stream to the end of its input with ``live`` listening, and reads the sink."""
    spark = rows.sparkSession
    spark.streams.addListener(live)
    try:
        q = (live.observe(rows, **columns).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
             .option("path", out).trigger(availableNow=True).start())
        q.awaitTermination()
        last = q.lastProgress
        until = time.monotonic() + settle_s                 # progress reaches listeners a little later
        while last is not None and live.last_batch < last.batchId and time.monotonic() < until:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(live)
    return spark.read.schema(rows.schema).parquet(out)
