"""Exact inner-product nearest neighbours (flat index semantics).

The corpus is streamed past blocks of queries. A block is bounded in rows and
bytes, so it can be sent to the executors; each corpus partition scores its rows
against the block with one matrix product per Arrow batch and keeps its own
top-k per query, so the shuffle carries at most ``k x queries`` rows per
partition. Any number of queries takes the same path, one block after another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 4096


def _partial_topk(block, k: int):
    """Rows ``(id, vector)`` -> the partition's best k ``(query number, id, score)``; ties by id."""
    def run(batches):
        queries = block.value
        floor, best = np.full(len(queries), -np.inf), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = pa.array(batch.column(1)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            scores = vectors @ queries.T
            least = np.maximum(floor, np.partition(scores, n - k, axis=0)[n - k]) if n > k else floor
            row, q = np.nonzero(scores >= least)
            if not len(row):
                continue
            new = pa.table([pa.array(q.astype(np.int32)), batch.column(0).take(pa.array(row)), pa.array(scores[row, q])], ["_q", "id", "score"])
            best = new if best is None else pa.concat_tables([best, new])
            best = best.take(pc.sort_indices(best, [("_q", "ascending"), ("score", "descending"), ("id", "ascending")]))
            of = best.column("_q").to_numpy()
            place = np.arange(len(of)) - np.searchsorted(of, of)
            last = np.flatnonzero(place == k - 1)
            floor[of[last]] = best.column("score").to_numpy()[last]
            best = best.filter(pa.array(place < k))
        if best is not None:
            yield from best.combine_chunks().to_batches()
    return run


def topk_inner_product(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
                       vec_col: str = "embedding", query_id_col: str = "query_id") -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best inner products per query; ties by id.

    Ids keep their types. Null vectors, or vectors with a null component, are
    neither found nor asked; no queries or an empty corpus give an empty frame.
    All vectors must have one size.
    """
    spark = corpus.sparkSession
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(F.col(c), lambda x: x.isNull())
    rows = corpus.where(whole(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(vec_col).cast("array<double>"))
    asked = queries.where(whole(vec_col)).select(F.col(query_id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("v"))
    id_type, query_type = corpus.schema[id_col].dataType, asked.schema["query_id"].dataType
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    out_schema = T.StructType([T.StructField("query_id", query_type), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])
    found = spark.createDataFrame([], out_schema)
    blocks = -(-n // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width or 1, 1)))))
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not block:
            continue
        matrix = spark.sparkContext.broadcast(np.array([r.v for r in block], np.float64))
        part_schema = T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
        part = rows.mapInArrow(_partial_topk(matrix, k), part_schema)
        names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(block)], T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("query_id", query_type)]))
        found = found.unionByName(part.join(names, "_q").select("query_id", F.col("id").alias(id_col), "score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col).asc())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
