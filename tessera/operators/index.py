"""Exact inner-product neighbours from an index that is built once and stored.

**Build.** Vectors go to the nearest of ``lists`` centroids (fitted on a bounded
sample) and are written in *pages*: up to ``PAGE_ROWS`` vectors of one list, in
the order of their distance from its centroid. A page is a row with its centre,
radius, largest norm, size, ids and vectors. Pages are cut from range-partitioned
rows, so a list that holds a third of all vectors is spread over many tasks.

**Search.** For a query q no vector of a page with centre c, radius r and largest
norm m scores above ``min(q.c + |q| r, |q| m)``. Queries go out in blocks.

1. The narrow columns of all pages give each query its ``FIRST`` most promising
   pages; these are scored, and the k-th best score found is a floor.
2. Only pages whose bound reaches the floor are read and scored. What is skipped
   cannot hold a better vector, nor one as good with a smaller id: answers equal
   those of a full scan.

Vectors travel to no one; pages are read by the columns needed, and what comes
out of a task are at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

PAGE_ROWS = 1024
FIT_ROWS = 16_384       # vectors that centroids are fitted on
MOST_LISTS = 4096
FIRST = 4               # pages scored for a floor
SLACK = 1e-9            # bounds are compared with this much room for rounding, relative to the norms
BLOCK_ROWS = 2048
BLOCK_BYTES = 32 << 20


def _centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows; empty lists keep their centroid."""
    lists = min(lists, len(sample))
    out = sample[np.random.default_rng(0).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = _nearest(sample, out)
        order = np.argsort(near, kind="stable")
        found, at = np.unique(near[order], return_index=True)
        out[found] = np.add.reduceat(sample[order], at, axis=0) / np.diff(np.r_[at, len(sample)])[:, None]
    return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(axis=1) / 2
    return np.concatenate([(x[i:i + 2048] @ centroids.T - half).argmax(axis=1) for i in range(0, len(x), 2048)] or [np.empty(0, int)])


def _matrix(column: pa.Array) -> np.ndarray:
    return pa.array(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build_index(corpus: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding",
                lists: int | None = None, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Writes the index of ``corpus`` to ``path`` and returns it: ``(page, list, n, centre, radius, norm, ids, vectors)``.

    Rows without an id, null vectors and vectors with a null component are left
    out. All vectors must have one size. An empty corpus gives an empty index.
    """
    spark = corpus.sparkSession
    whole = F.col(vec_col).isNotNull() & ~F.exists(F.col(vec_col), lambda x: x.isNull()) & F.col(id_col).isNotNull()
    rows = corpus.where(whole).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = corpus.schema[id_col].dataType.simpleString()
    n = rows.count()
    schema = f"page long, list int, n int, centre array<double>, radius double, norm double, ids array<{kind}>, vectors binary"
    if not n:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        return open_index(spark, path)
    low = rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(FIT_ROWS)
    sample = np.array([r.v for r in low.select("v").collect()], np.float64)
    centroids = _centroids(sample, lists or min(MOST_LISTS, max(1, -(-n // page_rows))))

    @F.pandas_udf("list int, d double")
    def place(v: pd.Series) -> pd.DataFrame:
        x = np.stack([np.asarray(a, np.float64) for a in v]) if len(v) else np.empty((0, centroids.shape[1]))
        near = _nearest(x, centroids)
        return pd.DataFrame({"list": near.astype(np.int32), "d": np.sqrt(((x - centroids[near]) ** 2).sum(axis=1))})

    def pages(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting = []            # (list, ids, matrix) of a page that may still grow

        def closed():
            nonlocal number
            ids, x = pa.concat_arrays([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
            centre = x.mean(axis=0)
            number += 1
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([waiting[0][0]], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([centre], pa.list_(pa.float64())),
                pa.array([float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())]), pa.array([float(np.sqrt((x * x).sum(axis=1)).max())]),
                pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids), pa.array([x.tobytes()], pa.binary())],
                ["page", "list", "n", "centre", "radius", "norm", "ids", "vectors"])
        for batch in batches:
            if not batch.num_rows:
                continue
            of, x = batch.column(0).to_numpy(), _matrix(batch.column(2))
            at = 0
            while at < len(of):
                if waiting and waiting[0][0] != of[at]:
                    yield closed()
                    waiting = []
                room = page_rows - sum(len(w[2]) for w in waiting)
                same = int(np.argmax(np.r_[of[at:] != of[at], True]))
                take = min(room, same)
                waiting.append((int(of[at]), batch.column(1).slice(at, take), x[at:at + take]))
                at += take
                if take == room:
                    yield closed()
                    waiting = []
        if waiting:
            yield closed()

    placed = rows.withColumn("p", place("v")).select("p.list", "id", "v", "p.d")
    tasks = max(1, -(-n // (64 * page_rows)))
    dealt = placed.repartitionByRange(tasks, "list", "d", "id").sortWithinPartitions("list", "d", "id").select("list", "id", "v")
    dealt.mapInArrow(pages, schema).write.mode("overwrite").parquet(path)
    return open_index(spark, path)


def open_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---------------------------------------------------------------- search

def _bounds(batch: pa.RecordBatch, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(pages, queries): no vector of the page scores above it. Columns: page, n, centre, radius, norm."""
    centre, radius, norm = _matrix(batch.column(2)), batch.column(3).to_numpy(), batch.column(4).to_numpy()
    most = norm[:, None] * lengths
    return np.minimum(centre @ queries.T + radius[:, None] * lengths, most) + SLACK * (1 + most)


def _ask(index: DataFrame, block, k: int, pick) -> DataFrame:
    """``(q, id, score)``: the best k of each task among the pages that ``pick(bounds, pages)`` gives as (query, place) pairs."""
    narrow = index.select("page", "n", "centre", "radius", "norm")

    def wanted(batches):
        queries, lengths, _ = block.value
        for batch in batches:
            if batch.num_rows:
                q, at = pick(_bounds(batch, queries, lengths), batch.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(q.astype(np.int32))], ["page", "q"])
    return narrow.mapInArrow(wanted, "page long, q int")


def _scored(index: DataFrame, pairs: DataFrame, block, k: int) -> DataFrame:
    """``pairs(page, q)`` -> ``(q, id, score, n)``: the best k of each page and query, and rows scored for it."""
    asked = pairs.groupBy("page").agg(F.collect_list("q").alias("qs"))          # at most a block of queries
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("id", kind), T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(batches):
        queries, _, _ = block.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, qs = batch.column(0)[i].values, np.asarray(batch.column(2)[i].values.to_numpy())
                x = np.frombuffer(batch.column(1)[i].as_py(), np.float64).reshape(len(ids), -1)
                score = queries[qs] @ x.T
                kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(qs), -np.inf)
                r, c = np.nonzero(score >= kth[:, None])                         # ties of the last place stay, the final rank settles them
                first = np.r_[True, r[1:] != r[:-1]][:len(r)]
                yield pa.RecordBatch.from_arrays([pa.array(qs[r].astype(np.int32)), ids.take(pa.array(c)), pa.array(score[r, c]),
                                                  pa.array(np.where(first, len(ids), 0).astype(np.int64))], ["q", "id", "score", "n"])
    return index.select("page", "ids", "vectors").join(asked, "page").select("ids", "vectors", "qs").mapInArrow(run, schema)


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "index_search")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def search_index(index: DataFrame, queries: DataFrame, k: int, vec_col: str = "embedding", query_id_col: str = "query_id", id_col: str = "vec_id",
                 with_scored: bool = False) -> DataFrame:
    """``(query_id, id, score, rank)`` of the ``k`` best inner products per query; ties by id.

    Null query vectors, or those with a null component, are not asked.
    ``with_scored`` adds ``rows_scored``, the vectors compared with the query.
    """
    spark = index.sparkSession
    whole = F.col(vec_col).isNotNull() & ~F.exists(F.col(vec_col), lambda x: x.isNull())
    asked = queries.where(whole).select(F.col(query_id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("v"))
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    query_type, id_type = asked.schema["query_id"].dataType, index.schema["ids"].dataType.elementType
    out_schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType())])
    found = spark.createDataFrame([], out_schema)
    blocks = -(-n // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width or 1, 1)))))
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        matrix = np.array([r.v for r in rows], np.float64)
        block = spark.sparkContext.broadcast((matrix, np.sqrt((matrix * matrix).sum(axis=1)), None))

        def first(bounds, pages):
            top = np.argpartition(-bounds, min(FIRST, len(bounds)) - 1, axis=0)[:FIRST]
            return np.broadcast_to(np.arange(bounds.shape[1]), top.shape).reshape(-1), top.reshape(-1)
        # the most promising pages of each task, then of all: at most FIRST a query and task travel
        near = _ask(index, block, k, first)
        bound = index.select("page", "n", "centre", "radius", "norm").join(near, "page")
        best = _best_pages(bound, block)
        probe = _written(_scored(index, best, block, k))
        floor = np.full(len(rows), -np.inf)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))
        for r in probe.withColumn("rank", rank).where(F.col("rank") == k).select("q", "score").collect():      # a row a query
            floor[r.q] = r.score
        block2 = spark.sparkContext.broadcast((block.value[0], block.value[1], floor))

        def reach(bounds, pages, block2=block2):
            at, q = np.nonzero(bounds >= block2.value[2])
            return q, at
        rest = _ask(index, block2, k, reach).join(best, ["page", "q"], "left_anti")
        got = _written(probe.unionByName(_scored(index, rest, block2, k)))
        names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(rows)],
                                      T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", query_type)]))
        found = found.unionByName(got.join(names, "q").select("query_id", "id", "score", "n"))
        block.unpersist()
        block2.unpersist()
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    ranked = found.withColumn("rank", F.row_number().over(w))
    if with_scored:
        ranked = ranked.withColumn("rows_scored", F.sum("n").over(Window.partitionBy("query_id")))
    return ranked.where(F.col("rank") <= k).drop("n").withColumnRenamed("id", id_col)


def _best_pages(pages: DataFrame, block) -> DataFrame:
    """``pages(page, n, centre, radius, norm, q)`` -> ``(page, q)``: the ``FIRST`` of largest bound for each query."""
    def run(batches):
        queries, lengths, _ = block.value
        for batch in batches:
            if batch.num_rows:
                q = batch.column(5).to_numpy()
                centre, radius, norm = _matrix(batch.column(2)), batch.column(3).to_numpy(), batch.column(4).to_numpy()
                bound = np.minimum((centre * queries[q]).sum(axis=1) + radius * lengths[q], norm * lengths[q])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(bound)], ["page", "q", "bound"])
    bounds = pages.select("page", "n", "centre", "radius", "norm", "q").mapInArrow(run, "page long, q int, bound double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("bound").desc(), "page"))
    return _written(bounds.withColumn("rank", rank).where(F.col("rank") <= FIRST).select("page", "q"))
