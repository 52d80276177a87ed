"""Centroid clustering by dimension-sharded Lloyd rounds, in exact integers (operator 12).

A component x becomes ``floor(scale * x)``. Vectors are cut into *column blocks*
of ``BLOCK_DIMS`` components and written once, a file a column block, in chunks of
``CHUNK`` vectors. Each round reads them:

1. **Partial distances.** A column-block task needs one slice of the centroids. It
   compares its part of each vector with that slice of all centroids:
   ``(chunk, vectors x clusters)``, exact.
2. **Sum and argmin.** ``reduceByKey`` adds the blocks of a chunk; the nearest
   centroid (of equal ones the smaller number) is the label.
3. **Update.** The blocks of a chunk, which came along with its distances, are
   summed by label, each for its shard. ``reduceByKey`` adds the sums of a shard, and
   the shard sets its own slice to ``floor(sum / count)``; empty clusters stay.

The driver holds the slices between rounds: clusters x dimension integers, bounded
by parameters. A round depends on the written blocks and the slices only, so
lineage does not grow; a lost executor costs its chunks of one round. A cluster
that holds a third of all vectors is no hot key: keys are chunks and shards, and
a shard gets one sum from each task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_path

CLUSTERS = 40
ROUNDS = 5
SCALE = 256
DIMS = 64
SEED = "2"
BLOCK_DIMS = 32         # components of a column block
CHUNK = 4096            # vectors of a chunk; fewer if there are many clusters
CHUNK_CELLS = 1 << 20   # vectors x clusters of a chunk at most, but for one row
GROUP_ROWS = 1 << 16    # vectors whose distances are added in one task
LIMIT = 1 << 26         # components beyond it would not leave distances in 64 bits


def quantised(vector: Column, dims: int = DIMS, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component; null unless the vector has ``dims`` finite components."""
    x = F.transform(vector, lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.forall(x, lambda c: F.abs(c * scale) < LIMIT)
    ints = F.transform(x, lambda c: F.floor(c * scale).cast("int"))
    fail = F.raise_error(F.lit(f"components of {LIMIT} / {scale} or more: distances would not fit a long"))
    good = vector.isNotNull() & (F.size(vector) == dims) & F.coalesce(whole, F.lit(False))
    return F.when(good, F.when(small, ints).otherwise(fail.cast("array<int>")))


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, clusters) of integer rows."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:        # exact in doubles, by matrix product
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(centroids)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j].astype(np.int64)[:, None] - centroids[:, j].astype(np.int64)
        out += d * d
    return out


def sums_by_label(x: np.ndarray, label: np.ndarray, clusters: int) -> np.ndarray:
    """(clusters, components + 1): exact component sums of each label, and its count."""
    out = np.zeros((clusters, x.shape[1] + 1), np.int64)
    order = np.argsort(label, kind="stable")
    found, at = np.unique(label[order], return_index=True)
    if len(found):
        out[found, :-1] = np.add.reduceat(x[order].astype(np.int64), at, axis=0)
        out[found, -1] = np.diff(np.r_[at, len(label)])
    return out


def _written(rows: DataFrame, dims: int, block_dims: int, size: int) -> tuple[DataFrame, DataFrame]:
    """``rows(id, q)`` as ``(chunk, ids)`` and as ``(block, chunk, n, most, x)``: matrices of 2- or 4-byte integers."""
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    names = ["chunk", "block", "n", "most", "x", "ids"]

    def run(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = pa.array(part.column(1)).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, dims)
                most = int(np.abs(x).max(initial=0))
                cut = [x[:, a:a + block_dims].astype("<i2" if most < 1 << 15 else "<i4").tobytes() for a in range(0, dims, block_dims)]
                ids = pa.ListArray.from_arrays(pa.array([0, *[len(x)] * len(cut)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array([len(x)] * len(cut), pa.int64()),
                    pa.array([most] * len(cut), pa.int64()), pa.array(cut, pa.binary()), ids], names)
                key += 1

    made = rows.mapInArrow(run, f"chunk long, block int, n long, most long, x binary, ids array<{kind}>")
    path = scratch_path(spark, "blocks")
    made.write.partitionBy("block").parquet(path)           # ids stand with block 0
    table = spark.read.schema(made.schema).parquet(path)
    return table.where("block = 0").select("chunk", "ids"), table.select("block", "chunk", "n", "most", "x")


def _rounds(blocks: DataFrame, centroids: np.ndarray, rounds: int, block_dims: int, n: int, most: int):
    """Final centroids and the RDD of ``(chunk, (labels, distances))``."""
    clusters, dims = centroids.shape
    starts = list(range(0, dims, block_dims))
    groups = -(-n // GROUP_ROWS)
    exact = np.int32 if dims * (2 * most) ** 2 < 1 << 31 else np.int64
    stored = blocks.select("block", "chunk", "n", "x").rdd

    def partials(slices):
        def of(row):
            shard, chunk, size, raw = row
            x = np.frombuffer(raw, "<i2" if len(raw) == 2 * size * slices[shard].shape[1] else "<i4").reshape(size, -1)
            return chunk, (partial_distances(x, slices[shard]).astype(exact), {shard: x})
        return stored.map(of).reduceByKey(lambda a, b: (a[0] + b[0], a[1] | b[1]), groups)

    def nearest(d):
        label = d.argmin(axis=1).astype(np.int32)
        return label, d[np.arange(len(d)), label].astype(np.int64)

    def shard_sums(rows):
        total = {}
        for _, (distance, parts) in rows:
            label, _ = nearest(distance)
            for shard, x in parts.items():
                s = sums_by_label(x, label, clusters)
                total[shard] = s if shard not in total else total[shard] + s
        return iter(total.items())

    slices = [centroids[:, a:a + block_dims] for a in starts]
    for _ in range(rounds):
        old = slices

        def own_slice(kv, old=old):
            shard, s = kv
            count = s[:, -1:]
            return shard, np.where(count > 0, s[:, :-1] // np.maximum(count, 1), old[shard])
        sums = partials(old).mapPartitions(shard_sums).reduceByKey(np.add, len(starts))
        slices = [s for _, s in sorted(sums.map(own_slice).collect(), key=lambda kv: kv[0])]       # clusters x dims integers
    return np.concatenate(slices, axis=1), partials(slices).mapValues(lambda v: nearest(v[0]))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            dims: int = DIMS, scale: int = SCALE, seed: str = SEED, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every usable vector.

    Vectors that are null, have another size or a null or non-finite component
    get no row. First centroids are the vectors with the least SHA-256 of
    ``seed:id`` (a null id counts as an empty one, equal ids go by components);
    of fewer than ``clusters`` vectors each is one. Repeated rows count each. An
    empty table gives an empty one; other columns are not read. Components of
    ``2**26 / scale`` or more raise an error, since distances would not fit a long.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector_col), dims, scale).alias("q")).where("q is not null")
    chunks, blocks = _written(rows, dims, block_dims, max(1, min(CHUNK, CHUNK_CELLS // clusters)))
    n, most = blocks.where("block = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0))).first()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not n:
        return spark.createDataFrame([], schema)
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.withColumn("h", digest).orderBy("h", "q").limit(clusters).select("q").collect()
    centroids, labels = _rounds(blocks, np.array([r.q for r in first], np.int64), rounds, block_dims, n, most)

    # labels travel as a binary value a chunk
    found = spark.createDataFrame(labels.map(lambda kv: (kv[0], kv[1][0].tobytes(), kv[1][1].tobytes())), "chunk long, label binary, distance binary")

    def spread(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                label, distance = np.frombuffer(batch.column(1)[i].as_py(), np.int32), np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(label), pa.array(distance)], ["vec_id", "cluster", "distance"])
    per = materialise(chunks.select("chunk", "ids").join(found, "chunk").select("ids", "label", "distance")
                      .mapInArrow(spread, f"vec_id {kind}, cluster int, distance long"))
    sums = {r.cluster: r.d for r in per.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}      # at most a row a cluster
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = pd.DataFrame({"cluster": range(len(hashes)), "cluster_inertia": [sums.get(i, 0) for i in range(len(hashes))],
                          "inertia": sum(sums.values()), "centroid_sha256": hashes})
    of_cluster = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return per.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
