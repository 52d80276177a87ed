import hashlib
import math

import numpy as np
import pytest

from tessera.llm import clustering

from .conftest import SF


def plain(rows, clusters, rounds, dims, scale=256, seed="2"):
    """Lloyd's rounds in Python integers; ``rows`` of (id, vector)."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:clusters]]

    def assign():
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres)) for _, v in kept]
        return [k for _, k in near], [d for d, _ in near]
    for _ in range(rounds):
        label, _ = assign()
        for k in range(len(centres)):
            mine = [v for (_, v), at in zip(kept, label, strict=True) if at == k]
            if mine:
                centres[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    label, dist = assign()
    per = [sum(d for d, at in zip(dist, label, strict=True) if at == k) for k in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, at, d, per[at], sum(dist), names[at]) for (i, _), at, d in zip(kept, label, dist, strict=True)), key=str)


def test_whole_table_equals_plain_rounds(spark):
    from tessera.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_centroid_clustering"](spark, SF).collect()), key=str)
    assert got == plain(rows, 40, 5, 64)


@pytest.mark.parametrize("block_dims,chunk", [(2, 7), (3, 4096), (8, 1)])
def test_shards_and_chunks_change_nothing(spark, monkeypatch, block_dims, chunk):
    monkeypatch.setattr(clustering, "CHUNK", chunk)
    monkeypatch.setattr(clustering, "GROUP_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(int(i) if i % 11 else None, [float(x) for x in rng.normal(size=7)]) for i in range(90)]
    rows += [(200, rows[3][1]), (200, rows[3][1]), (201, [1.0] * 6), (202, None), (203, [1.0] * 6 + [None]), (204, [math.nan] * 7), (205, [math.inf] * 7), (206, [0.0] * 7)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(5)
    got = clustering.cluster(table, clusters=6, rounds=3, dims=7, block_dims=block_dims)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 6, 3, 7)


def test_a_third_of_all_rows_in_one_place(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100 + i, [float(i), -float(i)]) for i in range(60)]
    got = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), clusters=5, rounds=4, dims=2, block_dims=1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 5, 4, 2)


def test_few_vectors_empty_table_and_clashing_names(spark):
    rows = [("a", [1.0, 0.5], 1, 2), ("b", [3.0, 0.25], 3, 4)]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<float>, cluster int, q int")
    got = sorted(tuple(r) for r in clustering.cluster(table, dims=2).collect())
    assert got == plain([r[:2] for r in rows], 40, 5, 2)
    empty = clustering.cluster(table.limit(0), dims=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="would not fit"):
        clustering.cluster(spark.createDataFrame([("a", [1e9, 0.0])], "vec_id string, embedding array<double>"), dims=2).collect()


@pytest.mark.parametrize("most", [300, 1 << 25])
def test_partial_distances_are_exact(most):
    rng = np.random.default_rng(1)
    x, c = rng.integers(-most, most, (20, 5)), rng.integers(-most, most, (4, 5))
    assert clustering.partial_distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]
