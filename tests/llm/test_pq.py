"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import pq as P

from .conftest import union_find


def brute(ids, x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    root = union_find(len(x), np.argwhere(np.triu(near)))
    least = {}
    for r, i in zip(root, ids, strict=True):
        least[r] = min(least.get(r, i), i)
    return {i: (int(n), least[r], i == least[r]) for i, n, r in zip(ids, near.sum(axis=1), root, strict=True)}


def answers(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("part_rows,group_rows", [(4096, 1 << 17), (50, 60)])
def test_against_brute_force(spark, part_rows, group_rows):
    vecs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = vecs.toPandas()
    x = np.stack(pdf.embedding).astype(np.float64)
    got, want = answers(P.near_duplicates(vecs, part_rows=part_rows, group_rows=group_rows)), brute(list(pdf.vec_id), x)
    assert got.keys() == want.keys()
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert all(g[0] <= want[i][0] for i, g in got.items())
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    a = P.unit(rng.standard_normal((1500, 64)))
    n = rng.standard_normal(a.shape)
    n = P.unit(n - (n * a).sum(axis=1)[:, None] * a)
    x = np.concatenate([a, .905 * a + np.sqrt(1 - .905 ** 2) * n])
    got = P.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0").count() >= 0.98 * len(x)


def test_crowded_cluster(spark):
    rng = np.random.default_rng(4)
    hub = P.unit(rng.standard_normal((1, 16)))
    x = np.concatenate([hub + .05 * rng.standard_normal((300, 16)), np.repeat(hub * 3, 100, axis=0), rng.standard_normal((200, 16))])
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    assert answers(P.near_duplicates(df, part_rows=64, group_rows=32)) == brute(ids, x)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [inf, 1.0]), (5, [nan, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [2.0, 0.01]),
            (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, None), (7, [1.0, 0.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("v", F.lit("x"))
    out = P.near_duplicates(df).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: r for r in out if r.vec_id}
    assert all((by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10))
    assert by[7].n_links == 3 and by[8].n_links == 3 and by[8].component_id == 7 and not by[8].kept
    assert sorted((r.n_links, r.component_id or 0) for r in out if r.vec_id is None) == [(0, 0), (3, 7)]


def test_empty_table(spark):
    assert P.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
