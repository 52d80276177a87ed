"""Stored exact index against the flat scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import index as X
from tessera.operators.topk import topk_inner_product


def rows_of(df, ids="vec_id"):
    return sorted((r.query_id, r["rank"], r[ids], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("page_rows,lists,k", [(16, None, 5), (7, 3, 1), (1024, 1, 12), (5, 40, 9)])
def test_equals_the_flat_scan(spark, tmp_path, page_rows, lists, k):
    rng = np.random.default_rng(page_rows)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 700)] + 0.1 * rng.normal(size=(700, 6))
    x[:200] = x[0]                                               # ties: a third in one place
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (None, [1.0] * 6), (9001, [0.0] * 6)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(f"q{i}", [float(v) for v in x[i] * (1 + i % 3)]) for i in range(0, 700, 60)] + [("zero", [0.0] * 6), ("none", None)],
                                  "query_id string, embedding array<double>")
    index = X.build_index(corpus, str(tmp_path / "index"), lists=lists, page_rows=page_rows)
    stored = index.collect()
    assert sum(r.n for r in stored) == 701 and max(r.n for r in stored) <= page_rows and len({r.page for r in stored}) == len(stored)
    got = X.search_index(X.open_index(spark, str(tmp_path / "index")), asked, k)
    assert rows_of(got) == rows_of(topk_inner_product(corpus, asked, k))


def test_few_rows_are_scored_on_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16)) * 3
    x = centres[rng.integers(0, 60, 12_000)] + 0.2 * rng.normal(size=(12_000, 16))
    corpus = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id int, embedding array<double>")
    asked = corpus.where("vec_id % 400 = 0").withColumnRenamed("vec_id", "query_id")
    index = X.build_index(corpus, str(tmp_path / "index"), page_rows=128)
    got = X.search_index(index, asked, 10, with_scored=True)
    share = got.agg(F.avg("rows_scored")).first()[0] / 12_000
    assert share < 0.3, share
    assert rows_of(got.drop("rows_scored")) == rows_of(topk_inner_product(corpus, asked, 10))


def test_blocks_strings_and_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 3)
    rows = [(f"v{i}", [float(i % 7), float(i % 3)]) for i in range(50)]
    corpus = spark.createDataFrame(rows, "name string, e array<float>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)], "query_id int, embedding array<double>")
    index = X.build_index(corpus, str(tmp_path / "a"), "name", "e", page_rows=8)
    want = topk_inner_product(corpus.withColumn("embedding", F.col("e").cast("array<double>")), asked, 4, id_col="name")
    assert rows_of(X.search_index(index, asked, 4, id_col="name"), "name") == rows_of(want, "name")
    empty = X.build_index(corpus.limit(0), str(tmp_path / "b"), "name", "e")
    assert X.search_index(empty, asked, 4).collect() == [] and X.search_index(index, asked.limit(0), 4).collect() == []
