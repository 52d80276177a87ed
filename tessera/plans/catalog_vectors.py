"""Registered queries: vector post-processing on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions import vectors as V
from ..operators.index import build_index, open_index, search_index
from ..operators.topk import topk_inner_product
from ..session import prepare, scratch_path, table

N_CLASSES = 10
TOPK = 5


def _emb(spark, sf_dir):
    prepare(spark)
    return table(spark, sf_dir, "embeddings")


@register("l2_normalize", """
WITH s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (label + 1)) AS e FROM embeddings),
u AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim,
             sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM s)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x / n, 6) AS value FROM u""")
def l2_normalize(spark, sf_dir):
    """Scaled vectors (x (label+1)) normalised back to unit length."""
    e = _emb(spark, sf_dir)
    scaled = F.transform(V.as_double("embedding"), lambda x: x * (F.col("label") + 1))
    out = e.select("vec_id", V.l2_normalize(scaled).alias("v"))
    return out.select("vec_id", F.posexplode("v").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


@register("linear_logits", f"""
WITH u AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x,
                  generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
SELECT vec_id, CAST(k AS INTEGER) AS class, round(sum(x * ((((31 * k + 17 * j) % 101) - 50) / 50.0)), 4) AS logit
FROM u CROSS JOIN range({N_CLASSES}) AS r(k) GROUP BY vec_id, k""")
def linear_logits(spark, sf_dir):
    """Fixed linear head (10 classes) over each vector."""
    e = _emb(spark, sf_dir)
    out = e.select("vec_id", V.linear_head("embedding", N_CLASSES).alias("logits"))
    return out.select("vec_id", F.posexplode("logits").alias("class", "logit")).select(
        "vec_id", F.col("class").cast("int").alias("class"), F.round("logit", 4).alias("logit"))


@register("embedding_profile", """
SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(min(len(embedding)) AS INTEGER) AS dim_min, CAST(max(len(embedding)) AS INTEGER) AS dim_max,
       round(min(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))), 5) AS norm_min,
       round(max(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))), 5) AS norm_max
FROM embeddings GROUP BY label""")
def embedding_profile(spark, sf_dir):
    """Rows, dimension range and norm range per label."""
    e = _emb(spark, sf_dir).select("label", F.size("embedding").alias("d"), V.norm("embedding").alias("nrm"))
    return e.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("dim_min"), F.max("d").alias("dim_max"),
        F.round(F.min("nrm"), 5).alias("norm_min"), F.round(F.max("nrm"), 5).alias("norm_max"))


@register("topk_inner_product", f"""
WITH q AS (SELECT DISTINCT ON (label) vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv
           FROM embeddings ORDER BY label, vec_id),
s AS (SELECT q.query_id, e.vec_id, list_dot_product(q.qv, CAST(e.embedding AS DOUBLE[])) AS score
      FROM q CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {TOPK}""")
def topk_inner_product_q(spark, sf_dir):
    """Top-5 inner-product neighbours of one query vector per label (first id of each label)."""
    e = _emb(spark, sf_dir)
    first = e.groupBy("label").agg(F.min("vec_id").alias("query_id"))
    queries = first.join(e.withColumnRenamed("vec_id", "query_id"), ["label", "query_id"])
    r = topk_inner_product(e, queries, TOPK)
    return r.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


_INDEXES: dict = {}
INDEX_PAGE_ROWS = 64


@register("topk_stored_index", f"""
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, e.vec_id, list_dot_product(q.qv, CAST(e.embedding AS DOUBLE[])) AS score
      FROM q CROSS JOIN embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {TOPK}""")
def topk_stored_index(spark, sf_dir):
    """Top-5 inner-product neighbours of every 50th vector from an index that was built and stored before."""
    e = _emb(spark, sf_dir)
    key = (sf_dir, scratch_path(spark, unique=False))
    if key not in _INDEXES:
        _INDEXES[key] = scratch_path(spark, "vector_index")
        build_index(e, _INDEXES[key], page_rows=INDEX_PAGE_ROWS)
    queries = e.where(F.pmod("vec_id", F.lit(50)) == 0).withColumnRenamed("vec_id", "query_id")
    r = search_index(open_index(spark, _INDEXES[key]), queries, TOPK)
    return r.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("score", 6).alias("score"))
