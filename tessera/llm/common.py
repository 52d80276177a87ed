"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path, table  # noqa: F401  (re-exported for the operators)

WORD = r"[^\x20\x09-\x0D]+"
#: crc32(doc_id as text) mod FOLDS = 0 marks the held-out fold.
FOLDS = 5


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet below the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is a Parquet scan with nothing but filters and projections above it."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName() in ("LogicalRelation", "Relation") or plan.nodeName().startswith("Relation ")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` plus ``name``, a key of each row that is the same at every reading.

    Rows of a Parquet scan are known by file and place in it, so nothing is
    copied; anything else is numbered and written once.
    """
    if "_metadata" not in docs.columns and _is_scan(docs):
        try:
            file = F.col("_metadata.file_path")
            return docs.select("*", F.struct(F.xxhash64(file).alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
        except AnalysisException:       # a source without row numbers
            pass
    return materialise(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))))


def held_out(doc_id: Column) -> Column:
    """True for the fold no classifier learns from (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name derived from ``stem`` that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
