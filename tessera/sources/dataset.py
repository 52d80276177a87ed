"""Dataset shards: discovery, merged-schema scan, shard subsets, fixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

SHARD_COL = "_shard"
ROW_COL = "_row"


def _reader(spark: SparkSession, merge: bool = True):
    return (spark.read.option("mergeSchema", str(merge).lower())
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet"))


def list_shards(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.parquet`` file below ``root`` in lexicographic path order.

    Only file metadata is read: the ``content`` column of the binary-file
    source is pruned away, so no shard is opened.
    """
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.parquet")
             .load(root)
             .select("path", "length", "modificationTime"))
    return files.orderBy("path")


def scan_dataset(spark: SparkSession, root: str | list[str], with_position: bool = True) -> DataFrame:
    """All shards as one frame, columns unioned across shards.

    ``_shard`` (file path) and ``_row`` (row index inside the file) identify
    each row. If shards disagree on a column's type it gets the widest of
    them: the larger integer, double for integers with floating point, string
    for anything else. Shards are then read in one scan per combination of
    types, of which there are few. A root without shards raises Spark's own error.
    """
    paths = [root] if isinstance(root, str) else list(root)
    try:
        df = _reader(spark).parquet(*paths)
    except Exception as e:  # CANNOT_MERGE_SCHEMAS surfaces as a JVM SparkException
        if "CANNOT_MERGE_SCHEMAS" not in str(e):
            raise
        return _widened(spark, paths, with_position)
    return df.select("*", *_position()) if with_position else df


def _position():
    return [F.col("_metadata.file_path").alias(SHARD_COL), F.col("_metadata.row_index").alias(ROW_COL)]


def _mergeable(spark, files: list[str]) -> list[tuple[list[str], T.StructType]]:
    """Consecutive files whose schemas merge, with that schema, by halving what does not."""
    try:
        return [(files, spark.read.option("mergeSchema", "true").parquet(*files).schema)]
    except Exception as e:
        if "CANNOT_MERGE_SCHEMAS" not in str(e) or len(files) == 1:
            raise
    half = len(files) // 2
    return _mergeable(spark, files[:half]) + _mergeable(spark, files[half:])


_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def widest(types: set[str]) -> str:
    """The common type of differing simple type names."""
    if len(types) == 1:
        return next(iter(types))
    if types <= set(_INTEGERS):
        return max(types, key=_INTEGERS.index)
    return "double" if types <= {*_INTEGERS, "float", "double"} else "string"


def _widened(spark, paths, with_position: bool) -> DataFrame:
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
               .load(paths).select("path"))
    files = sorted(r.path for r in listing.collect())     # Spark's own file index holds them on the driver as well
    parts = _mergeable(spark, files)
    types: dict[str, set[str]] = {}
    for _, schema in parts:
        for f in schema.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    differing = [c for c, ts in types.items() if len(ts) > 1]
    groups: dict[tuple, list[str]] = {}
    for some, schema in parts:
        kind = {f.name: f.dataType.simpleString() for f in schema.fields}
        groups.setdefault(tuple(kind.get(c) for c in differing), []).extend(some)
    frames = []
    for some in groups.values():
        f = spark.read.option("mergeSchema", "true").parquet(*some)
        columns = [F.col(c).cast(widest(types[c])).alias(c) if c in differing else F.col(c) for c in f.columns]
        frames.append(f.select(*columns, *(_position() if with_position else [])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_shards(spark: SparkSession, root: str, shard_names: list[str]) -> DataFrame:
    """Only the named shards (directory or file names below ``root``); others are listed, never opened.

    The paths of the named shards are all that reaches the driver. If there is
    none of them the frame is empty, with the columns of the whole dataset.
    """
    named = reduce(lambda a, b: a | b, [F.col("path").contains(f"/{n}/") | F.col("path").endswith(f"/{n}") for n in shard_names])
    found = [r.path for r in list_shards(spark, root).where(named).collect()]
    return scan_dataset(spark, found) if found else scan_dataset(spark, root).where(F.lit(False))


# ---------------------------------------------------------------- fixtures
def document_samples(documents: DataFrame) -> DataFrame:
    """``documents`` in sample shape: url, caption, key + metadata columns."""
    return documents.select(
        F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("caption"),
        F.col("doc_id").cast("string").alias("key"),
        "lang", "source", "n_chars", "doc_id")


def page_samples(pages: DataFrame) -> DataFrame:
    """``pages`` in sample shape without a caption column."""
    return pages.select(
        "url",
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("key"),
        F.octet_length(F.col("html")).cast("long").alias("n_bytes"),
        F.col("page_id").alias("doc_id"))


def write_shards(df: DataFrame, out: str, id_col: str, rows_per_shard: int) -> str:
    """Write ``df`` as shards ``shard=00000, 00001, …`` by ``id_col`` ranges.

    A shard holds at most ``rows_per_shard`` ids, so a task writes a bounded
    amount; rows inside a shard are in ``id_col`` order. Names have five digits,
    or as many as the last shard needs, so that their order is that of the ids.
    """
    last = df.agg(F.max(F.floor(F.col(id_col) / F.lit(rows_per_shard)))).first()[0]
    width = max(5, len(str(last or 0)))
    shard = F.lpad(F.floor(F.col(id_col) / F.lit(rows_per_shard)).cast("string"), width, "0")
    (df.withColumn("shard", shard)
       .repartition("shard").sortWithinPartitions("shard", id_col)
       .write.mode("overwrite").partitionBy("shard").parquet(out))
    return out


_FIXTURES: dict = {}


def sample_dataset(spark: SparkSession, sf_dir: str, rows_per_shard: int = 250) -> str:
    """Two differently shaped shard groups derived from the given tables.

    ``docs/shard=*`` from ``documents`` and ``pages/shard=*`` from ``pages``;
    written once per process under the shared checkpoint folder.
    """
    key = (sf_dir, rows_per_shard, scratch_path(spark, unique=False))
    root = _FIXTURES.get(key)
    if root is None:
        root = scratch_path(spark, "dataset")
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
        write_shards(document_samples(docs), f"{root}/docs", "doc_id", rows_per_shard)
        write_shards(page_samples(pages), f"{root}/pages", "doc_id", rows_per_shard)
        _FIXTURES[key] = root
    return root
