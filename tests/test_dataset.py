"""Dataset scans: merged schemas, conflicting types, shard subsets, ordinals."""

import os

import pandas as pd

from tessera.operators.samples import pack_metadata, sample_ordinal, sample_projection
import pytest

from tessera.sources.dataset import list_shards, scan_dataset, scan_shards, widest, write_shards


def _shards(tmp_path):
    os.makedirs(tmp_path / "a")
    os.makedirs(tmp_path / "b")
    pd.DataFrame({"url": ["u0", "u1"], "key": ["k0", "k1"], "x": [1, 2]}).to_parquet(tmp_path / "a/00000.parquet")
    pd.DataFrame({"url": ["u2"], "caption": ["c"], "key": ["k2"], "x": ["three"], "y": [1.5]}) \
        .to_parquet(tmp_path / "b/00001.parquet")
    return str(tmp_path)


def test_conflicting_types_fall_back_to_string_union(spark, tmp_path):
    df = scan_dataset(spark, _shards(tmp_path))
    rows = {r.key: r for r in df.collect()}
    assert rows["k0"].x == "1" and rows["k2"].x == "three" and rows["k2"].y == 1.5
    assert rows["k1"]._row == 1


def test_projection_defaults_and_ordinal(spark, tmp_path):
    df = sample_projection(scan_dataset(spark, _shards(tmp_path)))
    got = {r.key: r for r in sample_ordinal(df).collect()}
    assert got["k0"].caption is None and got["k2"].caption == "c"
    assert [got[k].ordinal for k in ("k0", "k1", "k2")] == [0, 1, 2]
    meta = pack_metadata(df).schema["metadata"].dataType.fieldNames()
    assert set(meta) == {"x", "y"}


def test_listing_and_subset(spark, tmp_path):
    root = _shards(tmp_path)
    paths = [r.path for r in list_shards(spark, root).collect()]
    assert paths == sorted(paths) and len(paths) == 2
    sub = scan_shards(spark, root, ["00001.parquet"]).collect()
    assert [r.key for r in sub] == ["k2"]


def test_numeric_conflicts_are_widened(spark, tmp_path):
    big = 2**60 + 1
    for i, (kind, v) in enumerate([("int", 3), ("bigint", big), ("smallint", 1), ("int", None)]):
        spark.createDataFrame([(i, v)], "id long, n long").selectExpr("id", f"CAST(n AS {kind}) AS n", f"CAST(id AS {'double' if i == 1 else 'bigint'}) AS f").coalesce(1).write.parquet(f"{tmp_path}/s{i}")
    df = scan_dataset(spark, str(tmp_path))
    assert dict(df.dtypes)["n"] == "bigint" and dict(df.dtypes)["f"] == "double"
    assert {r.id: r.n for r in df.collect()} == {0: 3, 1: big, 2: 1, 3: None}
    assert widest({"int", "float"}) == "double" and widest({"bigint", "string"}) == "string" and widest({"tinyint", "smallint"}) == "smallint"


def test_empty_folder_is_sparks_error(spark, tmp_path):
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        scan_dataset(spark, str(tmp_path))


def test_shard_names_beyond_five_digits(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (99_999, "b"), (100_003, "c"), (1_000_030, "d")], "id long, key string")
    root = write_shards(df, str(tmp_path / "w"), "id", 1)
    got = [(r.key, r.ordinal) for r in sample_ordinal(scan_dataset(spark, root)).orderBy("ordinal").collect()]
    assert got == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert [r.path.split("shard=")[1][:7] for r in list_shards(spark, root).collect()] == ["0000000", "0099999", "0100003", "1000030"]
