"""The sink with a manifest: attempts that do not count are in no table."""

import os

import pyarrow as pa
import pytest

from tessera.sinks.manifest import ManifestWriter, read_manifest, read_with_manifest, write_with_manifest


def test_manifest_tells_rows_and_ranges(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "lpad(cast(id as string), 4, '0') AS key", "array(cast(id as double)) AS e").repartitionByRange(5, "key")
    out = str(tmp_path / "t")
    m = write_with_manifest(df, out, "key")
    assert (m["rows"], m["low"], m["high"]) == (1000, "0000", "0999") and m["files"] == len(m["tasks"]) == 5
    assert all(os.path.getsize(f"{out}/{t['file']}") == t["bytes"] for t in m["tasks"])
    assert all(a["high"] < b["low"] for a, b in zip(m["tasks"], m["tasks"][1:], strict=False))
    assert sorted(map(tuple, read_with_manifest(spark, out, df.schema).collect())) == sorted(map(tuple, df.collect()))
    more = write_with_manifest(df.limit(10), out, "key", append=True)
    assert more["rows"] == 1010 and write_with_manifest(df.limit(7), out)["rows"] == 7
    assert write_with_manifest(df.limit(0), out, "key")["rows"] == 0 and read_with_manifest(spark, out, df.schema).count() == 0


def test_an_aborted_write_leaves_the_table_as_it_was(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.range(100).selectExpr("id", "cast(id as string) AS key")
    before = write_with_manifest(df, out, "key")
    bad = spark.range(0, 400, 1, 4).selectExpr("IF(id = 399, raise_error('no'), id) AS id", "cast(id as string) AS key")
    with pytest.raises(Exception, match="no"):
        write_with_manifest(bad, out, "key")
    assert read_manifest(out) == before and read_with_manifest(spark, out, df.schema).count() == 100


def test_repeated_attempts_count_once(spark, tmp_path):
    """Two attempts of a task write files of their own; the one whose message is committed is the table's."""
    out = str(tmp_path / "t")
    rows = pa.RecordBatch.from_pydict({"id": pa.array([1, 2, 3], pa.int64()), "key": ["a", "b", None]})
    w = ManifestWriter(out, "key", False)
    first, second, other = w.write(iter([rows])), w.write(iter([rows, rows.slice(0, 0)])), w.write(iter([]))
    assert first.file != second.file and other.file is None
    w.commit([second, other, None])
    m = read_manifest(out)
    assert (m["rows"], m["files"], m["low"], m["high"]) == (3, 1, "a", "b") and m["tasks"][0]["file"] == second.file
    assert read_with_manifest(spark, out, spark.createDataFrame([], "id long, key string").schema).count() == 3
    w.abort([first, None])
    assert not os.path.exists(f"{out}/{first.file}") and os.path.exists(f"{out}/{second.file}")
