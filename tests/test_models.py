"""Encoder plug-ins, the loader's error paths and the batched encoder UDF."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.models import (ConstantEncoder, EncoderSpec, HashTextEncoder, Plugin, PluginError, parse_record, plugin_class,
                            register, resolve_batch_size)
from tessera.operators.encode import apply_encoder

GOOD_MODEL = """
import os
from pathlib import Path
class ModelImpl:
    def load(self): self.bias = float(Path(__file__).with_name("weights").joinpath("bias.txt").read_text())
    def warmup(self): pass
    def batch_size(self): return 4
    def batch_wait_s(self): return 0.005
    def encode(self, batch):
        return [[self.bias + len(item.get('text') or ''), float(item['image'].mean()) if item.get('image') is not None else -1.0] for item in batch]
"""


def _model_dir(tmp_path, config=None, source=GOOD_MODEL):
    d = tmp_path / "m"
    (d / "weights").mkdir(parents=True)
    (d / "weights" / "bias.txt").write_text("0.5")
    if config is not None:
        (d / "config.json").write_text(config if isinstance(config, str) else json.dumps(config))
    if source is not None:
        (d / "model.py").write_text(source)
    return d


def test_record_defaults_and_types():
    info = parse_record('{"name": "m", "version": "2", "description": null, "more": 1}')
    assert (info.name, info.version, info.description, info.batch_size, info.batch_wait_s, info.metadata) == ("m", "2", None, 16, 0.003, {})
    for bad in ("{not json", "[1, 2]", '{"version": "1"}', '{"name": 3}', '{"name": "m", "batch_size": "many"}', '{"name": "m", "metadata": []}'):
        with pytest.raises(PluginError) as e:
            parse_record(bad)
        assert e.value.part == "config"


@pytest.mark.parametrize("config,source,part", [
    (None, GOOD_MODEL, "config"), ({"name": "m"}, None, "code"), ({"name": "m"}, "x = 1\n", "code"), ({"name": "m"}, "def broken(:\n", "code"),
    ({"name": "m"}, "import no_such_module\n", "code"), ({"name": "m"}, "class ModelImpl: pass\n", "interface"), ({"name": "m"}, "ModelImpl = 5\n", "code")])
def test_unusable_plugins(spark, tmp_path, config, source, part):
    with pytest.raises(PluginError) as e:
        register(spark, str(_model_dir(tmp_path, config, source)))
    assert e.value.part == part


def test_missing_directory(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    for path in (tmp_path / "nope", tmp_path / "file"):
        with pytest.raises(PluginError) as e:
            register(spark, str(path))
        assert e.value.part == "directory"


def test_strict_interface(tmp_path):
    path = _model_dir(tmp_path, None, "class ModelImpl:\n    def encode(self, batch): return []\n") / "model.py"
    assert plugin_class(str(path)).__name__ == "ModelImpl"
    with pytest.raises(PluginError, match="load, warmup, batch_size, batch_wait_s"):
        plugin_class(str(path), strict=True)
    assert resolve_batch_size(None, Plugin(plugin_class(str(path))())) == 16 and resolve_batch_size(7) == 7


def test_hash_encoder_is_deterministic_and_unit():
    enc = HashTextEncoder(dim=32)
    a = enc.encode(pd.DataFrame({"text": ["Hello, world! hello", None, ""]}))
    b = enc.encode(pd.DataFrame({"text": ["Hello, world! hello", None, ""]}))
    assert np.allclose(a, b)
    assert abs(np.linalg.norm(a[0]) - 1) < 1e-12 and not a[1].any() and not a[2].any()


def test_plugin_runs_where_its_directory_is_not(spark, tmp_path):
    info, spec = register(spark, str(_model_dir(tmp_path, {"name": "len"})))
    for p in (tmp_path / "m").rglob("*"):
        if p.is_file():
            p.write_text("gone")                        # only the shipped copy is left
    df = spark.createDataFrame([(1, "ab", bytearray([1, 2, 3] * 4)), (2, None, None), (3, "xyz", None)], "id long, text string, data binary")
    df = df.selectExpr("*", "2 AS h", "2 AS w", "3 AS c")
    out = apply_encoder(df, spec, text_col="text", image_cols=("data", "h", "w", "c")).orderBy("id").collect()
    assert info.name == "len" and [r.embedding for r in out] == [[2.5, 2.0], [0.5, -1.0], [3.5, -1.0]]
    assert [r.text for r in out] == ["ab", None, "xyz"]


def test_pass_through_is_exact_and_lazy(spark):
    big = (1 << 60) + 1
    df = spark.range(4000).selectExpr("id", f"IF(id % 3 = 0, NULL, id + {big}L) AS n", f"named_struct('m', IF(id % 3 = 0, NULL, id + {big}L), 's', 'x') AS meta",
                                      "CAST(id AS STRING) AS text")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    out = apply_encoder(df.join(spark.range(4000), "id"), EncoderSpec.of(ConstantEncoder), text_col="text")
    assert len(tracker.getJobIdsForGroup(None)) == before
    wrong = out.where(f"NOT (n <=> IF(id % 3 = 0, NULL, id + {big}L)) OR NOT (meta.m <=> n)").count()
    assert wrong == 0 and out.count() == 4000


def test_only_the_last_batch_of_a_partition_is_short(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(0, 1050, 1, 2).selectExpr("id", "CAST(id AS STRING) AS text", "IF(id % 7 = 0, 'no', NULL) AS skip")
        out = apply_encoder(df, EncoderSpec.of(ConstantEncoder), text_col="text", batch_size=64, batch_size_col="size", skip_col="skip").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for part in (out[out.id < 525], out[out.id >= 525]):
        used = part[part.skip.isna()]
        assert set(used["size"]) == {64, len(used) % 64} and (used["size"] == 64).sum() == len(used) // 64 * 64
        assert part[part.skip.notna()].embedding.isna().all() and (part[part.skip.notna()]["size"] == 0).all()


SHORT_MODEL = """
class ModelImpl:
    def encode(self, batch):
        return [[1.0]] * (len(batch) - 1)
"""


def test_positional_pairing_must_be_exact(spark, tmp_path):
    df = spark.createDataFrame([(i, "t") for i in range(5)], "id long, text string")
    _, spec = register(spark, str(_model_dir(tmp_path, {"name": "short"}, SHORT_MODEL)))
    with pytest.raises(Exception):
        apply_encoder(df, spec, text_col="text").collect()
    marked = apply_encoder(df, spec, text_col="text", on_error="mark").collect()
    assert all(r.embedding is None and r.error_type == "processing_error" for r in marked)


def test_constant_encoder(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    r = apply_encoder(df, EncoderSpec.of(ConstantEncoder), text_col="text").first()
    assert r.embedding == [0.1, 0.2, 0.3]


def test_failure_fanout_marks_whole_batch(spark):
    rows = [(i, i // 4, "ok" if i != 5 else "mail@x") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, b long, text string").repartition(2, "b").sortWithinPartitions("b", "id")
    spec = EncoderSpec.of(HashTextEncoder, dim=8, fail_on="@")
    out = apply_encoder(df, spec, text_col="text", on_error="mark", batch_col="b").toPandas()
    failed = set(out[out.error_type.notna()].id)
    assert failed == {4, 5, 6, 7}
