"""Driver contract: entry, query registry and oracle names."""

import __spark_entry__ as e
from tessera import catalog


def test_registry_and_oracles_line_up():
    qs, ors = e.queries(), e.oracle_sql()
    assert set(ors) <= set(qs)
    assert set(catalog.queries()) <= set(qs) and set(catalog.queries()) == set(catalog.oracles())
    assert len(catalog.queries()) >= 60


def test_entry_runs_on_smoke_data(spark):
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"key", "url", "n_dims", "norm"} <= set(df.columns)


def test_every_query_runs_on_smoke_data(spark):
    for name in catalog.queries():
        df = e.queries()[name](spark, "/root/testdata/sf0.001")
        assert df.count() >= 0, name
