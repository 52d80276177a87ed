"""Registered queries of the training-data operators: names, schemas, SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as e
from tessera.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"], "op2": ["doc_id", "fingerprint", "component_id"],
    "op3": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4": ["doc_id", "size", "source_size", "target", "taken"],
    "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op6": ["vec_id", "n_links", "component_id", "kept"],
    "op7": ["doc_id", "held_out", "lang_pred", "score"],
    "op8": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op9": ["doc_id", "licence"],
    "op10": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op11": ["lang", "source", "part", "item", "value", "rank"],
    "op12": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"], "op13": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


def test_one_query_for_each_operator():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(COLUMNS)
    assert set(e.queries()) >= {*queries.QUERIES, "pipeline"} and set(queries.ORACLES) < set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_first_columns(spark, name):
    df = e.queries()[name](spark, SF)
    want = COLUMNS[name.split("_")[0]]
    assert df.columns[:len(want)] == want
    assert df.count() >= 200 if name[:4] not in ("op6_", "op10", "op12") else df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(queries.ORACLES[name])
    order = sorted(rel.columns)
    want = sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rel.select(", ".join(f'"{c}"' for c in order)).fetchall())
    got = sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in e.queries()[name](spark, SF).select(*order).collect())
    assert got == want
