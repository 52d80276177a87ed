"""Bottom-k sketches against exact sets; successors and edits against a plain reading."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints as P

from .conftest import SF


def hashes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    sh = [" ".join(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] * bool(w)
    return {hashlib.md5(s.encode()).hexdigest()[:12] for s in sh}


def brute(rows):
    """(doc_id, text) with distinct ids -> doc_id: (n_chars, sha, fingerprint, near_edited, near_next)."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        e = t[:len(t) - m] + nxt[:m]
        k = [sorted(hashes(x))[:128] for x in (t, e, nxt)]

        def near(b, a=k[0]):
            u = sorted({*a, *b})[:128]
            return len({*u} & {*a} & {*b}) / len(u) if u else 1.0
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(k[0]), near(k[1]), near(k[2]))
    return out


@pytest.mark.parametrize("bucket_rows", [3, 2000])
def test_query_equals_brute_force(spark, doc_rows, bucket_rows, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket_rows)
    got = P.fingerprint_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want = brute(list(zip(doc_rows.doc_id.tolist(), doc_rows.text, strict=True)))
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got} == want


def test_estimates_and_merging(spark):
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(1000, 6000))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    r = df.select(P.resemblance(F.col("a"), F.col("b")).alias("j"), P.containment(F.col("a"), F.col("b")).alias("c"),
                  P.distinct_shingles(F.col("a")).alias("n"), P.merge(F.col("a"), F.col("b")).alias("m")).first()
    A, B = hashes(a), hashes(b)
    assert abs(r.j - len(A & B) / len(A | B)) < .13 and abs(r.c - len(A & B) / len(A)) < .25 and abs(r.n / len(A) - 1) < .3
    assert r.m == sorted(A | B)[:128]
    parts = spark.createDataFrame([("k", t) for t in (a, b, a, "")] + [("e", "")], "key string, t string").select("key", P.sketch(F.col("t")).alias("sketch"), F.lit(1).alias("h"))
    merged = {x.key: x.sketch for x in P.merge_parts(parts, ["key"]).collect()}
    assert merged == {"k": sorted(A | B)[:128], "e": []}


def test_odd_rows(spark):
    long = "lorem ipsum dolor " * 40000
    rows = [(1, None), (2, ""), (3, "one"), (4, long), (5, "ünï 漢字 a b c d e f"), (5, "ünï 漢字 a b c d e f"), (None, "x y z"), (10**15, "far away id"), (6, " \t\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("copy", F.lit(2)).withColumn("bucket", F.lit("b"))
    out = P.fingerprint_documents(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[1].n_chars == 0 and by[1].fingerprint == "" and by[2].near_next == 1.0 and by[3].near_next == 0.0
    assert by[None].n_chars == 5 and by[10**15].near_next == by[10**15].near_next and len({r.fingerprint for r in out if r.doc_id == 5}) == 1
    assert by[None].edited_sha256 == hashlib.sha256(("x y " + "f").encode()).hexdigest()      # the last row is followed by the first


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert P.fingerprint_documents(spark.createDataFrame([], schema)).collect() == []
    r = P.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], schema)).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


def test_plan_has_no_python(spark):
    plan = P.fingerprint_documents(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
