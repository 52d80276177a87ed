"""Mixing against a plain reading of the rules."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing as M

from .conftest import SF


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    """(doc_id, text, source) -> list of (doc_id, size, source_size, target, taken)."""
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += len(words(t))
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    target = dict(zip(order, M.shares([total[s] for s in order]), strict=True))
    out = []
    for s in order:
        at = 0
        for d, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), len(words(r[1])))):
            n, whole = len(words(t)), int(target[s])
            got = sum(max(0, min(e * total[s] + at + n, whole) - e * total[s] - at) for e in (0, 1))
            out.append((d, n, total[s], target[s], got))
            at += n
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=12))
def test_shares_equal_repeated_resharing(sizes):
    w = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
    left, target, free = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free and left > 1e-9:
        level = left / sum(w[i] for i in free)
        over = {i for i in free if level * w[i] > 2 * sizes[i]}
        for i in over or free:
            target[i] = 2.0 * sizes[i] if over else level * w[i]
            left -= target[i]
        free -= over or free
    assert np.allclose(target, M.shares(sizes), rtol=1e-9, atol=1e-6)


def test_points_are_golden_and_even():
    i = np.arange(10**5)
    assert np.allclose(M.point(i), (i * ((5 ** .5 - 1) / 2)) % 1, atol=1e-9)
    for n in (10, 1000, 10**5):
        assert abs((M.point(np.arange(n)) < .3).sum() - .3 * n) < 6


def test_schedule_names_each_block_once_and_reaches_targets(spark):
    targets = [12345.6, 10.0, 0.0, 70000.0]
    rows = M.schedule(spark, targets, block_words=100, chunk=64).collect()
    assert len({(r.sid, r.block) for r in rows}) == len(rows)
    got = Counter()
    for r in rows:
        got[r.sid] += r.words
    assert [got[i] for i in range(4)] == [12345, 10, 0, 70000]
    slots = [r.slot for r in rows if r.slot < sum(map(int, targets)) // 100]
    assert len(slots) == len(set(slots))


@pytest.mark.parametrize("block", [7, 2048])
def test_query_equals_brute_force(spark, doc_rows, block, monkeypatch):
    monkeypatch.setattr(M.take, "__defaults__", ("", block))
    got = sorted(tuple(r) for r in M.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    want = sorted(brute(list(zip(doc_rows.doc_id.tolist(), doc_rows.text, doc_rows.source, strict=True))))
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


ROWS = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "one two three four", None), (None, "q r", "y"), (5, "z " * 50000, "é"),
        (6, "t u", "x"), (6, "t u", "x"), (7, "solo", "Z")]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("rid", F.lit(3)).withColumn("size", F.lit("s")).withColumn("sid", F.lit(0))
    got = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in M.mix(docs).collect())
    assert got == Counter((d, n, s, round(t, 6), k) for d, n, s, t, k in brute(ROWS))
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    out = Counter()
    for r in mixed.collect():
        out[r.doc_id] += len(words(r.text))
    want = Counter()
    for d, _, _, _, k in brute(ROWS):
        want[d] += k
    assert +out == +want


def test_a_third_of_all_rows_with_one_id(spark):
    rows = [(None if i % 3 else i, f"w{i} " * (1 + i % 7), f"s{i % 2}") for i in range(600)] + [(5, "the same row", "s0")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = M.mix(docs).collect()
    assert len(out) == len(rows) and sum(r.size for r in out) == sum(len(words(t)) for _, t, _ in rows)
    want = {(s, w): sum(min(max(int(t) - e * n, 0), n) for e in (0, 1)) for s, w, n, t in {(0, 0, r.source_size, r.target) for r in out}}
    by_source = Counter()
    for r in out:
        by_source[r.source_size, r.target] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert {k: int(k[1]) for k in by_source} == dict(by_source) and want


def test_row_keys_without_a_copy(spark, tmp_path):
    from tessera.llm import common

    spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    for docs, copied in ((scan, False), (scan.where("doc_id > 1").withColumn("x", F.lit(1)), False), (scan.union(scan), True), (scan.join(scan.select("doc_id"), "doc_id"), True),
                         (scan.withColumn("y", F.explode(F.array(F.lit(1), F.lit(2)))), True)):
        out = common.numbered(docs, "key")
        assert out.columns == [*docs.columns, "key"] and out.select("key").distinct().count() == docs.count()
        assert common._is_scan(docs) is not copied
        assert sorted(map(str, out.collect())) == sorted(map(str, out.repartition(2).collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(docs).collect() == [] and M.mixed_documents(docs).collect() == []
    blank = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert [tuple(r) for r in M.mix(blank).collect()] == [(1, 0, 0, 0.0, 0)]
