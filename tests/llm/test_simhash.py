"""SimHash near-duplicates against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash as S
from tessera.llm.components import components

from .conftest import union_find


def brute_fp(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids, r=4):
    a = np.array(fps, dtype=np.uint64)
    pairs = [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= r) if j > i]
    root = union_find(len(a), pairs)
    least = {}
    for k, i in zip(root, ids, strict=True):
        least[k] = min(least.get(k, i), i)
    return [least[k] for k in root]


def test_query_equals_brute_force(spark, doc_rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(spark.createDataFrame(doc_rows)).collect()}
    fps = [brute_fp(t) for t in doc_rows.text]
    want = brute_components(fps, list(doc_rows.doc_id))
    assert got == {int(d): (f"{f:016x}", int(c)) for d, f, c in zip(doc_rows.doc_id, fps, want, strict=True)}


@pytest.mark.parametrize("shard_rows", [10, 400, 10**6])
def test_links_of_dense_clusters(spark, shard_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    base[1:30] = base[0]                              # a third around one fingerprint
    pts = np.repeat(base, 40)
    for _ in range(6):
        pts ^= np.where(rng.random(len(pts)) < .5, np.uint64(1) << rng.integers(0, 64, len(pts), dtype=np.uint64), np.uint64(0))
    pts = np.unique(pts)
    links = S.links(spark.createDataFrame([(int(x),) for x in pts.view(np.int64)], "fp long"), 4, shard_rows)
    at = {int(x): i for i, x in enumerate(pts.view(np.int64))}
    rows = links.collect()
    got = union_find(len(pts), [(at[r.a], at[r.b]) for r in rows])
    near = [(i, int(j)) for i in range(len(pts)) for j in np.flatnonzero(np.bitwise_count(pts ^ pts[i]) <= 4) if j > i]
    assert got == union_find(len(pts), near)


def test_tree_links_alone():
    rng = np.random.default_rng(1)
    pts = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))
    at = {int(x): i for i, x in enumerate(pts)}
    found = np.concatenate(S.tree_links(pts, 2), axis=1)
    got = union_find(len(pts), [(at[int(a)], at[int(b)]) for a, b in found.T])
    near = [(i, int(j)) for i in range(len(pts)) for j in np.flatnonzero(np.bitwise_count(pts ^ pts[i]) <= 2) if j > i]
    assert got == union_find(len(pts), near)


ODD = [(1, None, "x"), (2, "", "y"), (3, " \n\t ", None), (4, "one two", "y"), (5, "One  TWO", "z"), (None, "one two", None),
       (7, "lorem ipsum " * 30000, "q"), (7, "lorem ipsum " * 30000, "q"), (8, "ünï cödé wörds hëre tödäy", None)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, fp string").withColumn("again", F.lit(1)).withColumn("root", F.lit(2))
    docs = docs.withColumn("_keep_id", F.lit(3)).withColumn("_keep_hash", F.lit(4)).withColumn("rid", F.lit(5)).withColumn("k", F.lit(6))
    rows = S.simhash_components(docs).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert {by[i].fingerprint for i in (1, 2, 3)} == {"0" * 16} and {by[i].component_id for i in (1, 2, 3)} == {1}
    assert by[4].component_id == by[5].component_id == by[None].component_id == 4
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 7, 8]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(docs).collect() == [] and S.drop_near_duplicates(docs).collect() == []


def test_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(400)] + [(2000, 2000)]
    got = {r.id: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(1, 400)) and 2000 not in got


def test_a_shell_that_bounds_cannot_part_is_dealt(spark):
    """Thousands of fingerprints within a few bits of each other, all in one shell of one cell."""
    rng = np.random.default_rng(8)
    pts = np.unique(np.uint64(1 << 63) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 12, (1500, 2), dtype=np.uint64), axis=1))
    pts = np.unique(np.r_[pts, np.uint64(1 << 63) ^ rng.integers(0, 4096, 1500, dtype=np.uint64)])
    fps = spark.createDataFrame([(int(x),) for x in pts.view(np.int64)], "fp long")
    homes = S._shards(fps, 4, 100).where("not query").groupBy("tree", "cell", "shell", "part").count()
    assert homes.agg({"count": "max"}).first()[0] <= 160
    rows = S.links(fps, 4, 100).collect()
    at = {int(x): i for i, x in enumerate(pts.view(np.int64))}
    near = [(i, int(j)) for i in range(len(pts)) for j in np.flatnonzero(np.bitwise_count(pts ^ pts[i]) <= 4) if j > i]
    assert union_find(len(pts), [(at[r.a], at[r.b]) for r in rows]) == union_find(len(pts), near)
