"""Pipeline stages against brute-force versions, each on its own input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from tessera.llm import packing
from tessera.llm.common import materialise

from .test_mixing import brute as mixed_brute
from .test_mixing import words
from .test_packing import check
from .test_pii import brute as spans_of
from .test_simhash import brute_components, brute_fp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of each stage, on the small table with odd rows added."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = docs.orderBy("doc_id").first().text
    odd = [(9000, None, "en", "src0", 0), (9001, "", None, None, 0), (9002, "123 456", "en", "src1", 7), (9003, text, "en", "src2", len(text)),
           (9004, "Call +1 (555) 010-9999 or write to ann@corp.example.org today", None, None, 61), (9005, "brief", "en", None, 5)]
    cur = materialise(docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, COLUMNS)))
    out = []
    for _, stage in C.STAGES:
        nxt = materialise(stage(spark, cur, "/root/testdata/sf0.001"))
        out.append((cur, nxt))
        cur = nxt
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(before.columns == after.columns for before, after in stages[:-1])


def test_language_id_rejects_only_what_has_no_letter(stages):
    before, after = map(rows, stages[0])
    assert set(before) - set(after) == {d for d, r in before.items() if not re.search(r"[^\W\d_]", r.text or "")} >= {9000, 9001, 9002}
    assert all(r.lang is not None and (before[d].lang or r.lang) == r.lang and r.text == before[d].text for d, r in after.items())


def test_one_document_of_each_group_stays(stages):
    before, after = map(rows, stages[1])
    ids = sorted(before)
    comps = brute_components([brute_fp(before[i].text) for i in ids], ids)
    assert set(after) == {c for c in comps} and 9003 not in after
    assert all(after[i] == before[i] for i in after)


def test_personal_data_is_masked_and_clean_texts_stay(stages):
    before, after = map(rows, stages[2])
    assert before.keys() == after.keys()
    for d, r in after.items():
        found = spans_of(before[d].text)
        assert r.n_chars == (len(r.text) if found else before[d].n_chars)
        if not found:
            assert r.text == before[d].text
        else:
            assert not spans_of(r.text) and "[" in r.text
    assert after[9004].text.startswith("Call [PHONE]") and "[EMAIL]" in after[9004].text


def test_mix_takes_what_the_plain_rule_takes(stages):
    before, after = stages[3]
    want = {d: k for d, _, _, _, k in mixed_brute([(r.doc_id, r.text, r.source) for r in before.collect()])}
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += len(words(r.text))
    assert +got == +Counter(want)


def test_packing_rebuilds_every_document(stages):
    before, after = stages[4]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    tok.encode_special_tokens = True
    docs, packed = before.collect(), after.collect()
    once = Counter(r.doc_id for r in docs)
    singles = {r.doc_id: r.text for r in docs if once[r.doc_id] == 1}
    pieces = Counter(r.doc_id for r in packed)
    for r in docs:
        n = len(tok.encode(r.text, add_special_tokens=False).ids) + 1
        if once[r.doc_id] == 2 and len({x.text for x in docs if x.doc_id == r.doc_id}) == 1:
            assert pieces[r.doc_id] == 2 * -(-n // 2048)
    by_seq = {}
    for r in packed:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    only = [r for r in packed if r.doc_id in singles]
    relabelled = [r.asDict() | {"sequence_id": (r.doc_id, r.piece), "offset": 0} for r in only]
    from pyspark.sql import Row
    check([Row(**r) for r in relabelled], singles, tok)


def test_run_equals_the_stages(spark):
    got = C.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
    again = C.run(spark, "/root/testdata/sf0.001")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))


def test_empty_table_and_nulls(spark):
    cur = spark.createDataFrame([], COLUMNS)
    for _, stage in C.STAGES:
        cur = stage(spark, cur, "/root/testdata/sf0.001")
        assert cur.collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some words here", None, None, None), (1, "some words here", None, "a", None),
                                 (1, "some words here", None, "a", None)], COLUMNS).withColumn("rid", F.lit(1)).withColumn("found", F.lit("x"))
    for _, stage in C.STAGES[:-1]:
        odd = materialise(stage(spark, odd, "/root/testdata/sf0.001"))
    assert odd.columns[-2:] == ["rid", "found"] and {r.doc_id for r in odd.collect()} == {1}
