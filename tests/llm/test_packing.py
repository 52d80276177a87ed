"""Packing: exact round trip, lower bound, odd rows."""

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing as P

from .conftest import SF


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(P.tokenizer_path())
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.none() | st.text(alphabet="aBü 　\u2003\xa0\x85…\n\t\r'.,!9漢\x00\x1c", max_size=24) | st.text(max_size=20), max_size=5))
def test_words_of_a_batch_give_the_tokenizers_ids(texts):
    words = _words()
    ids, offsets = words.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in pairwise(offsets.tolist())] == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("most", [1, 3, 7])
def test_pieces_of_lengths(most):
    lengths = np.arange(1, 30)
    row, piece, start, length = P.cut_points(lengths, most)
    for i, n in enumerate(lengths):
        mine = row == i
        assert piece[mine].tolist() == list(range(-(-n // most))) and length[mine].sum() == n and (length[mine][1:] == most).all()
        assert start[mine].tolist() == [0, *np.cumsum(length[mine])[:-1]] and 1 <= length[mine][0] <= most


_CACHE = []


def _words():
    if not _CACHE:
        _CACHE.append(P.WordIds(P.tokenizer_path()))
    return _CACHE[0]


def check(rows, texts, tok, max_len=P.MAX_LEN):
    """Pieces rebuild their documents; sequences are gapless; returns the number of sequences."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        ps = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and len(ps) == -(-len(ids) // max_len)
        at = 0
        for p in ps:
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            assert p.length == max_len or p.piece == 0
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= max_len
    return len(by_seq)


def test_query(spark, doc_rows, tok):
    rows = P.pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    n = check(rows, dict(zip(doc_rows.doc_id, doc_rows.text, strict=True)), tok)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // P.MAX_LEN)


def test_ids_and_sequences(spark, tok):
    docs = spark.createDataFrame([(1, "a b c"), (2, "x " * 30), (3, None)], "doc_id long, text string")
    packed = P.pack_documents(docs, max_len=16, with_ids=True)
    seqs = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in P.sequences(packed).collect()}
    for r in packed.collect():
        assert list(seqs[r.sequence_id][r.offset:r.offset + r.length]) == list(np.frombuffer(r.ids, "<u4"))
    texts = {1: "a b c", 2: "x " * 30, 3: ""}
    for d, t in texts.items():
        parts = sorted((r.start, r.ids) for r in packed.where(F.col("doc_id") == d).collect())
        assert list(np.frombuffer(b"".join(p[1] for p in parts), "<u4")) == [*tok.encode(t, add_special_tokens=False).ids, 0]


def test_odd_rows_and_hot_length(spark, tok, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 7)           # ranks cross buckets
    rows = [(i, "same length here") for i in range(200)] + [(900, None), (901, ""), (902, "word " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("length", F.lit(1))
    assert check(P.pack_documents(docs).collect(), dict(rows), tok) >= 5
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "q"), (5, "q")], "doc_id long, text string")
    out = P.pack_documents(twice).collect()
    assert len(out) == 4 and len({(r.sequence_id, r.offset) for r in out}) == 4


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_plan_is_exact(hist):
    lens, counts = np.array(sorted(hist), np.int64), np.array([hist[k] for k in sorted(hist)], np.int64)
    used = np.zeros(len(lens), np.int64)
    for config, times in P.plan(lens, counts, 64, rounds=4):
        assert times > 0 and sum(lens[i] for i in config) <= 64
        np.add.at(used, list(config), times)
    assert (used == counts).all()


def test_linear_program_covers():
    lens, counts = np.array([300, 700, 900, 1100, 2000]), np.array([500.0, 400, 300, 300, 50])
    x = P.solve_lp(lens, counts, 2048)
    cover = sum(v * np.bincount(list(c), minlength=5) for c, v in x.items())
    assert (cover >= counts * (1 - 1e-6)).all()
