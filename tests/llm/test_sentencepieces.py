import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import sentencepieces as sp
from tessera.llm.words import WordBook, offsets_of, slices

from .conftest import SF

ODD = [None, "", " ", "a", " a", "a  b ", "\n", "x\0y", "▁a", "  ", "▁▁ ▁", "a▁ b", "café\t日本😀", "<s></s><0x0A>", " " * 40 + "x" + " " * 17,
       "a" * 3000, "\n\n \n", "é​�", "ab" * 500 + " " + "ba" * 700]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


@pytest.fixture(scope="module")
def model():
    return sp.PieceModel.load(sp.model_path())


def ids_of(model, texts):
    ids, offsets = sp.encode_batch(pa.array(texts, pa.string()), model, WordBook(model.encode_words, 1000), True)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_odd_texts_equal_the_library(model, library):
    assert ids_of(model, ODD) == [library.encode(t or "", add_eos=True) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab e▁\nthing12é日", max_size=40)), max_size=5))
def test_any_texts_equal_the_library(model, library, texts):
    texts = [t for t in texts if not any("\ud800" <= c <= "\udfff" for c in t)]
    got = ids_of(model, texts)
    assert got == [library.encode(t, add_eos=True) for t in texts]
    offsets = offsets_of(np.array([len(g) for g in got], np.int64))
    assert model.decode(np.array([i for g in got for i in g], np.int64), offsets).to_pylist() == [library.decode(g) for g in got]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999), st.sampled_from([0, 1, 2, 28705, 259])), max_size=12), max_size=6))
def test_any_ids_decode_as_in_the_library(model, library, rows):
    offsets = offsets_of(np.array([len(r) for r in rows], np.int64))
    assert model.decode(np.array([i for r in rows for i in r], np.int64), offsets).to_pylist() == [library.decode(r) for r in rows]


def plain_merges(pieces, scores, word):
    """Merge by merge: highest score, then leftmost."""
    score, parts = dict(zip(pieces, scores, strict=True)), list(word)
    while True:
        found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
        if not found:
            return parts
        _, i = min(found)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_any_order_of_scores(data):
    """Scores of any order and with ties, as no trained model has them."""
    longer = data.draw(st.lists(st.text(alphabet="▁abc", min_size=2, max_size=4), unique=True, min_size=1, max_size=12))
    pieces = ["▁", "a", "b", "c", *longer]
    scores = [float(data.draw(st.integers(-4, 0))) for _ in pieces]
    model = sp.PieceModel([*pieces, *(f"<0x{i:02X}>" for i in range(256))], [*scores, *[0.0] * 256], [sp.NORMAL] * len(pieces) + [sp.BYTE] * 256)
    words = data.draw(st.lists(st.text(alphabet="abc▁", max_size=14), min_size=1, max_size=5))
    ids, offsets = model.encode_words(words)
    got = [[model.pieces[i] for i in ids[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [plain_merges(pieces, scores, "▁" + w) for w in words]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in range(50)])], ["t"])
    parts = list(slices(batch.slice(3, 40), 0, most=60))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()[3:43]
    assert max(sum(len(t or "") for t in p.column(0).to_pylist()) for p in parts if p.num_rows > 1) <= 60


def test_query_on_whole_documents(spark, library):
    from tessera.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_sentencepiece_digests"](spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_nulls_repeated_rows_clashing_names_and_an_empty_table(spark, library):
    rows = [(None, "a b", 1, "x"), (1, None, 2, "y"), (1, "", 3, "z"), (2, "a b", 4, "w"), (2, "a b", 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids int, decoded string")
    out = sp.encode(docs, with_decoded=True).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in out) == sorted(
        (str(i), library.encode(t or "", add_eos=True), t or "") for i, t, _, _ in rows)
    assert sp.encode(docs.limit(0)).count() == 0 and sp.digests(docs.limit(0)).count() == 0
    assert [r.ids for r in sp.encode(docs.where("text = ''"), end=False).collect()] == [[]]


def test_decode_keeps_rows_and_columns(spark, library):
    rows = spark.createDataFrame([(1, [264, 287, 2], "k"), (2, None, "l"), (3, [], None), (4, [200, 13], "m")], "n int, ids array<int>, text_ string")
    assert [tuple(r) for r in sp.decode(rows).orderBy("n").collect()] == [
        (1, [264, 287, 2], "k", library.decode([264, 287, 2])), (2, None, "l", None), (3, [], None, ""), (4, [200, 13], "m", library.decode([200, 13]))]
    with pytest.raises(Exception, match="an id that the model does not have"):
        sp.decode(spark.createDataFrame([([40000],)], "ids array<int>")).collect()
