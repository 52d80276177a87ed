import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=10, top=10):
    """``rows`` of (text, lang, source)."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang or ""].add(source or "")
        df[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def share(names):
            total = sum(counts[lang, s][t] for s in names for t in kept) + 2 * len(kept)
            return {t: 1 + 10 ** 9 * (sum(counts[lang, s][t] for s in names) + 2) // total for t in kept}

        def differ(p, q):
            return (p - q) ** 2 // (p + q)
        p, q = {s: share([s]) for s in sources}, share(sources)
        for s in sources:
            pairs = sorted(((-sum(differ(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-differ(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZé日 0[`{@\n\x00\x7f", max_size=12)), max_size=8))
def test_terms_of_a_batch(texts):
    terms, row = divergence.batch_terms(pa.array(texts, pa.string()))
    assert list(zip(terms.to_pylist(), row.tolist(), strict=True)) == [(t, i) for i, x in enumerate(texts) for t in TERM.findall((x or "").translate(LOWER))]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10 ** 14), st.integers(0, 10 ** 15))
def test_share_is_exact(count, more):
    total = count + more + 2
    assert int(divergence.share(np.array([count]), np.array([total]))[0]) == 1 + 10 ** 9 * (count + 2) // total


@pytest.mark.parametrize("stripes,shard_terms", [(1 << 20, 20_000), (40, 3), (1, 1)])
def test_spills_and_shards_change_nothing(spark, stripes, shard_terms):
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "GAMMA", "éÉ", "日本", "x1y", "d", "Zz"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 9))), ["en", "de", None, ""][int(rng.integers(4))], [None, "s1", "s2", "S3", "é"][int(rng.integers(5))])
            for _ in range(160)]
    rows += [(None, "en", "s1"), ("", "fr", None), ("lone", "fr", "s9"), ("Alpha " * 400, "en", "hot")] + [("beta alpha", "en", "hot")] * 80
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    got = divergence.audit(docs, min_docs=3, top_terms=4, stripes=stripes, shard_terms=shard_terms)
    assert rows_of(got) == plain(rows, 3, 4)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIR_CELLS", 50)
    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice(list("abcdefg"), 5)), "en", f"s{i % 23}") for i in range(200)]
    assert rows_of(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"))) == plain(rows)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([("a b", "en", "x", "t", 1, 2, 3)], "text string, lang string, source string, term string, df int, total int, shard int")
    assert rows_of(divergence.audit(docs, min_docs=1)) == plain([("a b", "en", "x")], 1)
    out = divergence.audit(docs.limit(0))
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]
