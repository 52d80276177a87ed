"""PII: base spans against Python's re, disclosure against a plain count."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import pii as P
from tessera.llm.common import materialise

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(x) > 255 for x in v.split("."))) or (kind == "card" and not (14 <= len(d) <= 19 and luhn(d))) or (
                    kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


PIECES = ["a.b@c-d.example.org", "x@y", "@", "a@b.c_x@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111-1",
          "5500005555555559", "49927398716000", "+1 (555) 010-9999", "+12", "+49.30.1234567 ", "+1 2345678901234567", " ", "-", "--", "7", "é漢", "𝄞", "\n", "words here ", ".", "+", "00000000000000"]


def test_base_spans_equal_python(spark):
    cases = []

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(PIECES) | st.text(alphabet="0123456789 -+.@a(", max_size=8), max_size=9).map("".join))
    def gather(text):
        cases.append(text)
    gather()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in docs.select("doc_id", P.spans_text(P.base_spans(F.col("text"))).alias("s")).collect()}
    assert {i: got[i] for i in got if got[i] != brute(cases[i])} == {}


def test_base_columns_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = P.find(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = brute(text[r.doc_id])
        kinds = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k, _ in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        extra = set(r.spans.split(",")) - set(want.split(","))
        assert set(want.split(",")) <= {*r.spans.split(","), ""} and all(s.startswith("term:") for s in extra - {""}) and len(extra - {""}) == r.n_terms


CORPUS = [(1, "Please ask Quillfeather about it, write to ann@corp.example.org soon"), (2, "the famous Quillfeather at ann@corp.example.org again"),
          (3, "old Quillfeather says ANN@corp.example.org is right"), (4, "nobody here, about the word soon"), (5, "please write to bob@corp.example.org again"),
          (6, "please write about the bob@corp.example.org word soon"), (7, "the soon about again please write here"), (8, "Quillfeather without any address")] + [
          (100 + i, f"the about please write soon again here word {i}") for i in range(60)]


def spark_hash(word):
    return (xxhash.xxh64_intdigest(word.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)


def plain_disclosures(corpus, least=P.GENERALISE):
    """(entity, term) -> disclosure, by sets of different texts."""
    texts, words, has = sorted({t or "" for _, t in corpus}), {}, defaultdict(set)
    for t in texts:
        rest = t
        for s in brute(t).split(","):
            if s:
                kind, a, b = s.split(":")
                value = t[int(a):int(b)]
                has[kind + ":" + (value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value))].add(t)
                rest = rest[:int(a)] + " " * (int(b) - int(a)) + rest[int(b):]
        seq = ["", "", *(w.lower() for w in re.findall(r"[^\W_]{3,}", rest)), "", ""]
        at = defaultdict(list)
        for i in range(2, len(seq) - 2):
            at[seq[i]].append([spark_hash(seq[i + d]) for d in (-2, -1, 1, 2)])
        words[t] = {w: [min(x) for x in zip(*rows, strict=True)] for w, rows in at.items()}
    df = Counter(w for t in texts for w in {w.lower() for w in re.findall(r"[^\W_]{3,}", t)})
    out = {}
    for e, inside in has.items():
        for w in {w for t in inside for w in words[t]}:
            both = [words[t][w] for t in inside if w in words[t]]
            if len(both) < 2 or sum(len(set(x)) - 1 for x in zip(*both, strict=True)) < 3 * (len(both) - 1) or len(inside) == len(texts):
                continue
            d = math.log2(len(both) * len(texts) / (df[w] * len(inside))) / -math.log2(len(inside) / len(texts))
            if d >= least:
                out[e, w] = d
    return out


def strongest(spark, corpus, least):
    texts = P._texts(spark.createDataFrame(corpus, "doc_id long, text string"), "text")
    return {r.term: r.disclosure for r in P.disclosing_terms(texts, P.texts_with_entities(texts), least=least).collect()}


def by_term(pairs):
    out = {}
    for (_, w), d in pairs.items():
        out[w] = max(d, out.get(w, -9.0))
    return out


@pytest.mark.parametrize("least", [0.75, 0.3])
def test_disclosure_equals_plain_counts(spark, least):
    copies = [(1000 + i, CORPUS[0][1]) for i in range(200)]
    for corpus in (CORPUS, CORPUS + copies, LONG, LONG + CORPUS):
        got, want = strongest(spark, corpus, least), by_term(plain_disclosures(corpus, least))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert strongest(spark, CORPUS, least)["quillfeather"] > .85


def test_disclosure_equals_plain_counts_on_random_texts(spark):
    import random

    deal = random.Random(7)
    people = [f"p{i}@ex.example.org" for i in range(6)] + ["10.0.0.7", "+1 555 010 9999"]
    names = [f"name{i}" for i in range(30)]
    corpus = []
    for i in range(300):
        who = deal.randrange(8)
        text = " ".join(deal.choice(["the", "and", "of", "word", *names[:3]]) for _ in range(6))
        if i % 3 == 0:
            text += f" {names[3 + who * 3 + deal.randrange(3)]} {deal.choice(names)} {people[who]} {deal.choice(names)} " + deal.choice(["today", "here", names[9]])
        corpus.append((i, text))
    for least in (0.75, 0.2):
        got, want = strongest(spark, corpus, least), by_term(plain_disclosures(corpus, least))
        assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_disclosing_terms_are_masked(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id long, text string").withColumn("_rid", F.lit(5)).withColumn("n_chars", F.length("text"))
    out = {r.doc_id: r for r in P.find(docs).collect()}
    assert out[1].n_terms == 1 and "term:11:23" in out[1].spans.split(",")
    assert out[8].spans == "term:0:12" and out[5].n_terms == 0       # it tells as much without an address; common words reveal nothing
    safe = P.sanitise(docs, length_col="n_chars")
    assert safe.columns == docs.columns
    rows = {r.doc_id: r for r in safe.collect()}
    assert "Quillfeather" not in rows[1].text and "[EMAIL]" in rows[1].text and rows[8].text == " without any address"
    clean = [i for i, t in CORPUS if "@" not in t and "Quillfeather" not in t]
    assert all(rows[i].text == dict(CORPUS)[i] for i in clean)
    assert all(r.n_chars == len(r.text) for r in rows.values())
    general = {r.doc_id: r.text for r in P.sanitise(docs, remove=2.0).collect()}
    assert general[1].startswith("Please ask [NAME] about")


def test_copies_prove_nothing(spark):
    docs = spark.createDataFrame([(i, "call Zebulon at zed@a.example.com now") for i in range(9)] + [(50 + i, "call at now") for i in range(50)], "doc_id long, text string")
    assert P.find(docs).agg(F.sum("n_terms")).first()[0] == 0


def test_copies_hide_nothing(spark):
    corpus = CORPUS + [(1000 + i, CORPUS[0][1]) for i in range(200)]
    a, b = ({r.doc_id: r.spans for r in P.find(spark.createDataFrame(c, "doc_id long, text string")).collect()} for c in (CORPUS, corpus))
    assert all(b[i] == a[i] for i in a) and all("term:11:23" in b[1000 + i] for i in range(200))


def test_near_copies_prove_nothing(spark):
    import random

    deal = random.Random(2)
    body = "today everybody should call Zebulon Harrowgate about the whole matter at zed@a.example.com now "

    def edit(i):
        parts = body.split(" ")
        for k in range(len(parts)):
            if "@" not in parts[k] and deal.random() < .15:
                parts[k] = f"x{i}y{k}"
        return " ".join(parts) + f"version {i}"
    corpus = [(i, edit(i)) for i in range(60)] + [(100 + i, f"call about the matter at now {i}") for i in range(50)]
    assert P.find(spark.createDataFrame(corpus, "doc_id long, text string")).agg(F.sum("n_terms"), F.sum("n_email")).first()[:2] == (0, 60)


def test_lists_of_addresses_in_versions_make_no_product(spark):
    import random

    lines = [f"User{i}name user{i}@corp.example.org" for i in range(1500)]
    other = random.Random(3).sample(lines, len(lines))
    corpus = [(1, "\n".join(lines)), (2, "\n".join(other))] + [(10 + i, f"the word here {i}") for i in range(40)]
    texts = P._texts(spark.createDataFrame(corpus, "doc_id long, text string"), "text")
    found = materialise(P.texts_with_entities(texts))
    classes = P.entity_classes(found)
    terms = P.class_terms(found, classes)
    assert classes.count() == 2 and terms.count() == 2 * 1500 and terms.join(classes, "key").count() == 2 * 1500
    assert P.find(spark.createDataFrame(corpus, "doc_id long, text string")).where("doc_id < 3").agg(F.sum("n_terms")).first()[0] > 2900


def test_columns_with_internal_names(spark):
    names = ["key", "text_", "base", "words", "added", "hit", "_text", "_rid", "term", "class"]
    docs = spark.createDataFrame(CORPUS, "doc_id long, text string")
    wide = docs.withColumns({c: F.lit(c) for c in names})
    a = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    out = P.sanitise(wide)
    assert out.columns == wide.columns and {r.doc_id: r.text for r in out.collect()} == a and out.where(" and ".join(f"{c} = '{c}'" for c in names)).count() == len(a)
    assert sorted(map(str, P.find(wide).collect())) == sorted(map(str, P.find(docs).collect()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "9" * 100000), (4, "x." * 50000 + "@"), (5, "a@b.cc " * 5000), (None, "ip 10.0.0.1"), (7, "+1 555 010 9999"), (7, "+1 555 010 9999")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("_base", F.lit(2))
    out = P.find(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(by[i].base_sha256 == empty and by[i].spans == "" for i in (1, 2, 3, 4))
    assert by[5].n_email == 5000 and by[5].spans.split(",")[4999] == f"email:{7 * 4999}:{7 * 4999 + 6}" and by[None].n_ip == 1 and by[7].n_phone == 1
    texts = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert texts[1] is None and texts[5] == "[EMAIL] " * 5000 and texts[None] == "ip [IP]" and texts[7] == "[PHONE]"
    schema = "doc_id long, text string"
    assert P.find(spark.createDataFrame([], schema)).collect() == [] and P.sanitise(spark.createDataFrame([], schema)).collect() == []


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = P.find(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


FAR = " the about please write soon again here word" * 5
LONG = [(1, f"Please ask Quillfeather{FAR} ann@corp.example.org soon{FAR} and Quillfeather said"), (2, f"the ann@corp.example.org again{FAR} that famous Quillfeather came back"),
        (3, f"old Quillfeather says{FAR} bob@corp.example.org is right"), (4, f"about the word{FAR} soon")] + CORPUS[-60:]


def test_terms_are_taken_from_whole_documents_and_masked_all_over_them(spark):
    docs = spark.createDataFrame(LONG, "doc_id long, text string")
    n = len(LONG)
    assert abs(strongest(spark, LONG, .75)["quillfeather"] - math.log2(2 * n / (3 * 2)) / -math.log2(2 / n)) < 1e-9
    safe = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    before = dict(LONG)
    assert [safe[i].count("Quillfeather") for i in (1, 2, 3)] == [0, 0, 0] and safe[1].count("[NAME]") == 2
    assert safe[1] == before[1].replace("Quillfeather", "[NAME]").replace("ann@corp.example.org", "[EMAIL]")
    assert safe[4] == before[4]


def test_positions_stay_behind_overlapping_and_glued_spans(spark):
    text = "漢字語ann@corp.example.org +1 555 010 9999, 1.2.3.4.5 tail 4111 1111 1111 1111 ending"
    words = P.texts_with_entities(P._texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text")).first().words
    assert [text[w.start:w.end].lower() for w in words] == [w.term for w in words] == ["漢字語", "tail", "ending"]
