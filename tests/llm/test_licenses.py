"""Licence scans: held-out wording, planted lines, odd rows."""

import math
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses as L

SF = "/root/testdata/sf0.1"
#: the notices planted in the given documents
PLANTED = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl",
           "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "All rights reserved.": "all-rights-reserved"}


@pytest.fixture(scope="module")
def model(spark):
    return L.train(L.prose_sample(spark.read.parquet(f"{SF}/documents.parquet")))


def test_documents(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: {f for s, f in PLANTED.items() if s in r.text} for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: set(r.families) for r in L.scan(docs, model=model).collect()}
    assert got.keys() == want.keys() and sum(map(bool, want.values())) > 50
    missed, extra = sum(bool(want[d] - got[d]) for d in want), sum(bool(got[d] - want[d]) for d in want)
    assert missed <= .03 * sum(map(bool, want.values())) and extra <= 2


@pytest.mark.parametrize("text,family", [
    ("this code is licensed under the apache license version 2.0", "apache-2.0"), ("Code released under the MIT license", "mit"),
    ("This work is licensed under the GNU General Public License version 3", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit")])
def test_other_wording(model, text, family):
    assert [h[0] for h in model.scan("some prose\n\n" + text + "\nmore of it")] == [family]


@pytest.mark.parametrize("form", ["one line", "wrapped", "commented"])
def test_every_notice_is_one_hit_of_its_family(model, form):
    for family, notices in L.NOTICES.items():
        for n in notices:
            text = {"one line": n, "wrapped": textwrap.fill(n, 78), "commented": "\n".join(" * " + x for x in textwrap.wrap(n, 72))}[form]
            hits = model.scan("Some prose before it.\n\n" + text + "\n\nand more")
            assert [h[0] for h in hits] == [family], (n, hits)
            assert ("Some prose before it.\n\n" + text)[hits[0][3]:hits[0][4]] == text


def test_paragraphs():
    wrapped = "\n".join(textwrap.wrap("word " * 60, 70))
    for text in (None, "", "\n\n", "one", "one\ntwo\nthree", f"{wrapped}\n\nnext", f"a\n{wrapped}\nb", "- item one\n- item two\n1. three", wrapped + "\n* " + wrapped, "x" * 300 + "\ny"):
        found = L.paragraphs(text)
        assert [w for a, b, _ in found for w in text[a:b].split()] == [w for w in (text or "").split()]
        assert all(a < b for a, b, _ in found) and all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
    assert len(L.paragraphs(wrapped)) == 1 and len(L.paragraphs(f"{wrapped}\n\nnext")) == 2 and len(L.paragraphs("one\ntwo")) == 2 and len(L.paragraphs("- item\n- item")) == 2


def plain_scan(model, text):
    """Paragraph by paragraph in plain loops."""
    out = []
    for start, end, body in L.paragraphs(text):
        w = re.findall(r"[^\W_]+(?:[.-][0-9]+)*", body.lower())
        used = set()
        for i, a in enumerate(w):
            row = model.index.get(a, {})
            used |= {row[k] for k in ("", w[i + 1] if i + 1 < len(w) else "") if k in row}
        z = [(sum(float(model.weights[k, c]) for k in used) + float(model.weights[-1, c])) / model.temperature for c in range(len(model.families))]
        e = [math.exp(v - max(z)) for v in z]
        best = max(range(len(z)), key=lambda c: (e[c], -c))
        p = e[best] / sum(e)
        family = model.families[best]
        if family == L.UNKNOWN or p < model.threshold:
            continue
        like = 0.0
        for n in L.NOTICES[family]:
            v = re.findall(r"[^\W_]+(?:[.-][0-9]+)*", n.lower())
            mine, its = ({tuple(x[i:i + 3]) for i in range(max(1, len(x) - 2))} for x in (w, v))
            like = max(like, len(mine & its) / len(its), len(mine & its) / len(mine) if 8 <= len(w) < len(v) else 0.0)
        if like >= L.CONFIRM:
            out.append((family, p, like, start, end))
    return out


def test_scores_equal_plain_loops(spark, model):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["\n\n".join(ns) for ns in L.NOTICES.values()] + [n[:len(n) // 2] for ns in L.NOTICES.values() for n in ns]
    hits = 0
    for t in texts:
        got, want = model.scan(t), plain_scan(model, t)
        assert [g[:1] + g[3:] for g in got] == [w[:1] + w[3:] for w in want]
        assert all(abs(g[1] - w[1]) < 1e-9 and abs(g[2] - w[2]) < 1e-12 for g, w in zip(got, want, strict=True))
        hits += len(got)
    assert hits > 20


@pytest.mark.parametrize("text", ["The driver showed a license at the bar.", "She reserved all of the seats.", "Version 2.0 is out.", "permission to speak", "mit", "", None,
                                  "license the under released MIT version general", "rights"])
def test_no_licence(model, text):
    assert model.scan(text) == []


def test_training_is_repeatable_and_calibrated(model):
    a, b = L.train(["the quiet sea", "a license to sing"], rounds=20), L.train(["the quiet sea", "a license to sing"], rounds=20)
    assert (a.weights == b.weights).all() and .3 <= model.threshold <= .9 and .1 < model.temperature < 6


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (4, "x " * 200000), (None, "All rights reserved."), (5, "a\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."),
            (5, "a\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("notices", F.lit(1)).withColumn("licence", F.lit("x"))
    out = L.scan(docs, model=model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and {by[i].licence for i in (1, 2, 3, 4)} == {"unknown"}
    assert by[None].families == ["all-rights-reserved"] and by[5].families == ["cc-by-nc", "mit"]
    n = by[5].notices[0]
    assert rows[5][1][n.start:n.end] == "Released under the MIT License."
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_paragraph_takes_part_in_training(spark):
    rows = [(i, f"A quiet line {i} of the sea, not to be copied.\n\nAnother use of it, number {i}.\n\nReleased under the MIT License.") for i in range(400)]
    docs = spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id long, text string").repartition(3)
    forms = {r.form: r.n for r in L.prose_forms(docs).collect()}
    assert sum(forms.values()) == 800                       # each distinct paragraph but the notice, whatever its place
    model = L._blank()
    for r in rows[:5]:
        for _, _, body in L.paragraphs(r[1])[:2]:
            w = L.words(body)
            assert L.reduced(w, model.index) in forms and model.features(L.reduced(w, model.index).split(" ")) == model.features(w)
    a, b = L.fit(docs, rounds=20, block=2), L.fit(docs.repartition(5), rounds=20, block=2)
    assert (a.weights == b.weights).all() and (a.temperature, a.threshold) == (b.temperature, b.threshold)
    got = {r.doc_id: r.licence for r in L.scan(docs, model=L.fit(docs, block=2)).collect()}
    assert got == {i: "mit" for i in range(400)} | {400: "unknown", 401: "unknown"}
