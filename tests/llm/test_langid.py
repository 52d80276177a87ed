"""Language identification: gradients, held-out accuracy, odd rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid as L
from tessera.llm import queries

SF_MID = "/root/testdata/sf0.01"


def test_backpropagation_equals_numeric_gradients():
    net = L.BiGru.new(["a", "b", "c"], hidden=3, seed=1)
    net.w, net.u, net.o = ([p.astype(np.float64) for p in ps] for ps in (net.w, net.u, net.o))
    net.b = net.b.astype(np.float64) + .1
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 123, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    x[3, 2] = 32
    _, grads = net.loss_and_gradients(x, y)
    for p, g in zip(net.params(), grads, strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)] + [tuple(np.argwhere(g == g.flat[np.abs(g).argmax()])[0])]:
            keep = p[at]
            p[at] = keep + 1e-5
            up = net.loss_and_gradients(x, y)[0]
            p[at] = keep - 1e-5
            down = net.loss_and_gradients(x, y)[0]
            p[at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_windows_cover_whole_texts():
    net = L.BiGru.new(["a", "b"])
    text = "abc, " * 500
    raw = L.to_bytes(text)
    sums, counted = net.window_sums(np.frombuffer(raw.ljust(-(-len(raw) // 64) * 64, b"\0"), np.uint8).reshape(-1, 64))
    assert counted.sum() == 1500                    # every letter has a label
    np.testing.assert_allclose(net.probabilities([text])[0], sums.sum(axis=0) / 1500, rtol=1e-5)


def plain_forward(net, raw):
    """Language probabilities at every byte of a window, byte by byte in Python floats."""
    def run(d, order):
        w, u, o = ([[float(v) for v in row] for row in m] for m in (net.w[d], net.u[d], net.o[d]))
        h, scores = len(u[0]), {}
        state = [0.0] * h
        for t in order:
            rec = [sum(a * b for a, b in zip(row, state, strict=True)) for row in u]
            pre = [row[raw[t]] for row in w]
            sig = lambda v: 1 / (1 + math.exp(-v))
            keep, use = [sig(pre[i] + rec[i]) for i in range(h)], [sig(pre[h + i] + rec[h + i]) for i in range(h)]
            new = [math.tanh(pre[2 * h + i] + use[i] * rec[2 * h + i]) for i in range(h)]
            state = [keep[i] * state[i] + (1 - keep[i]) * new[i] for i in range(h)]
            scores[t] = [sum(a * b for a, b in zip(row, state, strict=True)) for row in o]
        return scores
    ahead, back = run(0, range(len(raw))), run(1, range(len(raw) - 1, -1, -1))
    out = []
    for t in range(len(raw)):
        z = [a + b + float(c) for a, b, c in zip(ahead[t], back[t], net.b[:, 0], strict=True)]
        e = [math.exp(v - max(z)) for v in z]
        out.append([v / sum(e) for v in e])
    return out


def test_every_position_equals_a_plain_forward_pass():
    net = L.BiGru.new(["a", "b", "c"], hidden=5, seed=3)
    texts = ["The quick brown fox, it said: jumps 42 times over é ñ ü and so on and on, longer than one window is", "kurz", "", None, "12 %", "日本 ab"]
    got = net.probabilities(texts)
    for text, p in zip(texts, got, strict=True):
        raw, total, n = L.to_bytes(text), np.zeros(3), 0
        for at in range(0, len(raw), L.WINDOW):
            window = raw[at:at + L.WINDOW].ljust(L.WINDOW, b"\0")
            for byte, label in zip(window, plain_forward(net, window), strict=True):
                if chr(byte).isascii() and chr(byte).isalpha() or byte >= 128:
                    total, n = total + label, n + 1
        np.testing.assert_allclose(p, total / max(n, 1), atol=2e-5)


def test_held_out_accuracy(spark):
    out = queries.QUERIES["op7_language_id"](spark, SF_MID)
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == docs.count()
    judged = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.97
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_odd_rows(spark):
    rows = [(1, "the and with of that", "en", 1), (2, "der und nicht ist ein", "de", 1), (3, None, "en", 1), (4, "", "en", 1), (6, "123 %%% 4", None, 1),
            (None, "und nicht", None, 1), (7, "the of " * 40000, "en", 1), (7, "the of " * 40000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").withColumn("found", F.lit(0))
    out = L.identify(docs)
    got = out.collect()
    assert len(got) == 8 and set(out.columns) == {"doc_id", "text", "lang", "found", "lang_pred", "score"}
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (3, 4, 6)} == {"und"} and {by[i].score for i in (3, 4, 6)} == {0.0}
    assert by[1].lang_pred in ("en", "de") and by[7].lang_pred in ("en", "de")


def test_nothing_to_learn_and_empty_table(spark):
    schema = "doc_id long, text string, lang string"
    assert L.identify(spark.createDataFrame([], schema)).collect() == []
    only = L.identify(spark.createDataFrame([(1, "some text", None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in only] == [("und", 0.0)]


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 50, "en") for i in range(300)] + [(1000 + i, "copy", "de") for i in range(300)],
                                 "doc_id long, text string, lang string")
    got = L.training_sample(docs, "lang", "text", F.lit(True), per_label=40, excerpt=20)
    assert got == L.training_sample(docs.repartition(7), "lang", "text", F.lit(True), per_label=40, excerpt=20)
    assert sum(x[0] == "en" for x in got) <= 40 and sum(x[0] == "de" for x in got) <= 1 and all(len(x[1]) <= 20 for x in got)


def test_copies_do_not_crowd_out_distinct_texts(spark):
    copies = spark.range(200_000).select(F.lit("one and the same text").alias("text"))
    others = spark.range(300).select(F.format_string("another text number %d", "id").alias("text"))
    docs = copies.union(others).withColumn("lang", F.lit("en"))
    got = L.training_sample(docs, "lang", "text", F.lit(True), per_label=40)
    assert len(got) == 40 and len({t for _, t in got}) == 40
