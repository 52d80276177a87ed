"""Toxicity: the grammar, its composition, held-out quality, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm import toxicity as T


SPOKEN = {T.INSULT: {("waste", "of", "space"): 2.0, ("of", "space"): 1.5}, T.THREAT: {("watch", "your", "back"): 2.0}}


def test_composition_equals_one_after_the_other():
    parts = [T.insults(SPOKEN[T.INSULT]), T.threats(SPOKEN[T.THREAT]), T.negation(), T.reported(), T.directed()]
    whole, machine = T.grammar(SPOKEN[T.INSULT], SPOKEN[T.THREAT]), T.Machine(T.grammar(SPOKEN[T.INSULT], SPOKEN[T.THREAT]))
    plain = [(k, None, 1.0 if k in (T.INSULT, T.THREAT) else 0.0) for k in range(T.AIMED)]
    words = [(T.TARGET, "your", 0.0), *((T.OTHER, w, 0.0) for w in ("waste", "of", "space", "watch", "back"))]
    deal = np.random.default_rng(0)
    cases = [*itertools.product(plain, repeat=3), *([(plain + words)[int(i)] for i in deal.integers(0, len(plain) + len(words), 12)] for _ in range(2000))]
    for symbols in cases:
        step = list(symbols)
        for p in parts:
            state, out = p.start, []
            for x in step:
                state, y = p.step(state, x)
                out.append(y)
            step = out
        state, at, got, fast = whole.start, 0, [], []
        for x in symbols:
            state, y = whole.step(state, x)
            got.append(y)
            at, y = machine.step(at, x)
            fast.append(y)
        assert got == fast == step


def plain_features(text, model):
    """Clause by clause and rule by rule, by looking back and forth over words."""
    spoken = {k: {tuple(s.split()): T.PRIOR for s in v} for k, v in T.SEQUENCES.items()}
    spoken["insult"] |= {tuple(p.split()): w for p, w in model.pairs.items()}
    clauses, cur = [], []
    for token in text.lower().replace("\n", " \ue000 ").split():
        line = token == "\ue000"
        cur.append("" if line else T.TOKEN_ENDS.sub("", token))
        if line or T.CLOSING.search(token):
            clauses.append(cur)
            cur = []
    clauses += [cur] if cur else []
    sums, matched, heaviest = dict.fromkeys(T.KINDS, 0.0), 0, 0.0
    for c in clauses:
        kind, weight, aimed = [], [], [False] * len(c)
        for w in c:
            x = model.insults.get(w)
            if x is None:
                x = max((model.stems[w[:n]] for n in T.STEMS if w[:n] in model.stems and len(w) >= n), default=None)
            lists = [k for k, v in T.WORDS.items() if w in v.split()]
            kind.append("insult" if x is not None else lists[-1] if lists else "other")
            weight.append(T.PRIOR if x is None else x)
        def ending(i, seqs):  # noqa: E306
            fits = [s for s in seqs if i + 1 >= len(s) and tuple(c[i + 1 - len(s):i + 1]) == s]
            return max(fits, key=len) if fits else None
        first = list(kind)
        for i in range(len(c)):
            if (s := ending(i, spoken["insult"])) is not None:
                first[i], weight[i] = "insult", spoken["insult"][s]
        kind = list(first)
        for i in range(len(c)):
            if (s := ending(i, spoken["threat"])) is not None:
                kind[i], weight[i] = "threat", spoken["threat"][s]
        seen = list(kind)
        used = set()
        for i in range(len(c)):
            near = lambda what, reach, end: [j for j in range(max(0, end - reach), end) if seen[j] == what]
            if seen[i] == "target":
                verbs = [j for j in near("verb", 2, i) if near("modal", 4, j) and not any(k in used for k in range(j + 1, i))]
                if verbs:
                    kind[i], aimed[i] = "threat", True
                    used.add(i)
            elif seen[i] == "ruin" and near("modal", 4, i) and near("target", 4, i):
                kind[i] = "threat"
        total = 0.0
        for i in range(len(c)):
            if kind[i] not in ("insult", "threat"):
                continue
            before = [j for j in range(max(0, i - 3), i) if kind[j] == "negation"]
            w = weight[i]
            if before:
                name = "negated "
            elif "report" in kind[:i]:
                name = "reported "
            else:
                target = [j for j in range(max(0, i - 4), i) if kind[j] == "target" or aimed[j] and plain_name(c, kind, j) == "directed "]
                ahead = next((j for j in range(i + 1, min(len(c), i + 3)) if kind[j] == "target" or kind[j] in ("insult", "threat") and plain_name(c, kind, j) in ("", "directed ")), None)
                follows = ahead is not None and kind[ahead] == "target"
                name = "directed " if target or aimed[i] or follows else ""
            sums[name + kind[i]] += w
            total += w
        matched, heaviest = matched + (total > 0), max(heaviest, total)
    if not matched:
        return np.zeros(len(T.FEATURES))
    return np.r_[np.log1p([sums[k] for k in T.KINDS]), np.log1p(matched), matched / len(clauses), heaviest]


def plain_name(c, kind, j):
    if any(kind[i] == "negation" for i in range(max(0, j - 3), j)):
        return "negated "
    return "reported " if "report" in kind[:j] else "directed "


def test_scores_equal_a_plain_reading_of_the_rules():
    model = T.Toxicity({"blarg": 3.0}, {"grump": 2.5}, {"quiet sea": 1.7})
    pool = ["you", "not", "said", "idiot", "kill", "will", "find", "regret", "waste", "of", "space", "watch", "your", "back", "be", "put", "down", "a", "the", "sea", "quiet",
            "grumpy", "blarg", "them", "make", "suffer", "idiot.", "you,", "\n", "go"]
    deal = np.random.default_rng(5)
    for _ in range(4000):
        text = " ".join(pool[int(i)] for i in deal.integers(0, len(pool), int(deal.integers(1, 14))))
        assert np.allclose(model.features(text), plain_features(text, model)), text


def kinds(text, model=None):
    x = (model or T.Toxicity()).features(text)
    return {k for k, v in zip(T.KINDS, x, strict=False) if v > 1e-9}


@pytest.mark.parametrize("text,want", [
    ("You are an idiot.", {"directed insult"}), ("An idiot, you know", {"insult"}), ("idiot you are", {"directed insult"}), ("What an idiot.", {"insult"}),
    ("You are not an idiot.", {"negated insult"}), ("She said he is an idiot", {"reported insult"}), ("I will kill you", {"directed threat"}),
    ("I will never kill anyone", {"negated threat"}), ("Du bist ein Dummkopf!", {"directed insult"}), ("not here. idiot", {"insult"}),
    ("I will find you and make you suffer.", {"directed threat"}), ("You should be put down.", {"directed threat"}), ("Watch your back.", {"directed threat"}),
    ("Go back to where you came from, waste of space.", {"directed insult", "insult"}), ("You will regret it", {"directed threat"}), ("I find you nice", set()),
    ("he said I will find you", {"reported threat"}), ("I will not find you", {"negated threat"}), ("we regret it", set()), ("a waste of time", set()),
    ("said so\nidiot", {"insult"}), ("a quiet day", set()), ("", set()), (None, set()), ("not one two three idiot", {"insult"})])
def test_clauses(text, want):
    assert kinds(text) == want


def test_stems_and_clause_bounds():
    model = T.Toxicity({"blarg": 3.0}, {"grump": 2.0})
    assert kinds("such grumpfelings everywhere", model) == {"insult"} and kinds("grum", model) == set()
    x = model.features("blarg a; b c. grumps, blarg blarg")
    assert x[len(T.KINDS)] == pytest.approx(np.log1p(3)) and x[len(T.KINDS) + 1] == pytest.approx(3 / 4) and x[-1] == 6.0
    assert (model.features("blarg " * 3) == T.Toxicity({"blarg": 3.0}).features("blarg " * 3)).all()


def auc(score, label):
    a, b = score[label == 1][:, None], score[label == 0][None, :]
    return ((a > b) + .5 * (a == b)).mean()


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.QUERIES["op1_toxicity"](spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 500 and auc(rows.score.values, rows.toxic.values) > .93
    assert (rows.predicted == rows.toxic).mean() > .97 and rows.toxic[rows.predicted == 1].mean() > .9
    assert out.count() == 10000 and out.where("score not between 0 and 1").count() == 0


def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    strange = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    a, b = T.classify(docs, labels), T.classify(strange, other)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_odd_rows(spark):
    rows = [(1, "you idiot"), (2, None), (3, ""), (None, "a quiet day"), (4, "you idiot " * 30000), (4, "you idiot " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("toxic", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = T.classify(docs, none)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and got[2].score == got[3].score == got[None].score < .1 and got[None].held_out
    assert got[1].score > got[2].score and got[4].predicted == 1
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (2, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert T.classify(docs, labels).count() == len(rows)
    assert T.classify(spark.createDataFrame([], "doc_id long, text string"), labels).collect() == []


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(500)], "doc_id long, quality int, toxic int")
    assert T.labelled_rows(docs, labels, most=100).count() == 100


def test_rare_but_certain_words_are_induced(spark):
    # texts of their own words, as copies count once
    def own(i, n=24):
        return " ".join("".join("bcdfghjklm"[int(c)] for c in f"{(i * 7919 + k * 104729) % 10 ** 6:06d}") for k in range(n))
    rows = [(f"word{'abc'[i % 3]} zorbling {own(i)}" if i < 39 else f"worda plain {own(i)}", 1) for i in range(2000)]
    rows += [(f"worda wordb wordc plain {own(5000 + i)}", 0) for i in range(4000)]
    insults, stems, _ = T.induce(spark.createDataFrame(rows, "text string, toxic int"))
    assert {w for w in [*insults, *stems] if "zorbling".startswith(w)} and not {"word", "worda", "plain"} & {*insults, *stems}


def test_pairs_of_ordinary_words_are_induced(spark):
    def own(i, n=40):
        return " ".join("".join("bcdfghjklm"[int(c)] for c in f"{(i * 7919 + k * 104729) % 10 ** 6:06d}") for k in range(n))
    rows = [(f"{own(i)} the hollow bell rings", 1) for i in range(60)]
    rows += [(f"{own(1000 + i)} hollow days and a bell of hollow wood bell", 0) for i in range(300)]
    insults, stems, pairs = T.induce(spark.createDataFrame(rows, "text string, toxic int"))
    assert "hollow bell" in pairs and not {"hollow", "bell"} & {*insults, *stems}
    assert kinds("you hollow bell", T.Toxicity(insults, stems, pairs)) == {"directed insult"}


def test_near_copies_count_once(spark):
    """Eighty near copies of a toxic text: its rare words prove nothing; a word of twenty different toxic texts does."""
    deal = np.random.default_rng(3)
    word = lambda: "".join(deal.choice(list("abcdefghij"), 7))
    body = [word() for _ in range(60)]
    copies = [(" ".join(w if deal.random() > .02 else word() for w in body), 1) for _ in range(80)]
    others = [(" ".join([*(word() for _ in range(20)), "zorbling"]), 1) for _ in range(20)] + [(" ".join(word() for _ in range(25)), 0) for _ in range(400)]
    insults, stems, pairs = T.induce(spark.createDataFrame(copies + others, "text string, toxic int"))
    found = [*insults, *stems, *(w for p in pairs for w in p.split())]
    assert any("zorbling".startswith(w) for w in found) and sum(any(b.startswith(w) for b in body) for w in found) <= 3
