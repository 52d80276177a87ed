"""Toxicity by a weighted finite-state pattern grammar (operator 1).

A word becomes a symbol: insult, threat, modal, harmless verb that a modal makes a
threat, verb of ruin, target, negation, reporting or other; punctuation and line
ends close a clause. Five sequential transducers rewrite the symbols of a clause:

* insult: a sequence of words that insults together is an insult at its last word;
* threat: so is a sequence that threatens; a verb such as *find* behind a modal
  becomes an *aimed* threat at the target it has, and a verb of ruin such as
  *regret* a threat behind a target and a modal;
* negation: an insult or threat up to three words after a negation is *negated*;
* reported speech: after a reporting word, up to the clause's end, it is *reported*;
* target: within four words after a target, or two before one, it is *directed*.

``compose`` feeds one's output to the next; the machine of all five is deterministic and
its transitions are worked out once each, when first needed. A clause
counts if the machine emits an insult or threat of any kind; its weight in each
kind is the sum of its words' weights. A document's score is a logistic
function of those sums and the share of matched clauses, so isolated words only
count through the kind of clause they stand in.

Seed lists are fixed; further insults are *induced* from labelled rows: whole
words, stems (prefixes, which cover inflected forms) and pairs of words that are significantly
more frequent in toxic than in clean texts, with their log-odds as weight. Weights of kinds
are fitted by logistic regression. Labels come from at most ``LABELLED`` rows
outside the held-out fold, picked by a hash of the id; that bound is what makes
the training set small enough to broadcast. Inputs of a score are the words alone.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, numbered

LABELLED = 20_000       # labelled rows learned from
STEMS = (4, 5, 6, 7, 8)   # lengths of stems
LEAST_TEXTS = 4         # toxic texts that must have an induced word or stem
CHANCE = 0.01           # of any word or stem being induced by chance
LEAST_LIFT = 5.0
CACHE_WORDS = 400_000

# fixed word lists (English, German, French, Spanish)
WORDS = {
    "insult": "idiot idiots moron morons loser losers scum trash stupid worthless pathetic disgusting clown dumb fool vermin filth "
              "dummkopf abschaum wertlos trottel versager imbécile ordure abruti minable crétin idiota imbécil basura estúpido inútil payaso",
    "threat": "kill hurt destroy burn shoot beat stab töten umbringen verprügeln vernichten tuer frapper détruire matar golpear destruir",
    "target": "you your yours yourself he she they them him her these those people du dich dir ihr euch dein tu toi vous ils elles "
              "tú ti usted ustedes ellos ellas",
    "negation": "not no never neither nobody isn't aren't don't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún ni",
    "report": "said says say called wrote quoted claimed claims reported sagte sagt meinte schrieb nannte disait écrit appelé dijo dice escribió llamó",
}
WORDS |= {
    "modal": "will shall should must gonna going would ought let werde werden wirst wird sollte sollten muss vais va vont devrait doit voy va van debería debe",
    "verb": "find get make come catch hunt track teach finish silence bury finden kriegen holen erwischen trouver attraper encontrar atrapar buscar",
    "ruin": "regret pay suffer die bleed bereuen bezahlen leiden sterben regretter payer souffrir mourir lamentar pagar sufrir morir",
}
# fixed word sequences
SEQUENCES = {
    "insult": ["waste of space", "waste of oxygen", "piece of trash", "piece of garbage", "good for nothing", "go back to where you came from", "nichts wert",
               "bon à rien", "pedazo de basura", "pas un humain"],
    "threat": ["watch your back", "sleep with one eye open", "be put down", "make you suffer", "make them suffer", "know where you live", "weiß wo du wohnst",
               "sais où tu habites", "sé dónde vives"],
}
OTHER, NEGATION, REPORT, TARGET, THREAT, INSULT, MODAL, VERB, RUIN, AIMED = range(10)
SYMBOL = {"insult": INSULT, "threat": THREAT, "target": TARGET, "negation": NEGATION, "report": REPORT, "modal": MODAL, "verb": VERB, "ruin": RUIN}
MODAL_REACH = 4         # words within which a modal makes a verb a threat
PRIOR = 2.0             # weight of a seed that labels say nothing about

#: kinds of matches, the features of a document in this order
KINDS = ("insult", "directed insult", "reported insult", "negated insult", "threat", "directed threat", "reported threat", "negated threat")
FEATURES = (*KINDS, "matched clauses", "share of clauses", "heaviest clause")
DEFAULT = np.array([1.2, 1.5, .3, .2, .5, 1.5, .1, .1, .5, 1.0, .3, -3.5])     # and the constant; used if there is nothing to learn


# ---------------------------------------------------------------- transducers

class Transducer:
    """Sequential: ``step(state, symbol) -> (state, symbol)`` from ``start``; a symbol is ``(kind, word, weight)``."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    @staticmethod
    def of_kinds(start, step) -> Transducer:
        """From a function of kinds; word and weight pass through."""
        def whole(state, symbol):
            to, kind = step(state, symbol[0])
            return to, (kind, *symbol[1:])
        return Transducer(start, whole)


def sequences(kind: int, weights: dict[tuple[str, ...], float]) -> Transducer:
    """Sequences of words -> ``kind`` with the sequence's weight, at the last word (the longest sequence that ends there).

    State: the longest run of last words that begins a sequence.
    """
    heads = {s[:n] for s in weights for n in range(len(s) + 1)}

    def step(state, symbol):
        run = (*state, symbol[1]) if symbol[1] is not None else ()
        while run not in heads:
            run = run[1:]
        found = next((run[i:] for i in range(len(run)) if run[i:] in weights), None)
        return run, symbol if found is None else (kind, symbol[1], weights[found])
    return Transducer((), step)


def insults(weights: dict[tuple[str, ...], float]) -> Transducer:
    return sequences(INSULT, weights)


def threats(weights: dict[tuple[str, ...], float], modal: int = MODAL_REACH, verb: int = 2, target: int = 4) -> Transducer:
    """Threatening sequences, and verbs that modal and target make threats of.

    State: the sequences' state, and in how many words a modal, a verb behind a modal and a target are still near.
    """
    spoken = sequences(THREAT, weights)

    def step(state, symbol):
        run, m, v, t = state
        run, (kind, word, weight) = spoken.step(run, symbol)
        out = kind
        if kind == TARGET and v:
            out, v = AIMED, 0
        elif kind == RUIN:
            out = THREAT if m and t else OTHER
        elif kind in (MODAL, VERB):
            out = OTHER
        state = (run, modal if kind == MODAL else max(m - 1, 0), verb if kind == VERB and m else max(v - 1, 0), target if kind == TARGET else max(t - 1, 0))
        return state, (out, word, weight)
    return Transducer(((), 0, 0, 0), step)


MATCH = {INSULT: "insult", THREAT: "threat", AIMED: "aimed threat"}


def negation(scope: int = 3) -> Transducer:
    def step(left, kind):
        if kind in MATCH:
            return max(left - 1, 0), ("negated " if left else "") + MATCH[kind].replace("aimed ", "" if left else "aimed ")
        return (scope if kind == NEGATION else max(left - 1, 0)), kind
    return Transducer.of_kinds(0, step)


def reported() -> Transducer:
    def step(inside, kind):
        if kind in MATCH.values():
            return inside, "reported " + kind.replace("aimed ", "") if inside else kind
        return inside or kind == REPORT, kind
    return Transducer.of_kinds(False, step)


def directed(before: int = 4, after: int = 2) -> Transducer:
    """State: words since a target (up to ``before``), and the undirected match still in reach of a later one."""
    def step(state, kind):
        left, pending, reach = state
        if kind == "aimed threat":
            return (before, "", 0), "directed threat"
        if kind in ("insult", "threat"):
            return ((max(left - 1, 0), "", 0), "directed " + kind) if left else ((0, kind, after), kind)
        if kind == TARGET:
            return (before, "", 0), "redirect " + pending if pending else OTHER
        reach = max(reach - 1, 0)
        return (max(left - 1, 0), pending if reach else "", reach), kind if isinstance(kind, str) else OTHER
    return Transducer.of_kinds((0, "", 0), step)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that feeds ``a``'s output to ``b``."""
    def step(state, symbol):
        to, middle = a.step(state[0], symbol)
        then, out = b.step(state[1], middle)
        return (to, then), out
    return Transducer((a.start, b.start), step)


def grammar(insulting: dict[tuple[str, ...], float], threatening: dict[tuple[str, ...], float]) -> Transducer:
    return compose(compose(compose(compose(insults(insulting), threats(threatening)), negation()), reported()), directed())


class Machine:
    """A transducer with numbered states and symbols; each transition is worked out once."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.states, self.ids, self.table = transducer, [transducer.start], {transducer.start: 0}, {}

    def step(self, state: int, symbol: tuple):
        key = state, symbol
        found = self.table.get(key)
        if found is None:
            to, out = self.transducer.step(self.states[state], symbol)
            if to not in self.ids:
                self.ids[to] = len(self.states)
                self.states.append(to)
            found = self.table[key] = self.ids[to], out
        return found


# ---------------------------------------------------------------- scoring

TOKEN_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
CLOSING = re.compile(r"[.!?;:,]['\")\]}»”]*$")
LINE = "\ue000"       # stands for a line end
END, HIT, LAST, INSIDE, NEEDS_MODAL, IS_MODAL = (1 << k for k in range(6))      # of a word: the clause ends after it, an insult or threat, the
#                         last word of a sequence, a word of one, a verb of a modal, a modal
PLAIN = (OTHER, None, 0.0)


@dataclass
class Toxicity:
    """Lexicon, kind weights and the composed machine; sent to the tasks."""

    insults: dict[str, float] = field(default_factory=dict)     # induced words
    stems: dict[str, float] = field(default_factory=dict)       # induced prefixes
    pairs: dict[str, float] = field(default_factory=dict)       # induced pairs of words
    weights: np.ndarray = field(default_factory=lambda: DEFAULT.copy())

    def __post_init__(self):
        spoken = {k: {tuple(s.split()): PRIOR for s in v} for k, v in SEQUENCES.items()}
        spoken["insult"] |= {tuple(p.split()): w for p, w in self.pairs.items()}
        self.machine = Machine(grammar(spoken["insult"], spoken["threat"]))
        self.seeds = {w: SYMBOL[kind] for kind, words in WORDS.items() for w in words.split()}
        self.inside = {w for v in spoken.values() for s in v for w in s}        # words of sequences
        self.last = {s[-1] for v in spoken.values() for s in v}
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.symbols: list[tuple] = []          # of a code
        self.flags = np.zeros(1 << 12, np.uint8)        # of a code, in a buffer that doubles

    def _learn(self, tokens: set[str]) -> None:
        while len(self.symbols) + len(tokens) > len(self.flags):
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
        for token in tokens:
            end = token == LINE or bool(CLOSING.search(token))
            word = TOKEN_ENDS.sub("", token) if token != LINE else ""
            weight = self.insults.get(word)
            if weight is None:
                weight = max((self.stems[word[:n]] for n in range(STEMS[0], min(len(word), STEMS[-1]) + 1) if word[:n] in self.stems), default=None)
            kind = self.seeds.get(word, OTHER) if weight is None else INSULT
            inside = word in self.inside
            self.codes[token] = len(self.symbols)
            self.flags[len(self.symbols)] = (END * end | HIT * (kind in (INSULT, THREAT)) | LAST * (word in self.last) | INSIDE * inside
                                             | NEEDS_MODAL * (kind in (VERB, RUIN)) | IS_MODAL * (kind == MODAL))
            self.symbols.append(PLAIN if kind == OTHER and not inside else
                                (kind, word if inside else None, (PRIOR if weight is None else weight) if kind in (INSULT, THREAT) else 0.0))

    @staticmethod
    def _hits(flags: np.ndarray) -> np.ndarray:
        """Places where something may match: a sequence needs a word of one before its last, a verb a modal not far before."""
        hit = flags & HIT > 0
        if (flags & (LAST | NEEDS_MODAL)).any():
            hit[1:] |= (flags[1:] & LAST > 0) & (flags[:-1] & INSIDE > 0)
            modal, near = flags & IS_MODAL > 0, np.zeros(len(flags), bool)
            for d in range(1, MODAL_REACH + 1):
                near[d:] |= modal[:-d] if d < len(flags) else False
            # an aimed threat matches at the target behind the verb, in the same clause
            hit |= (flags & NEEDS_MODAL > 0) & near
        return np.flatnonzero(hit)

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        tokens = (text or "").lower().replace("\n", f" {LINE} ").split()
        if not tokens:
            return out
        try:
            codes = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            if len(self.codes) > CACHE_WORDS:
                self._forget()
            self._learn({t for t in tokens if t not in self.codes})
            codes = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, len(tokens))
        flags = self.flags[codes]
        ends, hits = np.flatnonzero(flags & END), self._hits(flags)
        clauses = len(ends) + (not len(ends) or ends[-1] < len(codes) - 1)
        if not len(hits):
            return out
        which, heaviest, matched = np.searchsorted(ends, hits), 0.0, 0
        for c in np.unique(which):
            a, b = int(ends[c - 1]) + 1 if c else 0, int(ends[c]) + 1 if c < len(ends) else len(codes)
            weight = self.clause([self.symbols[k] for k in codes[a:b].tolist()], out)
            matched, heaviest = matched + (weight > 0), max(heaviest, weight)
        if not matched:
            return np.zeros(len(FEATURES))
        return np.concatenate([np.log1p(out[:len(KINDS)]), [math.log1p(matched), matched / clauses, heaviest]])

    def clause(self, symbols: list[tuple], out: np.ndarray) -> float:
        """Runs the machine over a clause, adds its weights to the kinds in ``out``; returns their sum."""
        state, total, last, step = 0, 0.0, (0, 0.0), self.machine.step
        for symbol in symbols:
            state, (kind, _, w) = step(state, symbol)
            if not isinstance(kind, str):
                continue
            if kind.startswith("redirect "):            # a target after the match: move its weight
                k, w = last
                out[k] -= w
                out[KINDS.index("directed " + kind[9:])] += w
                continue
            k, w = KINDS.index(kind), w or PRIOR
            out[k] += w
            total, last = total + w, (k, w)
        return total

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.atleast_2d(features) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


# ---------------------------------------------------------------- learning

def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                  most: int = LABELLED) -> DataFrame:
    """``(text, toxic)`` of at most ``most`` labelled ids outside the held-out fold, written once.

    An id labelled twice counts with its largest label.
    """
    ids = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
           .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic")))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)      # bounded, hence broadcast
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return materialise(rows.join(F.broadcast(ids), "_id").select("text", "toxic"))


def induce(rows: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Insulting words, stems and pairs of words with their log-odds, from ``rows(text, toxic)``.

    What reaches the driver is significant in the bounded sample of labelled rows, and bounded by it.
    """
    def pairs_of(c: str) -> Column:
        return F.array_distinct(F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.size(c)),
                                           lambda a, b: F.concat(a, F.lit(" "), b)))
    spoken = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "").alias("spoken")
    # near copies share a pair of least hash under one of three hashes; one of them counts, or their rare words would seem significant
    known = numbered(rows, "rid")
    marks = known.select("rid", "toxic", spoken).select("rid", "toxic", "spoken", pairs_of("spoken").alias("pairs"))
    marks = marks.select("rid", "toxic", *[F.coalesce(_least_hash("pairs", k), F.xxhash64("spoken")).alias(f"least{k}") for k in range(3)])
    for k in range(3):
        marks = marks.dropDuplicates(["toxic", f"least{k}"])
    kept = known.join(F.broadcast(materialise(marks.select("rid"))), "rid")          # ids of the bounded sample
    spoken = kept.select("toxic", spoken).withColumn("pairs", pairs_of("spoken"))
    sizes = {r.toxic: r.n for r in spoken.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}, {}, {}
    words = F.filter(F.array_distinct("spoken"), lambda w: F.length(w) >= 3)
    stems = [F.transform(words, _stem(n)) for n in STEMS]
    features = F.array_distinct(F.filter(F.concat(words, *stems, F.col("pairs")), lambda f: f.isNotNull()))
    lift = (F.col("t") / toxic) / ((F.col("c") + 0.5) / clean)
    counts = (spoken.select("toxic", F.explode(features).alias("f")).groupBy("f")
              .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(F.col("t") + F.col("c") >= LEAST_TEXTS))
    counts = materialise(counts)
    # Chernoff's bound of t or more toxic texts out of t + c by chance, for all tried at once
    t, c, n = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    surprise = t * F.log(t / n * ((toxic + clean) / toxic)) + F.when(c > 0, c * F.log(c / n * ((toxic + clean) / clean))).otherwise(0.0)
    tried = max(counts.count(), 1)
    found = (counts.where((t >= LEAST_TEXTS) & (lift >= LEAST_LIFT) & (surprise >= math.log(tried / CHANCE)))
             .select("f", "t", F.log(lift).alias("w")).collect())
    found.sort(key=lambda r: (" " in r.f, -(r.t * r.w), -len(r.f), r.f))        # pairs last
    chosen: dict[str, tuple[int, float]] = {}
    prefixes: set[str] = set()
    for r in found:
        stem = r.f.endswith("*")
        body = r.f.rstrip("*")
        parts = body.split(" ")
        if any(w in chosen or any(w[:n] in prefixes for n in STEMS) for w in parts) and not stem:
            continue                                    # a chosen word or stem covers it
        if stem and (any(body[:n] in prefixes for n in STEMS) or any(k.rstrip("*").startswith(body) and r.t <= 1.1 * n for k, (n, _) in chosen.items())):
            continue                                    # covered, or hardly wider than what is chosen
        chosen[r.f] = (r.t, float(r.w))
        if stem:
            prefixes.add(body)
    single = {f: w for f, (_, w) in chosen.items() if f[-1] != "*" and " " not in f}
    return single, {f[:-1]: w for f, (_, w) in chosen.items() if f[-1] == "*"}, {f: w for f, (_, w) in chosen.items() if " " in f}


def _least_hash(pairs: str, seed: int) -> Column:
    return F.array_min(F.transform(pairs, lambda p: F.xxhash64(F.lit(seed), p)))


def _stem(n: int):
    return lambda w: F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*")))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the constant comes last."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: DataFrame) -> Toxicity:
    """A model from ``rows(text, toxic)``, bounded as ``labelled_rows`` makes them; defaults if one label is missing."""
    model = Toxicity(*induce(rows))
    if not model.insults and not model.stems and rows.select("toxic").distinct().count() < 2:
        return model
    seen = rows.select("toxic", _features(model)(F.col("text")).alias("x")).collect()
    x, y = np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float)
    model.weights = logistic(x, y)
    return model


def _features(model: Toxicity):
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.features(t) for t in texts], dtype=object)
    return of


# ---------------------------------------------------------------- operator

def score(model: Toxicity, text: Column) -> Column:
    """struct(score, matched): probability of label 1, and matched clauses of each kind as log-weights."""
    @F.pandas_udf("score double, kinds array<double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        x = np.array([model.features(t) for t in texts]).reshape(-1, len(FEATURES))
        return pd.DataFrame({"score": model.score(x) if len(x) else [], "kinds": list(x[:, :len(KINDS)])})
    return of(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             model: Toxicity | None = None) -> DataFrame:
    """Per row of ``docs``: ``(doc_id, held_out, score, predicted, kinds)``.

    Null and empty texts get the score of a text without a match. Every row is
    kept, repeated rows get equal scores. Empty labels leave the fixed lists and
    default weights; an empty table gives an empty one. Other columns are not read.
    """
    model = model or fit(labelled_rows(docs, labels, id_col, text_col, label_col))
    scored = docs.select(F.col(id_col).alias("doc_id"), score(model, F.col(text_col)).alias("s"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.score",
                         (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.kinds")
