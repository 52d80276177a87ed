"""Language identification by a bidirectional gated recurrent network over bytes (operator 7).

The lower-cased UTF-8 text is cut into windows of ``WINDOW`` bytes (all of the
text, the last window padded). In each window one gated recurrent unit runs
forwards and one backwards; at every position the two states give a softmax
over the languages, and the document's probabilities are the mean over all its
positions that belong to letters. The languages are the non-null ``lang``
values of the training rows, nothing is preset.

Training is numpy backpropagation through time over a bounded sample: at most
``SAMPLE`` distinct texts a language, an excerpt of ``EXCERPT`` characters of
each, picked by a hash of the text from the rows outside the held-out fold.
``SAMPLE``, ``EXCERPT`` and ``EPOCHS`` are the documented bounds; the network
does not grow with the data.

A null text or one without a letter is ``und`` with score 0, and so is
everything if there is nothing to learn from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out

HIDDEN = 8
WINDOW = 64
SAMPLE = 400
EXCERPT = 384
EPOCHS = 5
BATCH = 64
CHUNK = 1024            # windows run side by side
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")

#: bytes that belong to letters: ASCII letters and all parts of longer characters
_COUNTED = np.zeros(256, np.float32)
_COUNTED[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.divide(1.0, x, out=x)


@dataclass
class BiGru:
    """Weights: ``w`` (gates x byte), ``u`` (gates x hidden) and ``o`` (language x hidden) of each direction."""

    langs: list[str]
    w: list[np.ndarray]
    u: list[np.ndarray]
    o: list[np.ndarray]
    b: np.ndarray

    @staticmethod
    def new(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> BiGru:
        rng = np.random.default_rng(seed)

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        c = len(langs)
        return BiGru(langs, [draw(3 * hidden, 256, scale=.3) for _ in "fb"], [draw(3 * hidden, hidden, scale=.3) for _ in "fb"],
                     [draw(c, hidden, scale=.3) for _ in "fb"], np.zeros((c, 1), np.float32))

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.o, self.b]

    # ------------------------------------------------------------ inference

    def _states(self, d: int, x: np.ndarray) -> np.ndarray:
        """Language scores of direction ``d`` (0 forwards, 1 backwards) at every position: (T, C, B)."""
        w, u, o = self.w[d], self.u[d], self.o[d]
        h = u.shape[1]
        steps, width = x.shape
        state, out = np.zeros((h, width), np.float32), np.empty((steps, len(o), width), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            pre, rec = w.take(x[t], axis=1), u @ state
            gates = pre[:2 * h]
            gates += rec[:2 * h]
            _sigmoid(gates)
            new = rec[2 * h:]
            new *= gates[h:]
            new += pre[2 * h:]
            np.tanh(new, out=new)
            state -= new
            state *= gates[:h]
            state += new
            np.matmul(o, state, out=out[t])
        return out

    def window_sums(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows (n, WINDOW) of bytes: summed probabilities (n, C) over counted positions, and their number."""
        n = len(windows)
        sums, counted = np.zeros((n, len(self.langs)), np.float32), np.zeros(n, np.float32)
        for at in range(0, n, CHUNK):
            x = np.ascontiguousarray(windows[at:at + CHUNK].T)
            p = self._states(0, x)
            p += self._states(1, x)
            p += self.b
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            weight = _COUNTED[x]
            p *= (weight / p.sum(axis=1))[:, None, :]
            sums[at:at + CHUNK] = p.sum(axis=0).T
            counted[at:at + CHUNK] = weight.sum(axis=0)
        return sums, counted

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Pooled probabilities (documents, languages); rows without a letter are all zero."""
        out = np.zeros((len(texts), len(self.langs)))
        for group in _batches(texts):
            raw = [to_bytes(texts[i]) for i in group]
            sizes = np.array([-(-len(r) // WINDOW) for r in raw])
            joined = b"".join(r.ljust(int(s) * WINDOW, b"\0") for r, s in zip(raw, sizes, strict=True))
            sums, counted = self.window_sums(np.frombuffer(joined, np.uint8).reshape(-1, WINDOW))
            at = np.r_[0, np.cumsum(sizes)[:-1]]
            total = np.add.reduceat(counted, at, dtype=np.float64)
            out[group] = np.add.reduceat(sums, at, axis=0, dtype=np.float64) / np.maximum(total, 1)[:, None]
        return out

    # ------------------------------------------------------------ training

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over counted positions of ``x`` (T, B), labels ``y`` (B), and gradients of ``params()``."""
        steps, width = x.shape
        h, c = self.u[0].shape[1], len(self.langs)
        tapes, logits = [], np.zeros((steps, c, width), self.b.dtype)
        for d in (0, 1):
            state, tape = np.zeros((h, width), self.b.dtype), []
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                pre, rec = self.w[d].take(x[t], axis=1), self.u[d] @ state
                gates = _sigmoid(pre[:2 * h] + rec[:2 * h])
                z, r = gates[:h], gates[h:]
                new = np.tanh(pre[2 * h:] + r * rec[2 * h:])
                tape.append((t, state, z, r, new, rec[2 * h:]))
                state = new + z * (state - new)
                logits[t] += self.o[d] @ state
                tape[-1] += (state,)
            tapes.append(tape)
        logits += self.b
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weight = _COUNTED[x].astype(self.b.dtype)
        total = max(weight.sum(), 1.0)
        loss = -float((np.log(p[:, y, np.arange(width)] + 1e-12) * weight).sum() / total)
        p[:, y, np.arange(width)] -= 1
        dlog = p * (weight / total)[:, None, :]
        gw, gu, go = [], [], []
        for d in (0, 1):
            dpre, du, do = np.zeros((steps, 3 * h, width), self.b.dtype), np.zeros_like(self.u[d]), np.zeros_like(self.o[d])
            carry = np.zeros((h, width), self.b.dtype)
            for t, before, z, r, new, rec, after in reversed(tapes[d]):
                do += dlog[t] @ after.T
                dh = carry + self.o[d].T @ dlog[t]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dn * rec * r * (1 - r)
                dpre[t] = np.concatenate([dz, dr, dn])
                drec = np.concatenate([dz, dr, dn * r])
                du += drec @ before.T
                carry = dh * z + self.u[d].T @ drec
            flat, at = dpre.transpose(1, 0, 2).reshape(3 * h, -1), x.ravel()
            gw.append(np.stack([np.bincount(at, row, 256) for row in flat]).astype(self.b.dtype))
            gu.append(du)
            go.append(do)
        return loss, [*gw, *gu, *go, dlog.sum(axis=(0, 2))[:, None]]


def to_bytes(text: str | None) -> bytes:
    """Lower-cased UTF-8; nothing if there is no letter."""
    if text is None or not LETTER.search(text):
        return b""
    return text.lower().encode("utf-8", "surrogatepass")


def _batches(texts: list[str | None], most: int = 4_000_000):
    """Positions of texts that have a letter, in groups of about ``most`` characters."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if text is not None and LETTER.search(text):
            group.append(i)
            size += len(text)
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = 7) -> BiGru | None:
    """Adam over shuffled windows; None if there is no labelled letter. Order of the input matters, nothing else random."""
    windows, y, langs = [], [], sorted(set(labels))
    for text, label in zip(texts, labels, strict=True):
        raw = to_bytes(text)
        for at in range(0, max(len(raw) - WINDOW // 2, 1) if raw else 0, WINDOW):
            windows.append(np.frombuffer(raw[at:at + WINDOW].ljust(WINDOW, b"\0"), np.uint8))
            y.append(langs.index(label))
    if not windows:
        return None
    x, y, net = np.stack(windows), np.array(y), BiGru.new(langs, hidden, seed)
    # languages weigh alike: each epoch takes as many windows of every language
    each = int(np.median(np.bincount(y)[np.bincount(y) > 0]))
    rng, params = np.random.default_rng(seed), net.params()
    m, v, k, steps = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 0
    total = epochs * -(-each * len(langs) // BATCH)
    for _ in range(epochs):
        picked = np.concatenate([rng.choice(np.flatnonzero(y == c), each) for c in range(len(langs)) if (y == c).any()])
        rng.shuffle(picked)
        for at in range(0, len(picked), BATCH):
            rows = picked[at:at + BATCH]
            _, grads = net.loss_and_gradients(np.ascontiguousarray(x[rows].T), y[rows])
            steps += 1
            rate = 0.02 * max(0.05, 1 - steps / total)
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
            k += 1
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g / norm
                m[i] = .9 * m[i] + .1 * g
                v[i] = .99 * v[i] + .01 * g * g
                p -= (rate * (m[i] / (1 - .9 ** k)) / (np.sqrt(v[i] / (1 - .99 ** k)) + 1e-7)).astype(p.dtype)
    return net


# ---------------------------------------------------------------- operator

def training_sample(docs: DataFrame, label_col: str, text_col: str, learn: Column, per_label: int = SAMPLE,
                    excerpt: int = EXCERPT) -> list[tuple[str, str]]:
    """At most ``per_label`` distinct texts of every label: (label, excerpt), in a fixed order.

    One pass counts the distinct texts of each label (copies count once), a
    second keeps about ``2 * per_label`` texts a label whose hash is low. What
    reaches the driver is bounded by the number of labels.
    """
    rows = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), learn.alias("learn"))
    rows = rows.where(F.col("learn") & F.col("label").isNotNull() & F.col("text").isNotNull())
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for label, n in sorted(sizes.items()) for x in (label, min(1.0, 2 * per_label / n))])
    low = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = 1 + F.pmod(F.xxhash64("text", F.lit("start")), F.greatest(F.length("text") - excerpt, F.lit(1)))
    picked = (rows.withColumn("low", low).where(F.col("low") < share[F.col("label")])
              .select("label", "low", F.substr("text", start, F.lit(excerpt)).alias("text")).distinct().collect())
    out, taken = [], dict.fromkeys(sizes, 0)
    for r in sorted(picked, key=lambda r: (r.label, r.low, r.text)):
        if taken[r.label] < per_label:
            taken[r.label] += 1
            out.append((r.label, r.text))
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> BiGru | None:
    sample = training_sample(docs, lang_col, text_col, ~held_out(F.col(id_col)))
    return train([t for _, t in sample], [label for label, _ in sample])


def predict(net: BiGru | None, text: Column) -> Column:
    """struct(lang_pred, score) of a text column.

    Declared nondeterministic (it is not) so that a filter on the answer does not run the network a second time.
    """
    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        values = [t if isinstance(t, str) else None for t in texts]
        if net is None:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(values), "score": 0.0})
        p = net.probabilities(values)
        best, seen = p.argmax(axis=1), p.sum(axis=1) > 0
        names = [net.langs[k] if ok else UNDETERMINED for k, ok in zip(best, seen, strict=True)]
        return pd.DataFrame({"lang_pred": names, "score": np.clip(p.max(axis=1), 0, 1)})
    return of.asNondeterministic()(text)


def identify(docs: DataFrame, net: BiGru | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (existing columns of these names are replaced).

    ``net`` None: one is fitted on ``docs`` itself. Every row is kept; repeated rows get equal answers.
    """
    net = net or fit(docs, text_col, lang_col, id_col)
    found = fresh(docs, "found")
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.withColumn(found, predict(net, F.col(text_col)))
    return out.select(*names, f"{found}.lang_pred", f"{found}.score")


def accepted(docs: DataFrame, net: BiGru | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the texts no language can be given to; a null ``lang`` becomes the predicted one.

    Rejected are null texts and those without a letter. With nothing to learn
    from, other texts are kept with their null ``lang``.
    """
    net = net or fit(docs, text_col, lang_col, id_col)
    if net is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    found = fresh(docs, "found")
    out = docs.withColumn(found, predict(net, F.col(text_col))["lang_pred"])
    filled = F.coalesce(F.col(lang_col), F.col(found))
    return out.where(F.col(found) != UNDETERMINED).select(*[filled.alias(c) if c == lang_col else F.col(c) for c in docs.columns])
