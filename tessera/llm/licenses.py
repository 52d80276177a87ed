"""Licence scans by a trained paragraph classifier (operator 9).

A paragraph is a run of lines that belong together: a blank line ends it, and so does a
line that is much shorter than the one before it could be (hard-wrapped notices are
unwrapped, lists and lines of their own stay apart). Its word unigrams and bigrams, as far
as licence notices have them, are the sparse features of a multinomial logistic
regression over licence families and an *unknown* class. The model is trained in
numpy on variants of the notices below (cut, with words dropped, set into prose)
against all paragraphs of the corpus and against shuffled notices: paragraphs are
reduced to the words that notices have, distinct ones are dealt by a hash to blocks
of about ``BLOCK``, a task trains on each block, and the weights are averaged. On a
held-out part of every block a temperature is fitted, and the probability from which
a family counts is set so that at most ``FALSE_ALARMS`` of the held-out unknown
paragraphs pass. A prediction is then
confirmed by comparison with the family's notices: one of them must have at
least ``CONFIRM`` of its word trigrams in the paragraph, or the paragraph of its
own in the notice.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UNKNOWN = "unknown"
PROSE = 3000            # paragraphs of a small model (``prose_sample``)
BLOCK = 20_000          # distinct paragraphs that a task trains on
OTHER = "?"             # stands for words that no notice has
WEIGHT = 1 << 20        # weights and losses are added up as whole numbers of this share, in any order
BINS = 10_000
TEMPERATURES = np.geomspace(.2, 5, 25)
VARIANTS = 60           # training variants of a notice
FALSE_ALARMS = 0.001
CONFIRM = 0.6
ROUNDS = 150
WORD = re.compile(r"[^\W_]+(?:[.-][0-9]+)*")
MARKS = re.compile(r"^[ \t]*(?:[#*;%>|]+|//+|--+|/\*+)[ \t]?")      # comment signs and quotes before a line
LIST = re.compile(r"^(?:[-*•]|[0-9]{1,2}[.)]|[a-z]\))\s")
WRAPPED = (50, 100)     # characters of a line that was broken because it was full

# fixed notices (usual wording of public licences)
NOTICES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
            "SPDX-License-Identifier: MIT"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
                   "OF ANY KIND, either express or implied."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
            "either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
            "PURPOSE. See the GNU General Public License for more details."],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later", "Released under the GNU AGPL v3.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
             "either version 3 of the License, or (at your option) any later version.",
             "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
             "PURPOSE. See the GNU Affero General Public License for more details."],
    "isc": ["Released under the ISC License.", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "bsd": ["Released under the BSD 3-Clause License.", "Licensed under the BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
            "provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
            "written permission."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
                "Licensed under the Mozilla Public License 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["All rights reserved.", "Copyright 2020 by the author. All rights reserved.", "No part of this publication may be reproduced without prior written permission."],
}


def words(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def paragraphs(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, unwrapped text) of each paragraph, code points.

    A line goes on in the next one if it is of a length that lines are wrapped at,
    the next one is not blank and does not begin a list, and its own first word
    would not have fitted.
    """
    out, at, open_ = [], 0, None
    for line in (text or "").split("\n"):
        begin, at = at, at + len(line) + 1
        body = MARKS.sub("", line).strip()
        if not body:
            open_ = None
            continue
        if open_ is not None:
            last = out[-1]
            first = body.split(None, 1)[0]
            if WRAPPED[0] <= open_ <= WRAPPED[1] and open_ + 1 + len(first) > WRAPPED[0] + 10 and not LIST.match(body):
                out[-1] = (last[0], begin + len(line), f"{last[2]} {body}")
                open_ = len(line.rstrip())
                continue
        out.append((begin, begin + len(line), body))
        open_ = len(line.rstrip())
    return out


def _trigrams(w: list[str]) -> set:
    return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


@dataclass
class LicenceModel:
    families: list[str]                     # unknown comes last
    index: dict[str, dict[str, int]]        # first word -> second word ("" for the word itself) -> feature
    weights: np.ndarray                     # (features + 1, families); the last row is the constant
    temperature: float = 1.0
    threshold: float = 0.5

    def __post_init__(self):
        self.notices = {f: [(_trigrams(words(n)), len(words(n))) for n in NOTICES[f]] for f in self.families[:-1]}

    def features(self, w: list[str]) -> list[int]:
        out, index = [], self.index
        for a, b in zip(w, [*w[1:], ""], strict=True):
            row = index.get(a)
            if row is not None:
                out.append(row[""])
                k = row.get(b) if b else None
                if k is not None:
                    out.append(k)
        return sorted(set(out))

    def logits(self, rows: list[list[int]]) -> np.ndarray:
        """(paragraphs, families), sums of weight rows."""
        sizes = np.array([len(r) for r in rows])
        out = np.tile(self.weights[-1], (len(rows), 1))
        flat = np.array([k for r in rows for k in r], np.int64)
        if len(flat):
            some = np.flatnonzero(sizes)
            at = np.r_[0, np.cumsum(sizes[some])[:-1]]
            out[some] += np.add.reduceat(self.weights[flat], at, axis=0)
        return out

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        z = self.logits(rows) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def similarity(self, family: str, w: list[str]) -> float:
        """Best share of a notice's trigrams found in the paragraph, or of the paragraph's (of a cut notice) in it."""
        mine, best = _trigrams(w), 0.0
        for grams, n in self.notices[family]:
            both = len(grams & mine)
            best = max(best, both / len(grams), both / len(mine) if 8 <= len(w) < n else 0.0)
        return best

    def scan(self, text: str | None) -> list[tuple]:
        """(family, probability, similarity, start, end) of each confirmed paragraph, code points."""
        found = paragraphs(text)
        if not found:
            return []
        tokens = [words(body) for _, _, body in found]
        p = self.probabilities([self.features(w) for w in tokens])
        best, out = p.argmax(axis=1), []
        for i in np.flatnonzero((best < len(self.families) - 1) & (p.max(axis=1) >= self.threshold)):
            family, (start, end, _) = self.families[best[i]], found[i]
            like = self.similarity(family, tokens[i])
            if like >= CONFIRM:
                out.append((family, float(p[i, best[i]]), like, start, end))
        return out


# ---------------------------------------------------------------- training

def _variants(notice: list[str], prose: list[list[str]], rng) -> list[list[str]]:
    out = [notice]
    for _ in range(VARIANTS):
        w = list(notice)
        if len(w) > 9 and rng.random() < .5:
            n = int(rng.integers(8, len(w) + 1))
            at = int(rng.integers(0, len(w) - n + 1))
            w = w[at:at + n]
        if len(w) > 5:
            w = [x for x in w if rng.random() > .05]
        if prose and rng.random() < .5:
            around = prose[int(rng.integers(len(prose)))][:40]
            cut = int(rng.integers(0, len(around) + 1))
            w = around[:cut] + w + around[cut:]
        out.append(w)
    return out


def _blank() -> LicenceModel:
    families = [*NOTICES, UNKNOWN]
    index: dict[str, dict[str, int]] = {}
    n = 0
    for w in (words(x) for ns in NOTICES.values() for x in ns):
        for a, b in zip(w, [*w[1:], ""], strict=True):
            for second in ("", b) if b else ("",):
                if second not in index.setdefault(a, {}):
                    index[a][second], n = n, n + 1
    return LicenceModel(families, index, np.zeros((n + 1, len(families))))


def _is_plain(model: LicenceModel, w: list[str]) -> bool:
    return max(model.similarity(f, w) for f in model.families[:-1]) < .3


def _examples(model: LicenceModel, plain: list[list[str]], counts, seed: int):
    """(features, class, count, is prose, held out) of variants, shuffled notices and plain paragraphs."""
    rng = np.random.default_rng(seed)
    families, rows, y = model.families, [], []
    for k, f in enumerate(families[:-1]):
        for notice in map(words, NOTICES[f]):
            for w in _variants(notice, plain, rng):
                rows.append(model.features(w))
                y.append(k)
            for _ in range(8):              # the same words in no order are no notice
                mixed = [notice[i] for i in rng.permutation(len(notice))]
                if len(notice) > 4 and model.similarity(f, mixed) < .3:
                    rows.append(model.features(mixed))
                    y.append(len(families) - 1)
    mixed_up = len(rows)
    for w in plain:
        rows.append(model.features(w))
        y.append(len(families) - 1)
    n = np.r_[np.ones(mixed_up), np.asarray(counts, np.float64)]
    return rows, np.array(y), n, np.arange(len(y)) >= mixed_up, rng.random(len(y)) < .25


def _learn(model: LicenceModel, rows: list[list[int]], y: np.ndarray, n: np.ndarray, rounds: int) -> None:
    """Weights of ``model`` from rows that count ``n`` times."""
    weight = n / np.sqrt(np.bincount(y, n, minlength=len(model.families))[y])
    weight *= n.sum() / weight.sum()
    same: dict[tuple, int] = {}             # rows of equal features and class are one
    of = np.array([same.setdefault((k, *r), len(same)) for r, k in zip(rows, y.tolist(), strict=True)], np.int64)
    weight = np.bincount(of, weight)
    classes, rows = np.array([r[0] for r in same], np.int64), [r[1:] for r in same]
    sizes = np.array([len(r) for r in rows])
    feature, at = np.array([k for r in rows for k in r], np.int64), np.repeat(np.arange(len(rows)), sizes)
    some = np.flatnonzero(sizes)
    begin = np.r_[0, np.cumsum(sizes[some])[:-1]].astype(np.int64)
    order = np.argsort(feature, kind="stable")
    found, first = np.unique(feature[order], return_index=True)
    source, share, row = at[order], (weight / n.sum())[:, None].astype(np.float32), np.arange(len(rows))
    square = np.zeros_like(model.weights)
    for _ in range(rounds):                 # Adagrad over the whole set
        now = model.weights.astype(np.float32)
        g = np.tile(now[-1], (len(rows), 1))
        if len(some):
            g[some] += np.add.reduceat(now[feature], begin, axis=0)
        g = np.exp(g - g.max(axis=1, keepdims=True))
        g /= g.sum(axis=1, keepdims=True)
        g[row, classes] -= 1
        g *= share
        grad = 1e-5 * model.weights
        grad[found] += np.add.reduceat(g[source], first, axis=0)
        grad[-1] += g.sum(axis=0)
        square += grad * grad
        model.weights -= .5 * grad / (np.sqrt(square) + 1e-9)


def train(prose: list[str], rounds: int = ROUNDS, seed: int = 3) -> LicenceModel:
    """A model from the notices and unlabelled ``prose`` paragraphs (none is fine). Prose that holds a notice is left out."""
    model = _blank()
    plain = [w for w in map(words, prose) if w and _is_plain(model, w)]
    rows, y, n, is_prose, held = _examples(model, plain, np.ones(len(plain)), seed)
    _learn(model, [r for r, h in zip(rows, held, strict=True) if not h], y[~held], n[~held], rounds)
    return calibrate(model, [r for r, h in zip(rows, held, strict=True) if h], y[held], is_prose[held])


def calibrate(model: LicenceModel, rows: list[list[int]], y: np.ndarray, is_prose: np.ndarray) -> LicenceModel:
    """Temperature of least held-out loss; threshold that prose passes at most ``FALSE_ALARMS`` of the time.

    Shuffled notices count for the temperature only: the comparison with the notices tells them apart.
    """
    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(model.probabilities(rows)[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = min(TEMPERATURES, key=loss) if len(rows) else 1.0
    p = model.probabilities(rows)[:, :-1].max(axis=1) if len(rows) else np.empty(0)
    if is_prose.any():
        model.threshold = float(np.clip(np.quantile(p[is_prose], 1 - FALSE_ALARMS) + 1e-6, .3, .9))
    return model


def prose_sample(docs: DataFrame, text_col: str = "text", most: int = PROSE) -> list[str]:
    """At most ``most`` distinct paragraphs, cut to 400 characters, from texts of low hash, in a fixed order."""
    n = docs.where(F.col(text_col).isNotNull()).count()
    low = F.pmod(F.xxhash64(text_col, F.lit("prose")), F.lit(1 << 30)) / float(1 << 30)
    lines = (docs.where(low < min(1.0, most / max(n, 1))).select(F.explode(F.slice(F.split(text_col, "\n"), 1, 50)).alias("line"))
             .select(F.substring("line", 1, 400).alias("line")).where(F.length(F.trim("line")) > 0).distinct())
    return [r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(most).collect()]


# ---------------------------------------------------------------- training on a whole corpus

def reduced(w: list[str], index: dict) -> str:
    """Words that notices have, the others as ``OTHER``, runs of them as one: same features, far fewer distinct."""
    out: list[str] = []
    for x in w:
        if x in index:
            out.append(x)
        elif not out or out[-1] != OTHER:
            out.append(OTHER)
    return " ".join(out)


def prose_forms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(form, n)``: reduced forms of all paragraphs that hold no notice, and how many distinct paragraphs have each."""
    @F.pandas_udf("array<struct<form:string,h:long>>")
    def of(texts: pd.Series) -> pd.Series:
        model, out = _blank(), []
        grams = set().union(*(g for f in model.families[:-1] for g, _ in model.notices[f]))
        for text in texts:
            rows = []
            for _, _, body in paragraphs(text):
                w = words(body)
                # without a trigram of any notice it is like none
                if w and (grams.isdisjoint(zip(w, w[1:], w[2:])) if len(w) > 2 else tuple(w) not in grams) or w and _is_plain(model, w):
                    h = int.from_bytes(hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                    rows.append({"form": reduced(w, model.index), "h": h})
            out.append(rows)
        return pd.Series(out, dtype=object)
    each = docs.select(F.explode(of(F.col(text_col))).alias("p")).select("p.form", "p.h").distinct()
    return each.groupBy("form").agg(F.count(F.lit(1)).alias("n"))


def _block(model: LicenceModel, pdf: pd.DataFrame):
    """Block number and examples, the same at every reading."""
    pdf = pdf.sort_values("form")
    k = int(pdf["block"].iloc[0])
    return k, _examples(model, [f.split(" ") for f in pdf["form"]], pdf["n"].to_numpy(), 3 + k)


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, block: int = BLOCK) -> LicenceModel:
    """A model from the notices and all paragraphs of the texts.

    A task holds one block, the driver one model and a histogram of bounded size.
    """
    forms = materialise(prose_forms(docs, text_col))
    blocks = -(-forms.count() // block)
    if not blocks:
        return train([], rounds)
    dealt = forms.withColumn("block", F.pmod(F.xxhash64("form"), F.lit(blocks)).cast("int")).repartitionById(blocks, F.col("block"))

    def by_block(of):
        """``of`` each partition, which is one block."""
        def run(parts):
            whole = [p for p in parts if len(p)]
            if whole:
                yield of(pd.concat(whole))
        return run

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        model = _blank()
        _, (rows, y, n, _, held) = _block(model, pdf)
        _learn(model, [r for r, h in zip(rows, held, strict=True) if not h], y[~held], n[~held], rounds)
        return pd.DataFrame({"w": [np.round(model.weights.ravel() * WEIGHT).astype(np.int64).tolist()]})

    weights = dealt.mapInPandas(by_block(learn), "w array<long>").select(F.posexplode("w").alias("at", "w"))
    summed = weights.groupBy("at").agg(F.sum("w").alias("w"), F.count("w").alias("k")).orderBy("at").collect()
    model = _blank()
    model.weights = np.array([r.w / r.k / WEIGHT for r in summed]).reshape(model.weights.shape)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Held-out loss (bin -1) and prose by its largest family probability, for each temperature."""
        _, (rows, y, n, is_prose, held) = _block(model, pdf)
        rows, y, n, is_prose = [r for r, h in zip(rows, held, strict=True) if h], y[held], n[held], is_prose[held]
        z, out = model.logits(rows), []
        for k, t in enumerate(TEMPERATURES):
            p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            p /= p.sum(axis=1, keepdims=True)
            loss = -np.log(p[np.arange(len(y)), y] + 1e-12) * n
            out.append((k, -1, int(round(loss.sum() * WEIGHT))))
            bins = np.minimum(p[is_prose, :-1].max(axis=1) * BINS, .9 * BINS).astype(np.int64)
            out += [(k, int(i), int(m)) for i, m in enumerate(np.bincount(bins, n[is_prose])) if m]
        return pd.DataFrame(out, columns=["k", "bin", "m"])

    # bins below .3 are only counted: the threshold is never there
    found = dealt.mapInPandas(by_block(judge), "k int, bin long, m long")
    low = F.when((F.col("bin") >= 0) & (F.col("bin") < int(.3 * BINS)), 0).otherwise(F.col("bin"))
    found = found.groupBy("k", low.alias("bin")).agg(F.sum("m").alias("m")).collect()
    best = min((r for r in found if r.bin == -1), key=lambda r: (r.m, r.k)).k
    model.temperature = float(TEMPERATURES[best])
    bins = sorted((r.bin, r.m) for r in found if r.k == best and r.bin >= 0)
    allowed, model.threshold = FALSE_ALARMS * sum(m for _, m in bins), .3
    for at, m in reversed(bins):
        allowed -= m
        if allowed < 0:
            model.threshold = float(np.clip((at + 1) / BINS, .3, .9))
            break
    return model


# ---------------------------------------------------------------- operator

SCHEMA = "array<struct<family:string,probability:double,similarity:double,start:int,end:int>>"


def notices(model: LicenceModel, text: Column) -> Column:
    """Confirmed licence paragraphs of a text column."""
    @F.pandas_udf(SCHEMA)
    def of(texts: pd.Series) -> pd.Series:
        names = ("family", "probability", "similarity", "start", "end")
        return pd.Series([[dict(zip(names, hit, strict=True)) for hit in model.scan(t)] for t in texts], dtype=object)
    return of(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """Per row: ``(doc_id, licence, families, notices)``.

    ``licence`` is the family of the most probable notice (``unknown`` if there
    is none), ``families`` all of them, sorted. Null and empty texts have none;
    every row is kept, repeated rows get equal answers; other columns are not read.
    """
    model = model or fit(docs, text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), notices(model, F.col(text_col)).alias("notices"))
    best = F.element_at(F.array_sort(F.transform("notices", lambda n: F.struct(n["probability"], n["family"]))), -1)["family"]
    return found.select("doc_id", F.when(F.size("notices") > 0, best).otherwise(UNKNOWN).alias("licence"),
                        F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"]))).alias("families"), "notices")
