"""Mixing sources to target weights by a low-discrepancy schedule (operator 4).

1. **Sizes.** A document's size is its number of words. Sources, in code-point
   order with null last, weigh ``WEIGHTS`` repeating. They share ``RATIO`` of all
   words by weight; a target stops at ``CAP`` times its source, the excess going
   to the others by weight until none is above.
2. **Shuffled streams.** Each source is a stream of its documents in the order
   of the MD5 of their id (``seed`` changes it), cut into blocks of
   ``BLOCK_WORDS`` words and repeated up to ``CAP`` times. Offsets are running
   sums over ranges of (source, place) with carries, so that a source, or rows of
   one id, holding a third of all rows are spread over many tasks.
3. **Schedule.** Slot i of the mix is the golden-ratio point ``frac(i * phi)``,
   mapped through the cumulative targets to a source; its rank among the slots
   of that source names the block it takes. Points are made in chunks; ranks are
   local ranks plus the running sums of the chunks' counts. After the last
   slot, each source's rest up to its target (a fraction of a block, or the few
   blocks by which the points miss) follows as its tail.
4. **Join.** Documents are cut at block boundaries and joined with the schedule
   on (source, block). What a document loses to an unscheduled block is not taken.

The source table, one row a source, is the only thing on the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.scan import running_sums

from .common import WORD, fresh, materialise, numbered

RATIO = 1.5
CAP = 2
WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 2048
CHUNK = 1 << 16         # slots made together
MOST_SOURCES = 1_000_000
PHI64 = np.uint64(0x9E3779B97F4A7C15)   # 2^64 / golden ratio


def shares(sizes: list[int], ratio: float = RATIO, cap: float = CAP, weights: tuple = WEIGHTS) -> list[float]:
    """Targets by water filling: ``min(cap * size, level * weight)`` with the level that spends all."""
    total, order = ratio * sum(sizes), []
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    order = sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / w[i])
    spent, weight, out = 0, sum(w), [0.0] * len(sizes)
    for k, i in enumerate(order):
        if spent + cap * sizes[i] / w[i] * weight > total:
            for j in order[k:]:
                out[j] = (total - spent) / weight * w[j]
            break
        out[i] = float(cap * sizes[i])
        spent, weight = spent + cap * sizes[i], weight - w[i]
    return out


def point(i: np.ndarray) -> np.ndarray:
    """frac(i / golden ratio), exactly reduced in 64-bit integers."""
    return (i.astype(np.uint64) * PHI64).astype(np.float64) / 2.0 ** 64


def schedule(spark: SparkSession, targets: list[float], block_words: int = BLOCK_WORDS, chunk: int = CHUNK) -> DataFrame:
    """``(sid, block, slot, words)``: the block each slot takes and how many of its words (tails may take fewer).

    ``slot`` orders the mix; blocks of a tail follow after the last slot.
    """
    whole = [math.floor(t) for t in targets]
    bounds = np.cumsum(targets) / max(sum(targets), 1e-300)
    slots = sum(whole) // block_words

    def make(frames):
        for frame in frames:
            for c in frame["id"]:
                i = np.arange(c * chunk, min((c + 1) * chunk, slots), dtype=np.int64)
                sid = np.minimum(np.searchsorted(bounds, point(i), "right"), len(bounds) - 1)
                order = np.argsort(sid, kind="stable")
                first = np.r_[True, sid[order][1:] != sid[order][:-1]]
                local = np.empty(len(i), np.int64)
                local[order] = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
                yield pd.DataFrame({"chunk": c, "slot": i, "sid": sid.astype(np.int32), "local": local})

    made = (spark.range(-(-slots // chunk)).repartition(max(1, min(-(-slots // chunk), 4096)))
            .mapInPandas(make, "chunk long, slot long, sid int, local long"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = made.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    ranked = (made.join(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), ["sid", "chunk"])
              .select("sid", (F.col("base") + F.col("local")).alias("block"), "slot"))
    per = spark.createDataFrame([(i, n) for i, n in enumerate(whole)], "sid int, whole long")
    full = (ranked.join(per, "sid").where((F.col("block") + 1) * block_words <= F.col("whole"))
            .select("sid", "block", "slot", F.lit(block_words).cast("long").alias("words")))
    used = counts.groupBy("sid").agg(F.sum("n").alias("n"))
    from_block = F.least(F.coalesce("n", F.lit(0)), F.floor(F.col("whole") / block_words))
    last = F.ceil(F.col("whole") / block_words) - 1
    tail = (per.join(used, "sid", "left").where("whole > 0").withColumn("a", from_block).withColumn("b", last).where("a <= b")
            .select("sid", "whole", F.explode(F.sequence("a", "b")).alias("block"))
            .select("sid", "block", F.lit(slots).cast("long").alias("slot"),
                    F.least(F.lit(block_words), F.col("whole") - F.col("block") * block_words).cast("long").alias("words")))
    return full.unionByName(tail)


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def take(rows: DataFrame, seed: str = "", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``rows(rid, doc_id, source, size, text_hash)`` -> ``(rid, source_size, target, taken, epochs)``.

    ``rid`` is unique. ``epochs``: array of ``(epoch, words, slot)``, the words taken
    in each pass over the source (the first ones of the document) and the first slot that does.
    """
    spark = rows.sparkSession
    sources = (rows.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last())
               .limit(MOST_SOURCES + 1).collect())
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    targets = shares([r.n for r in sources])
    table = spark.createDataFrame([(i, r.source, r.n, t, math.floor(t)) for i, (r, t) in enumerate(zip(sources, targets, strict=True))],
                                  "sid int, name string, source_size long, target double, whole long")
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    spread = rows.join(table, rows.source.eqNullSafe(table.name)).drop("source", "name").withColumn("at", order)
    placed = running_sums(spread, ["sid"], ["at", "doc_id", "size", "text_hash", "rid"], {"upto": "size"})
    placed = placed.withColumn("start", F.col("upto").cast("long") - F.col("size"))
    # a document in each epoch that its target reaches, cut at block boundaries
    epochs = F.when(F.col("size") > 0, F.filter(F.sequence(F.lit(0), F.lit(CAP - 1)), lambda e: e * F.col("source_size") + F.col("start") < F.col("whole")))
    passes = placed.select("rid", "source_size", "target", "sid", "size", "start", F.explode_outer(epochs).alias("epoch")).withColumn("a", F.col("epoch") * F.col("source_size") + F.col("start"))
    pieces = (passes.withColumn("block", F.explode_outer(F.when(F.col("epoch").isNotNull(), F.sequence(
        F.floor(F.col("a") / block_words), F.floor((F.col("a") + F.col("size") - 1) / block_words))))))
    taken = pieces.join(schedule(spark, targets, block_words), ["sid", "block"], "left")
    lo, hi = F.greatest("a", F.col("block") * block_words), F.least(F.col("a") + F.col("size"), F.col("block") * block_words + F.col("words"))
    words = F.when(F.col("words").isNull(), 0).otherwise(F.greatest(hi - lo, F.lit(0)))     # least and greatest skip nulls
    # a row of the source table for each pass over it: CAP sums a document
    sums = [F.sum(F.when(F.col("epoch") == e, words)) for e in range(CAP)]
    slots = [F.min(F.when((F.col("epoch") == e) & (words > 0), F.col("slot"))) for e in range(CAP)]
    got = taken.groupBy("rid", "source_size", "target").agg(
        F.sum(words).alias("taken"),
        F.array(*[F.struct(F.lit(e).alias("epoch"), F.coalesce(n, F.lit(0)).alias("words"), at.alias("slot"))
                  for e, (n, at) in enumerate(zip(sums, slots, strict=True))]).alias("epochs"))
    return got.withColumn("epochs", F.filter("epochs", lambda e: e["words"] > 0))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rid = fresh(docs, "rid")
    return materialise(numbered(docs, rid).select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                                  word_count(text_col).alias("size"), F.xxhash64(text_col).alias("text_hash"), F.col(rid).alias("rid")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row.

    Rows without words take nothing; a null source is a source of its own, the
    last; null ids come first in a stream's ties; equal rows follow each other. Reruns agree.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    return rows.select("rid", "doc_id", "size").join(take(rows, seed), "rid").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "",
                    length_col: str | None = None) -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass that takes it, with all columns of ``docs``.

    A document at the end of a target is cut to the words taken, joined by
    spaces; all others keep their text. ``length_col`` names a column that holds
    the text's code points, to be kept right.
    """
    rid, one, size = fresh(docs, "rid"), fresh(docs, "one"), fresh(docs, "size")
    known = numbered(docs, rid)
    rows = materialise(known.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
                                    F.xxhash64(text_col).alias("text_hash"), F.col(rid).alias("rid")))
    passes = take(rows, seed).select("rid", F.explode("epochs").alias(one)).join(rows.select("rid", F.col("size").alias(size)), "rid")
    passes = passes.withColumnRenamed("rid", rid)
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})")), 1, F.col(f"{one}.words").cast("int")), " ")
    is_cut = F.col(f"{one}.words") < F.col(size)
    changed = {text_col: F.when(is_cut, cut).otherwise(F.col(text_col))}
    if length_col is not None:
        kind = docs.schema[length_col].dataType
        changed[length_col] = F.when(is_cut, F.length(cut).cast(kind)).otherwise(F.col(length_col))
    return known.join(passes, rid).select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])
