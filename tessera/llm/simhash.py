"""SimHash near-duplicates through vantage-point trees (operator 2).

**Fingerprint.** A-Z is lower-cased, words are the runs of bytes other than
``\\x20 \\x09-\\x0D``, shingles are ``shingle_words`` consecutive words joined
by a space (fewer words: the whole sequence). A bit of the 64-bit fingerprint
is 1 if it is set in over half of the shingles' XXH64 (seed 42), repeats
included. A null, empty or blank text has fingerprint zero.

**Search.** All pairs of distinct fingerprints at most ``max_bits`` apart are
found by vantage-point trees under the Hamming distance:

* *Root.* A pair at distance <= r leaves at least ``BLOCKS - r`` of ``BLOCKS``
  bit blocks untouched. There is one tree for each choice of that many blocks;
  in it the pair has distance zero on those blocks, hence (triangle inequality,
  radius zero) lies in the same shell around *every* vantage pattern of the
  blocks. The blocks' value names that cell of shells, a shard. Distances on
  all 64 bits cannot prune at the root: around any vantage point they
  concentrate at 32 +- 4, so that a radius of 4 reaches both sides of a median
  split for two fingerprints in three (README).
* *Crowded shards.* A shard of more than ``shard_rows`` fingerprints is split
  into shells by their distance to a vantage fingerprint of that shard. By the
  triangle bound a match of a fingerprint in shell d lies in the shells
  d - r .. d + r. Each fingerprint lives in its own shell and is sent to the r
  next ones as a query, which covers each pair of shells once. A shell still
  above ``shard_rows`` is dealt into parts that ask each other.
* *Inside a task* the shard is a vantage-point tree again: a median split by
  distance to a vantage fingerprint, recursion on both halves, and the band of
  r around the boundary compared across it.

Work within a shard is compared in blocks; what leaves a task are at most
``n`` links that span the matches of a block of ``n`` rows (in a tree of small
degree), never all pairs. Components come from ``components.py``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, numbered
from .components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SHARD_ROWS = 16384      # a shard beyond this is split into distance shells
LEAF = 256              # fingerprints compared all with all in a tree's leaf
SMALL = 24              # groups up to this size skip the tree
FAN_OUT = 8


# ---------------------------------------------------------------- fingerprint

def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint (as a signed integer) of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII lower case and white space
    if not words:
        return 0
    n = len(words) - shingle_words + 1
    if n < 1:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    hashes = b"".join([digest(s, SEED) for s in shingles])
    for at in range(0, len(hashes), 8 << 16):
        part = np.frombuffer(hashes, np.uint8, min(8 << 16, len(hashes) - at), at)
        counts += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint column (signed 64-bit)."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle_words) for t in texts], dtype="int64")
    return of(text)


def hex16(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- trees

def _block_keys(max_bits: int) -> list[list[tuple[int, int]]]:
    """For each tree its blocks as (shift, width): all choices of blocks a match leaves untouched."""
    blocks = max_bits + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(spans, blocks - max_bits)]


def _cells(fps: DataFrame, max_bits: int) -> DataFrame:
    """(tree, cell, fp): one row per fingerprint and tree."""
    keys = []
    for spans in _block_keys(max_bits):
        key, used = F.lit(0).cast("long"), 0
        for shift, width in spans:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key, used = key.bitwiseOR(F.shiftleft(part, used)), used + width
        keys.append(key)
    return fps.select("fp", F.posexplode(F.array(*keys)).alias("tree", "cell"))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def _shards(fps: DataFrame, max_bits: int, shard_rows: int) -> DataFrame:
    """(tree, cell, shell, part, query, fp): where each fingerprint lives (query false) and where it only asks."""
    cells = _cells(fps, max_bits)
    # one row per crowded cell: at most (trees x fingerprints / shard_rows) rows
    crowded = (cells.groupBy("tree", "cell").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp")).alias("vantage"))
               .where(F.col("n") > shard_rows).select("tree", "cell", "vantage"))
    placed = cells.join(crowded, ["tree", "cell"], "left")
    shell = F.coalesce(_distance(F.col("fp"), F.col("vantage")), F.lit(-1))
    reach = F.when(shell < 0, F.array(shell)).otherwise(F.sequence(shell, shell + max_bits))
    shells = (placed.select("tree", "cell", "fp", shell.alias("home"), F.explode(reach).alias("shell"))
              .select("tree", "cell", "shell", (F.col("shell") != F.col("home")).alias("query"), "fp"))
    # a shell that is crowded still (its fingerprints are too near for bounds to part them) is dealt into parts: a
    # member lives in one and asks those behind it, so each pair of parts meets once; queries ask all
    full = (shells.where(~F.col("query")).groupBy("tree", "cell", "shell").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows)
            .select("tree", "cell", "shell", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")))
    dealt = shells.join(full, ["tree", "cell", "shell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.when(F.col("query"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    return (dealt.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.greatest("own", F.lit(0)), F.col("parts") - 1)))
            .select("tree", "cell", "shell", "part", (F.col("part") != F.col("own")).alias("query"), "fp"))


def _span(members: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Links joining the members of each label in a tree of small degree."""
    order = np.argsort(labels, kind="stable")
    lab, mem = labels[order], members[order]
    first = np.r_[True, lab[1:] != lab[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(lab)), 0))
    at = np.arange(len(lab)) - start
    child = np.flatnonzero(at > 0)
    parent = start[child] + (at[child] - 1) // FAN_OUT
    return [np.stack([mem[child], mem[parent]])] if len(child) else []


def _link_block(a: np.ndarray, b: np.ndarray | None, r: int) -> list[np.ndarray]:
    """Links spanning the matches within ``a`` (b None) or between ``a`` and ``b``; at most 512 rows a side."""
    if b is None:
        near = np.bitwise_count(a[:, None] ^ a[None, :]) <= r
        members = a
    else:
        cross = np.bitwise_count(a[:, None] ^ b[None, :]) <= r
        if not cross.any():
            return []
        rows, cols = np.flatnonzero(cross.any(axis=1)), np.flatnonzero(cross.any(axis=0))
        cross, members = cross[np.ix_(rows, cols)], np.concatenate([a[rows], b[cols]])
        near = np.eye(len(members), dtype=bool)
        near[:len(rows), len(rows):] = cross
        near[len(rows):, :len(rows)] = cross.T
    if near.sum() == len(members):
        return []
    labels = np.arange(len(members))
    while True:
        new = np.where(near, labels[None, :], len(members)).min(axis=1)
        new = new[new]
        if (new == labels).all():
            return _span(members, labels)
        labels = new


def tree_links(points: np.ndarray, r: int) -> list[np.ndarray]:
    """Vantage-point search: links spanning all pairs of ``points`` (uint64, distinct) at most r apart."""
    links, stack = [], [points]
    while stack:
        pts = stack.pop()
        if len(pts) <= LEAF:
            links += _link_block(pts, None, r)
            continue
        d = np.bitwise_count(pts ^ pts[len(pts) // 2]).astype(np.int16)
        mu = int(np.median(d))
        inside = d <= mu
        if inside.all():                      # the median is the largest distance: split below it
            mu -= 1
            inside = d <= mu
        stack += [pts[inside], pts[~inside]]
        near, far = np.flatnonzero(inside & (d > mu - r)), np.flatnonzero(~inside & (d <= mu + r))
        links += cross_links(pts[near], d[near], pts[far], d[far], r)
    return links


def cross_links(a: np.ndarray, da: np.ndarray, b: np.ndarray, db: np.ndarray, r: int) -> list[np.ndarray]:
    """Links between two sides, given their distances to one vantage point (triangle bound)."""
    links = []
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    a, da, b, db = a[oa], da[oa], b[ob], db[ob]
    for i in range(0, len(a), 512):
        lo, hi = np.searchsorted(db, da[i] - r, "left"), np.searchsorted(db, da[min(i + 511, len(a) - 1)] + r, "right")
        for j in range(lo, hi, 512):
            links += _link_block(a[i:i + 512], b[j:min(j + 512, hi)], r)
    return links


def _shard_links(home: np.ndarray, queries: np.ndarray, r: int) -> list[np.ndarray]:
    links = tree_links(home, r) if len(home) > 1 else []
    if len(home) and len(queries):
        v = home[0]
        links += cross_links(queries, np.bitwise_count(queries ^ v).astype(np.int16),
                             home, np.bitwise_count(home ^ v).astype(np.int16), r)
    return links


def _small_links(group: np.ndarray, fp: np.ndarray, query: np.ndarray, r: int) -> list[np.ndarray]:
    """All small groups at once: rows s apart in the same group, s = 1, 2, ..."""
    links = []
    for s in range(1, SMALL):
        same = group[s:] == group[:-s]
        if not same.any():
            break
        same &= (np.bitwise_count(fp[s:] ^ fp[:-s]) <= r) & ~(query[s:] & query[:-s])
        at = np.flatnonzero(same)
        links.append(np.stack([fp[at + s], fp[at]]))
    return links


def _partition_links(r: int):
    """Rows sorted by shard: the last shard of a batch waits until the next one begins."""
    def run(batches):
        waiting: list[list[np.ndarray]] = []        # arrays of one shard, joined once

        def closed():
            if waiting:
                part = [np.concatenate(c) for c in zip(*waiting, strict=True)]
                yield from _emit(part, np.arange(len(part[0])) == 0, r)
                waiting.clear()
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in part[:4]], axis=0)]
            starts = np.flatnonzero(new)
            if waiting and all(w[-1] == c[0] for w, c in zip(waiting[-1][:4], part[:4], strict=True)):
                end = int(starts[1]) if len(starts) > 1 else len(new)
                waiting.append([c[:end] for c in part])
                if end == len(new):
                    continue
                part, new = [c[end:] for c in part], new[end:]
                starts = np.flatnonzero(new)
            yield from closed()
            last = int(starts[-1])
            yield from _emit([c[:last] for c in part], new[:last], r)
            waiting.append([c[last:] for c in part])
        yield from closed()
    return run


def _emit(part, new, r):
    if not len(part[0]):
        return
    query, fp = part[4].astype(bool), np.ascontiguousarray(part[5].astype(np.int64)).view(np.uint64)
    group = np.cumsum(new)
    sizes = np.bincount(group)[group]
    few = (sizes > 1) & (sizes <= SMALL)
    links = _small_links(group[few], fp[few], query[few], r)
    big = np.flatnonzero(new & (sizes > SMALL))
    for at in big:
        rows = slice(at, at + int(sizes[at]))
        links += _shard_links(fp[rows][~query[rows]], fp[rows][query[rows]], r)
    if links:
        found = np.concatenate(links, axis=1)
        found = np.unique(np.stack([found.max(axis=0), found.min(axis=0)]), axis=1)
        for i in range(0, found.shape[1], 100_000):
            a, b = (pa.array(np.ascontiguousarray(x[i:i + 100_000]).view(np.int64)) for x in found)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def links(fps: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``fps(fp)`` distinct -> ``(a, b)``: links whose components are those of all pairs <= max_bits apart."""
    key = ["tree", "cell", "shell", "part"]
    return (_shards(fps, max_bits, shard_rows).repartition(*key).sortWithinPartitions(*key)
            .select(*key, "query", "fp").mapInArrow(_partition_links(max_bits), "a long, b long"))


# ---------------------------------------------------------------- operator

def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, text_hash, fp)`` per row, computed once and written to the shared folder."""
    return materialise(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                                   fingerprint(F.col(text_col), shingle_words).alias("fp")))


def fingerprint_components(fps: DataFrame, max_bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``fps(fp, ...)`` -> ``(fp, root)`` for each distinct fingerprint that has a link."""
    return components(links(fps.select("fp").distinct(), max_bits, shard_rows)).withColumnRenamed("id", "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                       shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest non-null id reachable over links of at
    most ``max_bits`` (null only if no id of the component is set). Rows
    repeating an id or a text each get their row; null texts count as empty.
    An empty table gives an empty one; other columns are not read.
    """
    rows = fingerprint_table(docs, id_col, text_col, shingle_words)
    per_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = per_fp.join(fingerprint_components(rows, max_bits, shard_rows), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = named.join(least, "root").select("fp", "component_id")
    return rows.join(per_fp, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` with one row of each component: the smallest (id, text hash), null ids last.

    All columns are kept as they are. Of rows repeating that id and text one stays.
    """
    rid = fresh(docs, "rid")
    known = numbered(docs, rid)
    rows = materialise(known.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                                    fingerprint(F.col(text_col), shingle_words).alias("fp"), F.col(rid).alias("rid")))
    marks = rows.join(fingerprint_components(rows, max_bits, shard_rows), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "fp", "rid")
    keep = marks.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.rid").alias(rid))
    return known.join(keep, rid, "left_semi").select(*docs.columns)
