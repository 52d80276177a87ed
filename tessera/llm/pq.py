"""Embedding near-duplicates by product quantisation (operator 6).

1. Vectors that are null, zero, or hold null or non-finite components link with
   nothing. Equal vectors are folded into one row with a count first, so that a
   group of copies costs one vector. Vectors of different sizes never link;
   each size has its own index.
2. **Index.** Unit vectors go to the nearest of about sqrt(n) coarse centroids
   (inverted lists). The residual is cut into subspaces and each part is
   replaced by its nearest code. Centroids and codes are fitted on at most
   ``FIT_ROWS`` vectors, picked by hash; every vector is indexed, with the exact
   norm ``e`` of what its codes miss.
3. **Probes.** A vector visits its own list and, of its ``PROBES`` nearest
   lists, those after its own: each pair of lists is searched from one side.
4. **Search.** A visitor builds its table of distances to all codes of a list;
   the distance to a member is a sum of table entries. The triangle inequality
   makes this test lossless: |q - x| >= |q - code(x)| - e, so only members with
   a table distance of at most ``sqrt(2 - 2 cos) + e`` can match. These are
   compared exactly, in double precision.
5. Lists are split into parts of ``PART_ROWS`` members, visitors of a crowded
   list into groups, so no task holds a whole list. What leaves a task are link
   counts and links that span the matches, never all pairs.

What is lost is only a pair whose later list is not among the first's probes;
tests measure recall against brute force.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components
from .simhash import _span

COSINE = 0.9
FIT_ROWS = 8192
PROBES = 32
MOST_LISTS = 4096
SUBSPACE = 8            # components coded together
CODES = 64
PART_ROWS = 4096
GROUP_ROWS = 1 << 17    # visitors of a list that share a task
BLOCK = 256


# ---------------------------------------------------------------- index

def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from ``k`` rows spread evenly; empty clusters keep their centre."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        order = np.argsort(near, kind="stable")
        found, at = np.unique(near[order], return_index=True)
        centres[found] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.r_[at, len(x)])[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(x[i:i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, int)])


@dataclass
class Index:
    coarse: np.ndarray          # (lists, dim)
    codes: list[np.ndarray]     # per subspace (codes, width)

    @staticmethod
    def fit(x: np.ndarray, lists: int) -> Index:
        coarse = kmeans(x, lists, 8)
        rest = x - coarse[nearest(x, coarse)]
        return Index(coarse, [kmeans(rest[:, a:a + SUBSPACE], CODES, 6) for a in range(0, x.shape[1], SUBSPACE)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home list, codes (n, subspaces) and the norm of what the codes miss."""
        home = nearest(x, self.coarse)
        rest = x - self.coarse[home]
        code = np.stack([nearest(rest[:, m * SUBSPACE:(m + 1) * SUBSPACE], c) for m, c in enumerate(self.codes)], axis=1)
        miss = rest - np.concatenate([c[code[:, m]] for m, c in enumerate(self.codes)], axis=1)
        return home, code.astype(np.uint8), np.sqrt((miss * miss).sum(axis=1))

    def probes(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(n, probes) nearest lists."""
        score = x @ self.coarse.T - (self.coarse * self.coarse).sum(axis=1) / 2
        p = min(probes, score.shape[1])
        return np.argpartition(-score, p - 1, axis=1)[:, :p]

    def table_distance2(self, q: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Squared distances (visitors, members) from the tables of list ``at``."""
        rest, out = q - self.coarse[at], np.zeros((len(q), len(code)))
        for m, c in enumerate(self.codes):
            part = rest[:, m * SUBSPACE:(m + 1) * SUBSPACE]
            table = (part * part).sum(axis=1)[:, None] - 2 * part @ c.T + (c * c).sum(axis=1)
            out += table.take(code[:, m], axis=1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


# ---------------------------------------------------------------- search

class Part:
    """Members of one part of a list, and what its visitors have found so far."""

    def __init__(self, index: Index, at: int, key: np.ndarray, copies: np.ndarray, x: np.ndarray, cosine: float):
        self.index, self.at, self.key, self.copies, self.x, self.cosine = index, at, key, copies, unit(x), cosine
        _, self.code, self.miss = index.encode(self.x)
        self.label, self.count = np.arange(len(key)), np.zeros(len(key), np.int64)

    def visit(self, key: np.ndarray, copies: np.ndarray, x: np.ndarray, own: np.ndarray):
        """Link counts of the visitors, and one link for each that has any. ``own``: the visitor lives in this list."""
        reach = np.sqrt(2 - 2 * self.cosine) + 1e-6
        found, links = np.zeros(len(key), np.int64), []
        for i in range(0, len(key), BLOCK):
            rows = slice(i, i + BLOCK)
            q = unit(x[rows])
            maybe = self.index.table_distance2(q, self.at, self.code) <= (reach + self.miss) ** 2
            r, c = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
            if not len(r):
                continue
            match = (q[r] @ self.x[c].T >= self.cosine) & (key[rows][r][:, None] != self.key[c][None, :])
            r, match = r[match.any(axis=1)], match[match.any(axis=1)]
            if not len(r):
                continue
            found[i + r] = match @ self.copies[c]
            cross = ~own[rows][r]                        # members of the visitor's own list count it on their own visit
            self.count[c] += copies[rows][r][cross] @ match[cross]
            while True:
                low = np.where(match, self.label[c][None, :], len(self.key)).min(axis=1)
                new = np.minimum(self.label[c], np.where(match, low[:, None], len(self.key)).min(axis=0))
                if (new == self.label[c]).all():
                    break
                self.label[c] = new
            links.append(np.stack([key[i + r], self.key[c[match.argmax(axis=1)]]]))
        return found, links


def _search(index: Index, cosine: float):
    """Rows sorted by (list, part, group, visitor): members first, then visitors, batch by batch."""
    empty = np.empty(0, np.int64)

    def out(key, count, links):
        a, b = np.concatenate(links, axis=1) if links else (empty, empty)
        keep = count > 0
        n, m = int(keep.sum()), len(a)
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[key[keep], a], pa.int64()), pa.array(np.r_[count[keep], np.zeros(m, np.int64)], pa.int64()),
            pa.array(np.r_[np.zeros(n, np.int64), b], pa.int64(), mask=np.r_[np.ones(n, bool), np.zeros(m, bool)])], ["key", "n", "other"])

    def run(batches):
        at, members, part = None, [], None

        def closed():
            if part is not None:
                return [out(part.key, part.count, [np.stack([self_[0], self_[1]]) for self_ in _span(part.key, part.label)])]
            return []

        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            key, copies = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5))
            own = batch.column(6).to_numpy(zero_copy_only=False).astype(bool)
            x = np.asarray(pa.array(batch.column(7)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)
            cuts = np.r_[0, np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1, len(where)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here, visitor = tuple(where[a, :3]), where[a, 3]
                if here != at:
                    yield from closed()
                    at, members, part = here, [], None
                if not visitor:
                    members.append((key[a:b], copies[a:b], x[a:b]))
                    continue
                if part is None:
                    if not members:
                        continue
                    part = Part(index, int(at[0]), *(np.concatenate(v) for v in zip(*members, strict=True)), cosine)
                found, links = part.visit(key[a:b], copies[a:b], x[a:b], own[a:b])
                yield out(key[a:b], found, links)
        yield from closed()
    return run


def _valid(v: Column) -> Column:
    plain = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & F.coalesce(plain, F.lit(False)) & F.exists(v, lambda c: c != 0)


def _links_of_size(vectors: DataFrame, dim: int, cosine: float, probes: int, part_rows: int, group_rows: int) -> DataFrame:
    """``vectors(key, copies, v)`` of one size -> ``(key, n, other)``: counts (other null) or links (n zero)."""
    n = vectors.count()
    low = vectors.select("v", F.xxhash64("v", F.lit("fit")).alias("h")).orderBy("h").limit(FIT_ROWS)
    sample = unit(np.array([r.v for r in low.select("v").collect()], np.float64).reshape(-1, dim))
    index = Index.fit(sample, min(MOST_LISTS, max(1, round(n ** 0.5))))

    @F.pandas_udf("home int, probes array<int>")
    def assign(v: pd.Series) -> pd.DataFrame:
        x = unit(np.stack([np.asarray(a, np.float64) for a in v])) if len(v) else np.empty((0, dim))
        home = nearest(x, index.coarse)
        near = index.probes(x, probes)
        return pd.DataFrame({"home": home.astype(np.int32), "probes": [row[row > h].astype(np.int32) for row, h in zip(near, home, strict=True)]})

    placed = materialise(vectors.withColumn("a", assign("v")).select("key", "copies", "v", "a.home", "a.probes"))
    sizes = np.zeros(len(index.coarse), np.int64)
    for r in placed.groupBy("home").count().collect():           # at most MOST_LISTS rows
        sizes[r.home] = r["count"]
    spark = vectors.sparkSession
    lists = spark.createDataFrame([(i, max(1, -(-int(s) // part_rows)), max(1, -(-int(s) // group_rows))) for i, s in enumerate(sizes)],
                                  "list int, parts int, groups int")
    salt = F.abs(F.xxhash64("key") % (1 << 40))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    members = (placed.withColumnRenamed("home", "list").join(F.broadcast(lists), "list")
               .select("list", (salt % F.col("parts")).cast("int").alias("part"), F.explode(upto("groups")).alias("group"),
                       F.lit(0).alias("visitor"), "key", "copies", F.lit(True).alias("own"), "v"))
    visits = placed.select("key", "copies", "v", "home", F.explode(F.concat(F.array("home"), "probes")).alias("list"))
    visitors = (visits.join(F.broadcast(lists), "list")
                .select("list", F.explode(upto("parts")).alias("part"), (salt % F.col("groups")).cast("int").alias("group"),
                        F.lit(1).alias("visitor"), "key", "copies", (F.col("home") == F.col("list")).alias("own"), "v"))
    place = ["list", "part", "group"]
    return (members.unionByName(visitors).repartition(*place).sortWithinPartitions(*place, "visitor")
            .mapInArrow(_search(index, cosine), "key long, n long, other long"))


# ---------------------------------------------------------------- operator

def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                    probes: int = PROBES, part_rows: int = PART_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of ``vectors``: ``(vec_id, n_links, component_id, kept)``.

    ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest non-null id reachable. A vector that links
    with nothing is its own component and kept. An empty table gives an empty one.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(_valid(v), v).alias("v"))
    folded = (rows.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
              .withColumn("key", F.monotonically_increasing_id()))
    folded = materialise(folded)
    found = None
    for r in folded.select(F.size("v").alias("dim")).distinct().collect():      # one index per vector size
        part = _links_of_size(folded.where(F.size("v") == r.dim).select("key", "copies", "v"), r.dim, cosine, probes, part_rows, group_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        per = folded.select("v", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    else:
        found = materialise(found)
        counts = found.where("other is null").groupBy("key").agg(F.sum("n").alias("n"))
        roots = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
        named = folded.join(roots.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        per = (named.join(least, "root").join(counts, "key", "left")
               .select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    linked = rows.where("v is not null").join(per, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
